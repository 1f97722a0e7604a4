"""Upserts, folds and merges as grouped picks: the last verdict, the first write, the keeper's word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_verdicts(rows: DataFrame) -> DataFrame:
    """One verdict per (user_id, item_id): the last by (ts, event_id)."""
    own = F.struct("useful", "source", "ts", "event_id")
    return rows.groupBy("user_id", "item_id").agg(F.max_by(own, F.struct("ts", "event_id")).alias("v")).select("user_id", "item_id", "v.*")


def remap_ids(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """rows with column moved from moves.drop_id to moves.keep_id."""
    return rows.join(moves, rows[column] == moves["drop_id"], "left").withColumn(column, F.coalesce("keep_id", column)).drop("drop_id", "keep_id")


def merge_users(verdicts: DataFrame, moves: DataFrame) -> DataFrame:
    """Verdicts after merging users: on an item both judged the keeper's verdict stays, and differing ones count as conflicts."""
    own = verdicts.withColumn("was", F.col("user_id"))
    moved = remap_ids(own, "user_id", moves)
    pick = F.struct((F.col("was") != F.col("user_id")).alias("moved"), "was")
    return moved.groupBy("user_id", "item_id").agg(F.min_by("useful", pick).alias("useful"), (F.count_distinct("useful") > 1).alias("conflict"), F.count(F.lit(1)).alias("n"))


def fold_bibliography(verdicts: DataFrame) -> DataFrame:
    """Per (user_id, item_id) over verdicts in order: a reject removes, a later useful one revives; reason of the strongest use."""
    strength = F.when((F.col("useful") == 1) & F.col("source").isin("ui", "agent"), 0).when(F.col("useful") == 1, 1)
    out = verdicts.groupBy("user_id", "item_id").agg(F.max_by("useful", F.struct("ts", "event_id")).alias("last"), F.min(strength).alias("best"), F.sum(1 - F.col("useful")).alias("rejects"))
    return out.filter("best IS NOT NULL").select("user_id", "item_id", F.when(F.col("best") == 0, "useful").otherwise("read").alias("reason"), (F.col("last") == 0).alias("removed"), "rejects")


def ingest_new(batch: DataFrame, stored_hashes: DataFrame) -> DataFrame:
    """Rows of a batch (id, hash) that are neither stored nor copies of an earlier row of the batch."""
    first = batch.groupBy("hash").agg(F.min("id").alias("id"))
    return first.join(stored_hashes, "hash", "left_anti")
