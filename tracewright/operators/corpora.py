"""Corpora by name: gaps are filled, values that stand aren't overwritten, and a name with two meanings is contested."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("source", "config", "tokenizer", "vocab_size", "seq_len", "source_path")


def upsert(stored: DataFrame, declared: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """name, fields and contested, after declarations (name, place, fields) in the order of place; declarations without a name go.

    A field keeps the stored value, or takes the first that is declared. A declared value that differs from the one kept makes the name contested;
    its source then reads so, with the first source that differs (or what is kept). Firsts and distinct counts combine within tasks.
    """
    old = stored.select("name", *fields, F.lit(-1).cast("long").alias("place"))
    new = declared.filter("name IS NOT NULL AND name <> ''").select("name", *fields, F.col("place").cast("long").alias("place"))
    rows = old.unionByName(new)
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in fields]
    differ = [(F.min(c) != F.max(c)).alias(f"_{c}") for c in fields]
    both = [F.min_by(F.struct("place", "source"), "place").alias("_first"), F.sort_array(F.collect_set("source")).alias("_sources")] if "source" in fields else []
    merged = rows.groupBy("name").agg(*first, *differ, *both)
    contested = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_{c}"), F.lit(False)) for c in fields])
    out = merged.withColumn("contested", contested)
    if "source" in fields:
        other = F.element_at(F.filter("_sources", lambda s: s != F.col("source")), 1)
        said = F.concat(F.lit("CONTESTED: "), F.coalesce("source", F.lit("none")), F.lit(" vs "), F.coalesce(other, F.col("source"), F.lit("none")))
        out = out.withColumn("source", F.when(F.col("contested"), said).otherwise(F.col("source")))
    return out.select("name", *fields, "contested")
