"""Runs that aren't simply finished: their kind, whether they are stale, their order and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order they are shown, the states a job ends in, and the seconds without a sign of life after which a running job is stale.
KINDS = ("in_flight", "unrecorded", "lagging", "unreadable")
TERMINAL = ("complete", "failed", "cancelled")
STALE_AFTER = 7200


def status(states: DataFrame, now, stale_after: int = STALE_AFTER) -> DataFrame:
    """states (run, state, updated_at, seen_at, has_record) with kind, age_s, idle_s and stale; finished runs go.

    state is null where the state file can't be read. A run in flight is idle since it was last seen, by its state or its files, and stale if it is running and idle for so long.
    """
    ended = F.col("state").isin(*TERMINAL)
    kind = F.when(F.col("state").isNull(), F.when(~F.col("has_record"), "unreadable")).when(F.col("has_record"), F.when(~ended, "lagging")).when(ended, "unrecorded").otherwise("in_flight")
    seconds = lambda c: F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    readable = F.col("state").isNotNull()
    rows = states.withColumn("kind", kind).filter("kind IS NOT NULL")
    rows = rows.withColumn("age_s", F.when(readable, F.round(seconds("updated_at"), 1)))
    idle = F.when((F.col("kind") == "in_flight") & (F.col("seen_at") > F.col("updated_at")), F.round(seconds("seen_at"), 1)).otherwise(F.col("age_s"))
    rows = rows.withColumn("idle_s", idle)
    return rows.withColumn("stale", (F.col("kind") == "in_flight") & F.coalesce((F.col("state") == "running") & (F.col("idle_s") >= stale_after), F.lit(False)))


def in_order(rows: DataFrame) -> DataFrame:
    """By kind, stale ones first, running before submitted, the last changed first, then by name."""
    kinds, states = (F.array(*[F.lit(x) for x in names]) for names in (KINDS, ("running", "submitted")))
    place = F.array_position(states, F.coalesce("state", F.lit("")))
    return rows.orderBy(F.array_position(kinds, F.col("kind")), ~F.col("stale"), F.when(place == 0, 3).otherwise(place), F.coalesce("age_s", F.lit(0.0)), "run")


def counts(rows: DataFrame) -> DataFrame:
    """name, n: of every kind, of the two states in flight, and of stale runs; 0 where there are none."""
    flying = F.col("kind") == "in_flight"
    sums = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    sums += [F.count_if(flying & (F.col("state") == s)).alias(s) for s in ("submitted", "running")]
    names = [*KINDS, "submitted", "running", "stale"]
    one = rows.agg(*sums, F.count_if("stale").alias("stale"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("c")).select("c.*")
