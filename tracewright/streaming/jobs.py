"""Incremental behaviour: job states, idle sessions, late verdicts and deduplication, on streams and in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The moves that a job may make.
MOVES = {("submitted", "running"), ("submitted", "cancelled"), ("submitted", "failed"), ("running", "complete"), ("running", "failed"), ("running", "cancelled")}


def dedup_stream(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; on a batch, each key once."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)


def idle_sessions(events: DataFrame, key: str, time: str = "ts", idle: str = "2 hours") -> DataFrame:
    """key, start, end, n: activity that no gap of the idle time interrupts; works on streams with a watermark."""
    return events.groupBy(key, F.session_window(time, idle).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def transitions(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Every event with the state before it and whether the move is allowed; a first event must submit."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    allowed = F.lit(False)
    for a, b in sorted(MOVES):
        allowed = allowed | ((F.col("before") == a) & (F.col(state) == b))
    return events.withColumn("before", before).withColumn("allowed", F.when(F.col("before").isNull(), F.col(state) == "submitted").otherwise(allowed))


def late_verdicts(verdicts: DataFrame, clicked: DataFrame, cutoff) -> DataFrame:
    """Imported verdicts (user_id, item_id, at, useful) that count: not before the cutoff, and later than what is stored (clicked_at)."""
    return verdicts.join(clicked, ["user_id", "item_id"], "left").filter((F.col("at") >= cutoff) & (F.col("clicked_at").isNull() | (F.col("at") > F.col("clicked_at")))).select("user_id", "item_id", "useful")


def current_states(pdf_key, pdfs, state):
    """For applyInPandasWithState: the job's state after each batch; moves that aren't allowed are refused and counted."""
    import pandas as pd

    now, refused = state.get if state.exists else (None, 0)
    for pdf in pdfs:
        for s in pdf.sort_values(["ts", "event_id"])["state"]:
            ok = s == "submitted" if now is None else (now, s) in MOVES
            now, refused = (s, refused) if ok else (now, refused + 1)
    state.update((now, refused))
    yield pd.DataFrame({"run_id": [pdf_key[0]], "state": [now], "refused": [refused]})


def track_jobs(events: DataFrame) -> DataFrame:
    """run_id, state, refused after each micro-batch of events (run_id, ts, event_id, state)."""
    return events.groupBy("run_id").applyInPandasWithState(current_states, "run_id long, state string, refused long", "state string, refused long", "update", "NoTimeout")
