"""Curves of runs as a stream: points become lines of a history, and a run's file appears as a whole once its end arrives.

A history is JSON lines in canonical form: a header, each series once, right before its first point, with numbers in order of declaration, and the points
in the order in which they were logged. State holds a run's series and its last place, never its lines: those are staged as rows, a folder for each
micro-batch, which a batch that is run again after a restart overwrites.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewright.functions.records import canonical_json

EVENTS = "run_id string, seq long, kind string, name string, split string, labels map<string, string>, step long, value double, at string"
LINES = "run_id string, pos long, line string, ended boolean, reason string, seq long"
BUCKETS = 64


def _spelled(value: float):
    """A value as histories hold it: what JSON has no number for is a text."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    return float(value)


class Histories(StatefulProcessor):
    """Lines of a run's history from its events, and what is refused with its reason.

    Events of one micro-batch are taken in order of seq. An event whose seq isn't beyond the last one taken was delivered twice or too late; it is
    refused, as are points without a name, step or value, negative steps, all that comes after the end and, if ``rising``, a step that doesn't rise.
    """

    def __init__(self, schema: str, rising: bool = False):
        self.header, self.rising = canonical_json({"schema": schema}), rising

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "pos long, seq long, series long, ended boolean")
        self.series = handle.getMapState("series", "key string", "id long, step long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pos, last, n, ended = self.at.get() or (0, None, 0, False)
        out: list[tuple] = []

        def put(line, seq, end=False):
            nonlocal pos
            out.append((key[0], pos, line, end, None, seq))
            pos += 1

        events = pd.concat(list(rows)).sort_values("seq", kind="stable", na_position="last")
        for e in events.itertuples(index=False):
            reason = self._refusal(e, last, ended)
            if reason is None and e.kind == "point":
                labels = dict(e.labels) if e.labels is not None else {}
                split = e.split if isinstance(e.split, str) else None
                name = (json.dumps([e.name, split, sorted(labels.items())]),)
                found = self.series.getValue(name) if self.series.containsKey(name) else None
                if self.rising and found is not None and e.step <= found[1]:
                    reason = "a step that doesn't rise"
                else:
                    number = n if found is None else found[0]
                    if not pos:
                        put(self.header, None)
                    if found is None:
                        put(canonical_json({"series": number, "name": e.name, "split": split, "labels": labels}), None)
                        n += 1
                    at = e.at if isinstance(e.at, str) else None
                    put(canonical_json({"series": number, "step": int(e.step), "value": _spelled(e.value), "at": at}), int(e.seq))
                    self.series.updateValue(name, (int(number), int(e.step)))
            elif reason is None:
                ended = True
                put(None, int(e.seq), True)
            if reason is None:
                last = int(e.seq)
            else:
                out.append((key[0], None, None, False, reason, None if pd.isna(e.seq) else int(e.seq)))
        self.at.update((int(pos), last, int(n), bool(ended)))
        if ended:
            self.series.clear()  # what comes later is refused by the end alone
        yield pd.DataFrame(out, columns=["run_id", "pos", "line", "ended", "reason", "seq"]).astype({"pos": "Int64", "seq": "Int64"})

    @staticmethod
    def _refusal(e, last, ended: bool) -> str | None:
        if pd.isna(e.seq) or e.kind not in ("point", "end"):
            return "neither a point nor an end, or without a place"
        if last is not None and e.seq <= last:
            return "delivered twice or too late"
        if ended:
            return "after the end"
        if e.kind == "point":
            if not isinstance(e.name, str) or not e.name or pd.isna(e.step):
                return "a point without a name or a step"
            if e.value is None or e.value is pd.NA:
                return "a point without a value"
            if e.step < 0:
                return "a negative step"
        return None

    def close(self) -> None:
        pass


def history_lines(events: DataFrame, schema: str, rising: bool = False) -> DataFrame:
    """run_id, pos, line, ended, reason, seq of a stream of events; a batch table of lines has no place for a header in a second run, so this takes streams alone.

    Values that aren't numbers must be told from missing ones, and Arrow hands both to pandas as NaN: events without a value lose their kind first.
    A run's events of one micro-batch are sorted in its task; the source's rate limit (``maxFilesPerTrigger`` and the like) bounds them.
    """
    whole = events.withColumn("kind", F.when((F.col("kind") != "point") | F.col("value").isNotNull(), F.col("kind")))
    return whole.filter("run_id IS NOT NULL").groupBy("run_id").transformWithStateInPandas(Histories(schema, rising), LINES, "append", "none")


def close_runs(spark: SparkSession, root: str, ended: DataFrame) -> None:
    """Write the histories of the runs that ended, each as the one file of ``root/histories/run_id=...``.

    Files lie in a staging folder until the job commits, and a commit moves a run's folder as a whole, so readers see none of it or all.
    A run that ends without a point leaves no file.
    """
    lines = spark.read.schema(f"{LINES}, bucket int, batch long").option("basePath", f"{root}/staged").parquet(f"{root}/staged").filter("line IS NOT NULL")
    own = lines.join(ended.select("run_id", "bucket"), ["run_id", "bucket"], "left_semi")
    placed = own.repartition("run_id").sortWithinPartitions("run_id", "pos").select("run_id", F.col("line").alias("value"))
    placed.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("run_id").text(f"{root}/histories")


def write_batch(root: str):
    """The foreachBatch function that stages a batch's lines, keeps what was refused, and closes the runs that it ends."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = batch.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int")).withColumn("batch", F.lit(batch_id).cast("long"))
        staged.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch", "bucket").parquet(f"{root}/staged")
        ended = spark.read.schema(f"{LINES}, bucket int").parquet(f"{root}/staged/batch={batch_id}").filter("ended")
        if not ended.isEmpty():
            close_runs(spark, root, ended)

    return run


def write_curves(events: DataFrame, root: str, checkpoint: str, schema: str, rising: bool = False) -> StreamingQuery:
    """Start the stream that writes histories below root; started again with the same checkpoint it goes on where it stopped.

    State needs Spark's RocksDB store (``spark.sql.streaming.stateStore.providerClass``), which this sets for the session where it is unset.
    """
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    lines = history_lines(events, schema, rising)
    return lines.writeStream.foreachBatch(write_batch(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refused(spark: SparkSession, root: str) -> DataFrame:
    """run_id, seq, reason of the events that no history holds."""
    return spark.read.schema(f"{LINES}, bucket int, batch long").parquet(f"{root}/staged").filter("reason IS NOT NULL").select("run_id", "seq", "reason")


def references(spark: SparkSession, root: str) -> DataFrame:
    """run_id, sha256, series, points of every closed history: what a run's record says of it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{root}/histories")
    run = F.regexp_extract("path", r"/run_id=([^/]+)/", 1)
    counts = spark.read.schema("value string, run_id string").text(f"{root}/histories").groupBy("run_id").agg(
        F.count_if(F.get_json_object("value", "$.name").isNotNull()).alias("series"), F.count_if(F.get_json_object("value", "$.step").isNotNull()).alias("points"))
    return files.select(F.url_decode(run).alias("run_id"), F.sha2("content", 256).alias("sha256")).join(counts, "run_id")
