"""Results recorded in two phases: a plan of files as rows, checked against what is there, and the same plan written, or nothing of it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.shared import settled

# What a family or an arm may be called, as both become parts of paths, and the directions of a metric.
NAME = "^[A-Za-z0-9][A-Za-z0-9_.-]*$"
DIRECTIONS = ("lower_is_better", "higher_is_better")


class Refused(ValueError):
    """A plan that can't be written; rows says why: (at, reason), no more than the first hundred of them."""

    def __init__(self, rows: list):
        super().__init__("; ".join(f"{r['at']}: {r['reason']}" for r in rows))
        self.rows = rows


def refusals(values: DataFrame, declared: DataFrame, known: DataFrame) -> DataFrame:
    """at, reason of what may not be recorded. values: family, arm, metric, value; declared and known: metric, direction.

    Names that can't be parts of paths, values that aren't finite, metrics twice in an arm or of no direction, directions that don't exist or differ
    from each other or from what is known.
    """
    where = F.concat_ws("/", "family", "arm", "metric")
    name = lambda c: F.coalesce(F.col(c).rlike(NAME), F.lit(False))
    said = F.when(~name("family"), "no name of a family").when(~name("arm"), "no name of an arm").when(F.col("metric").isNull() | (F.col("metric") == ""), "no metric")
    said = said.when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), "no finite value")
    each = values.select(where.alias("at"), said.alias("reason"))
    twice = values.groupBy("family", "arm", "metric").count().filter("count > 1").select(where.alias("at"), F.lit("a metric twice").alias("reason"))
    directed = declared.select("metric").union(known.select("metric"))
    undeclared = values.select("metric").distinct().join(directed, "metric", "left_anti").select(F.col("metric").alias("at"), F.lit("a metric of no direction").alias("reason"))
    odd = F.when(~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False)), "no direction").when(F.col("direction") != F.col("was"), F.format_string("it is %s already", "was"))
    differing = declared.join(known.select("metric", F.col("direction").alias("was")), "metric", "left").select(F.col("metric").alias("at"), odd.alias("reason"))
    both = declared.groupBy("metric").agg(F.countDistinct("direction").alias("n")).filter("n > 1").select(F.col("metric").alias("at"), F.lit("declared in two directions").alias("reason"))
    return each.union(twice).union(undeclared).union(differing).union(both).filter("reason IS NOT NULL").distinct()


def files(values: DataFrame, families: DataFrame, recorded_at: str, config: dict[str, str] | None = None) -> DataFrame:
    """path, content of an arm's results and of its configuration. families: family, corpus (may be null)."""
    metrics = F.array_sort(F.collect_list(F.struct("metric", F.col("value").cast("double").alias("value"))))
    arms = values.groupBy("family", "arm").agg(metrics.alias("m")).join(families, "family", "left")
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    lines = F.transform("m", lambda m: F.concat(F.lit("  "), quoted(m["metric"]), F.lit(": "), m["value"].cast("string")))
    results = F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}\n"))
    more = "".join(f"{k}: {v}\n" for k, v in (config or {}).items())
    corpus = F.coalesce(F.concat(F.lit("corpus: "), F.nullif("corpus", F.lit("")), F.lit("\n")), F.lit(""))
    setting = F.concat(F.lit("family: "), "family", F.lit("\narm: "), "arm", F.lit("\n"), corpus, F.lit(f"recorded_at: {recorded_at}\n{more}"))
    stem = F.concat_ws("_", "family", "arm")
    both = F.array(F.struct(F.concat(F.lit("results/"), stem, F.lit(".json")).alias("path"), results.alias("content")), F.struct(F.concat(F.lit("configs/"), stem, F.lit(".yaml")).alias("path"), setting.alias("content")))
    return arms.select(F.inline(both))


def entries(families: DataFrame, declared: DataFrame, known: DataFrame) -> DataFrame:
    """file, section, key, value of the tables that grow from call to call: corpora, their families, and directions that weren't known."""
    named = families.filter("corpus IS NOT NULL AND corpus <> ''")
    rows = [
        named.select(F.lit("corpora").alias("file"), F.concat(F.lit("corpus."), "corpus").alias("section"), F.lit("source").alias("key"), F.col("corpus").alias("value")),
        named.select(F.lit("corpora"), F.lit("assign.family"), F.col("family"), F.col("corpus")),
        declared.join(known, "metric", "left_anti").select(F.lit("metric_direction"), F.lit("metric_direction"), F.col("metric"), F.col("direction")),
    ]
    return rows[0].union(rows[1]).union(rows[2]).distinct()


def merge_entries(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table after new entries, conflicts: at, reason): a key that has another value is a conflict and keeps it; an equal one is none."""
    key = ["file", "section", "key"]
    clash = new.join(stored.withColumnRenamed("value", "was"), key).filter("value <> was")
    at, reason = F.concat_ws(".", *key).alias("at"), F.format_string("it is %s already, not %s", "was", "value").alias("reason")
    return stored.unionByName(new.join(stored, key, "left_anti")), clash.select(at, reason)


def actions(planned: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """planned with sha256 and action: new, unchanged, and where other content is stored (path, sha256) conflict, or replaced by force.

    Paths that two arms share (a_b/c and a/b_c) are conflicts unless their content is the same, whatever is stored.
    """
    rows = planned.withColumn("sha256", F.sha2("content", 256)).groupBy("path").agg(F.min_by("content", "sha256").alias("content"), F.min("sha256").alias("sha256"), F.max("sha256").alias("_other"))
    was = stored.select("path", F.col("sha256").alias("_was"))
    action = F.when(F.col("sha256") != F.col("_other"), "conflict").when(F.col("_was").isNull(), "new").when(F.col("_was") == F.col("sha256"), "unchanged").otherwise("replaced" if force else "conflict")
    return rows.join(was, "path", "left").select("path", "content", "sha256", action.alias("action"))


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), sha256 of the results and configurations that are there."""
    there = [f"{root}/{d}" for d in ("results", "configs") if os.path.isdir(f"{root}/{d}") and os.listdir(f"{root}/{d}")]
    if not there:
        return spark.createDataFrame([], "path string, sha256 string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there)
    return found.select(F.regexp_extract("path", r"((?:results|configs)/[^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"))


def _put(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(part, target)
            yield batch[["path"]]

    return run


def record(spark: SparkSession, root: str, values: DataFrame, families: DataFrame, declared: DataFrame, known: DataFrame, recorded_at: str, config: dict[str, str] | None = None, force: bool = False, dry_run: bool = False) -> DataFrame:
    """path, sha256, action of the plan, and its files written below root unless it is a dry run. Raises Refused before anything is written.

    root is a folder that all executors see. The plan is settled once: what was checked is what is written, each file whole, and a task that runs again
    writes the same. Files that are unchanged aren't touched, so a second call with the same values and time changes nothing.
    """
    plan = settled(actions(files(values, families, recorded_at, config), stored_files(spark, root), force), "record-plan")
    clashes = plan.filter("action = 'conflict'").select(F.col("path").alias("at"), F.lit("other content").alias("reason"))
    against = refusals(values, declared, known).union(clashes).orderBy("at", "reason").limit(100).collect()
    if against:
        raise Refused(against)
    if not dry_run:
        plan.filter("action IN ('new', 'replaced')").select("path", "content").mapInPandas(_put(root), "path string").write.format("noop").mode("overwrite").save()
    return plan.select("path", "sha256", "action")
