"""Writers: idempotent replacement of a project, sync by digest, and listings within a byte budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replace_projects(spark: SparkSession, rows: DataFrame, path: str, partition: str = "project") -> None:
    """Write rows so that each project they hold is replaced as a whole, and others stay: writing twice changes nothing."""
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").partitionBy(partition).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def vanished(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(project, name) that a scan of the same projects no longer finds."""
    scanned = found.select("project").distinct()
    return stored.select("project", "name").join(scanned, "project", "left_semi").join(found.select("project", "name"), ["project", "name"], "left_anti")


def sync_plan(stored: DataFrame, offered: DataFrame, force: bool = False) -> DataFrame:
    """run_id, action for (run_id, digest): written, unchanged, and on a differing digest refused, or replaced by force."""
    a, b = stored.select("run_id", F.col("digest").alias("old")), offered.select("run_id", F.col("digest").alias("new"))
    action = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "written").when(F.col("old") == F.col("new"), "unchanged").otherwise("replaced" if force else "refused")
    return a.join(b, "run_id", "full").select("run_id", action.alias("action"))


def within_budget(rows: DataFrame, order: str, budget: int, group: str) -> DataFrame:
    """JSON lines of each group in order, as many as fit the budget of bytes; the first that doesn't ends it."""
    lines = rows.select(group, order, F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("line"))
    used = F.sum(F.length(F.col("line").cast("binary")) + 1).over(Window.partitionBy(group).orderBy(order))
    return lines.withColumn("used", used).filter(F.col("used") <= budget).drop("used")
