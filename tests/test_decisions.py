"""Sinks and decisions on small tables."""

import random

from pyspark.sql import functions as F

from tracewright.operators import verification as V
from tracewright.sources import sinks


def test_replacing_projects(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.createDataFrame([("a", "r1", 1), ("a", "r2", 2), ("b", "r3", 3)], "project string, name string, v int")
    sinks.replace_projects(spark, rows, path)
    new = spark.createDataFrame([("a", "r1", 5)], "project string, name string, v int")
    assert [tuple(r) for r in sinks.vanished(spark.read.parquet(path), new).collect()] == [("a", "r2")]
    for _ in range(2):
        sinks.replace_projects(spark, new, path)
    assert sorted((r.project, r.name, r.v) for r in spark.read.parquet(path).collect()) == [("a", "r1", 5), ("b", "r3", 3)]


def test_sync(spark):
    a, b = ([("x", "1"), ("y", "1"), ("z", "1")], [("y", "1"), ("z", "2"), ("w", "1")])
    a, b = (spark.createDataFrame(r, "run_id string, digest string") for r in (a, b))
    assert dict(sinks.sync_plan(a, b).collect()) == {"x": "kept", "y": "unchanged", "z": "refused", "w": "written"}
    assert dict(sinks.sync_plan(a, b, force=True).collect())["z"] == "replaced"


def test_budget(spark):
    rows = spark.createDataFrame([("g", i, "x" * 10) for i in range(10)], "g string, i int, t string")
    line = len('{"g":"g","i":0,"t":"xxxxxxxxxx"}') + 1
    assert sinks.within_budget(rows, "i", 3 * line + 1, "g").count() == 3


def test_settling(spark):
    rows = [("a", "complete", 5, None, 9), ("b", "running", 5, "complete", 9), ("c", "running", 5, None, 3), ("d", "running", 5, "running", 9)]
    got = V.settle_jobs(spark.createDataFrame(rows, "run_id string, last_state string, last_at int, record_state string, now int")).collect()
    assert {tuple(r) for r in got} == {("a", "complete", 5), ("b", "complete", 9), ("c", "failed", 5), ("d", "failed", 9)}


def test_lineage(spark):
    entries = spark.createDataFrame([("r", "1"), ("r", "2"), ("r", "9")], "run_id string, sha256 string")
    data = spark.createDataFrame([("d1", "file", "1"), ("d2", "content", "1"), ("d3", "split", "2")], "dataset_id string, tier string, sha256 string")
    assert {tuple(r) for r in V.lineage_tiers(entries, data).collect()} == {("r", "1", "d2", "content"), ("r", "2", "d3", "split"), ("r", "9", None, "unknown")}


def test_classifier(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(1 if i % 2 else -1, 0.3), rng.random()], i % 2) for i in range(60)]
    table = spark.createDataFrame(rows, "item_id long, embedding array<double>, useful int")
    model = V.click_classifier(table.select("item_id", "useful"), table.select("item_id", "embedding"))
    got = dict(V.classified(model, table).collect())
    assert all((got[i] > 0.5) == bool(u) for i, _, u in rows)
    assert V.click_classifier(table.filter("useful = 1").select("item_id", "useful"), table.select("item_id", "embedding")) is None
    assert table.agg(F.count(F.lit(1))).first()[0] == 60
