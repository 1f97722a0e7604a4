"""Results planned and written in two phases."""

import os

import pytest

import tracewright.plans.stating  # noqa: F401
from tests.oracle import check
from tracewright.plans.registry import ORACLE_SQL, QUERIES
from tracewright.sources import recording

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["corpora_in_payload", "corpora_in_source", "record_plan"])
def test_against_sql(spark, name):
    assert check(QUERIES[name](spark, SF), ORACLE_SQL[name], SF) >= 20


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): (open(os.path.join(d, f)).read(), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(root) for f in fs}


def tables(spark, values, declared=(("loss", "lower_is_better"),), known=(("acc", "higher_is_better"),)):
    directions = "metric string, direction string"
    return (spark.createDataFrame(values, "family string, arm string, metric string, value double"), spark.createDataFrame([("f", "shelf"), ("g", None)], "family string, corpus string"),
            spark.createDataFrame(list(declared), directions), spark.createDataFrame(list(known), directions))


VALUES = [("f", "x", "loss", 0.5), ("f", "x", "acc", 0.25), ("g", "y", "acc", 1.0)]


def test_written_once(spark, tmp_path):
    root, at = str(tmp_path / "w"), "2031-01-01T00:00:00Z"
    args = tables(spark, VALUES)
    dry = recording.record(spark, root, *args, at, dry_run=True).collect()
    assert not os.path.exists(root) and {r["action"] for r in dry} == {"new"} and len(dry) == 4
    recording.record(spark, root, *args, at, config={"lr": "3"})
    first = tree(root)
    assert first["results/f_x.json"][0] == '{\n  "acc": 0.25,\n  "loss": 0.5\n}\n'
    assert first["configs/f_x.yaml"][0] == "family: f\narm: x\ncorpus: shelf\nrecorded_at: 2031-01-01T00:00:00Z\nlr: 3\n"
    assert first["configs/g_y.yaml"][0] == "family: g\narm: y\nrecorded_at: 2031-01-01T00:00:00Z\nlr: 3\n" and len(first) == 4
    again = recording.record(spark, root, *args, at, config={"lr": "3"})
    assert {r["action"] for r in again.collect()} == {"unchanged"} and tree(root) == first
    # One arm that differs and one that is new: nothing is written, not even the new one.
    changed = tables(spark, [("f", "x", "loss", 0.75), ("f", "x", "acc", 0.25), ("f", "z", "acc", 2.0)])
    with pytest.raises(recording.Refused, match="results/f_x.json: other content"):
        recording.record(spark, root, *changed, at, config={"lr": "3"})
    assert tree(root) == first
    recording.record(spark, root, *changed, at, config={"lr": "3"}, force=True)
    assert '"loss": 0.75' in tree(root)["results/f_x.json"][0] and "results/f_z.json" in tree(root)


def test_refusals(spark, tmp_path):
    values = [("../up", "x", "acc", 1.0), ("f", ".hid", "acc", 1.0), ("f", "x", "other", 1.0), ("f", "y", "acc", float("nan")), ("f", "z", "acc", 1.0), ("f", "z", "acc", 2.0), (None, "x", "acc", 1.0)]
    declared = [("loss", "lower"), ("acc", "lower_is_better"), ("wer", "lower_is_better"), ("wer", "higher_is_better")]
    v, f, d, k = tables(spark, values, declared)
    got = {(r["at"], r["reason"]) for r in recording.refusals(v, d, k).collect()}
    assert got == {("../up/x/acc", "no name of a family"), ("f/.hid/acc", "no name of an arm"), ("other", "a metric of no direction"), ("f/y/acc", "no finite value"), ("f/z/acc", "a metric twice"),
        ("x/acc", "no name of a family"), ("loss", "no direction"), ("acc", "it is higher_is_better already"), ("wer", "declared in two directions")}
    with pytest.raises(recording.Refused):
        recording.record(spark, str(tmp_path / "w"), v, f, d, k, "t")
    assert not os.path.exists(tmp_path / "w")


def test_shared_paths_and_entries(spark):
    v, f, d, k = tables(spark, [("a", "b_c", "acc", 1.0), ("a_b", "c", "acc", 1.0)])
    plan = recording.actions(recording.files(v, f, "t"), spark.createDataFrame([], "path string, sha256 string"))
    assert {r["path"]: r["action"] for r in plan.collect()} == {"results/a_b_c.json": "new", "configs/a_b_c.yaml": "conflict"}
    new = recording.entries(f, d, k)
    rows = {tuple(r) for r in new.collect()}
    assert rows == {("corpora", "corpus.shelf", "source", "shelf"), ("corpora", "assign.family", "f", "shelf"), ("metric_direction", "metric_direction", "loss", "lower_is_better")}
    stored = spark.createDataFrame([("corpora", "assign.family", "f", "attic"), ("corpora", "corpus.shelf", "source", "shelf")], new.schema)
    merged, clashes = recording.merge_entries(stored, new)
    assert merged.count() == 3 and [tuple(r) for r in clashes.collect()] == [("corpora.assign.family.f", "it is attic already, not shelf")]
