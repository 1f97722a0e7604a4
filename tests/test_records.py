"""Records on files, readers that users add, and library upkeep on small tables."""

import difflib
import json
from datetime import datetime

from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.operators import corpora, inflight, library
from tracewright.sources import records

SHA = "ab" * 32
PREFIX = "ledgerbook"


def run(**changes):
    return {"schema": "ledgerbook.run/1", "run_id": "r1", "family": "f", "arm": "a", "status": "complete", "started_at": "2026-01-01T00:00:00Z", "finished_at": "2026-01-01T01:00:00.5Z", "config": {"lr": 0.1},
            "metrics": [{"name": "loss", "value": 0.5, "direction": "min", "step": 1}, {"name": "loss", "value": 0.25, "direction": "min", "step": 2}], "data": [{"name": "d", "sha256": SHA, "role": "train"}]} | changes


def write(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body if isinstance(body, str) else json.dumps(body))
    return f"file://{root}"


def test_run_records_and_quarantine(spark, tmp_path):
    bad = {"status": "status", "family": "family", "started_at": "times", "finished_at": "before", "data": "SHA-256", "metrics": "direction"}
    values = {"status": "done", "family": " ", "started_at": "yesterday", "finished_at": "2025-01-01T00:00:00Z", "data": [{"name": "d", "sha256": "xyz"}], "metrics": [{"name": "m", "value": 1.0, "direction": "up"}]}
    files = {"p/good/ledgerbook/run.json": run(), "p/cut/ledgerbook/run.json": '{"schema": "ledge'}
    files |= {f"p/bad-{k}/ledgerbook/run.json": run(**{k: v}) for k, v in values.items()}
    root = write(tmp_path, files)
    rows = {r.run_dir.rsplit("/", 1)[1]: r for r in records.run_records(spark, root, PREFIX).collect()}
    assert rows["good"].reasons == [] and rows["good"].record.metrics[1].value == 0.25
    assert rows["cut"].reasons == ["read: no JSON object"] and rows["cut"].record is None
    for k, said in bad.items():
        assert any(said in r for r in rows[f"bad-{k}"].reasons), k
    imported, quarantined, report = records.import_project(spark, root, [records.core_reader(PREFIX)])
    assert [(r.reader, r.name, r.metrics) for r in imported.collect()] == [("core", "r1", {"loss": 0.25})]
    assert quarantined.count() == len(files) - 1
    assert [tuple(r) for r in report.collect()] == [("core", 1, len(files) - 1)]


def test_readers_that_users_add(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "_READERS", dict(records._READERS))
    own = lambda spark, root: spark.createDataFrame([("x", "mine", {"acc": 0.5}, [])], "path string, name string, metrics map<string, double>, reasons array<string>")

    def fails(spark, root):
        raise RuntimeError("no such tracker")

    def fails_late(spark, root):
        return own(spark, root).withColumn("name", F.raise_error(F.lit("not while it runs")).cast("string"))

    def corrupt(path, content):
        if b"corrupt" in content:
            raise KeyError("metrics")
        return [(content.decode(), {"size": len(content)})]

    for reader in (records.Reader("own", own), records.Reader("broken", fails), records.Reader("late", fails_late), records.FileReader("each", "*.own", corrupt), records.core_reader(PREFIX)):
        records.register_reader(reader)
    files = {"a/run.json": run(run_id="r9"), "a/one.own": "one", "b/two.own": "corrupt", "results.json": {"val": {"loss": 0.5}, "acc": 1}, "results_cut.jsonl": '{"step": 1, "loss": 0.5}\n{"step": 2, "lo', "results-bad.json": "{", "table.csv": "run,acc,note\nq,0.25,nan\n"}
    files |= {"exp/r7/metrics/loss": "5 0.5 1\n6 0.25 2\n"}
    root = write(tmp_path, files)
    imported, quarantined, report = records.import_project(spark, root)
    got = {(r.reader, r.name): r.metrics for r in imported.collect()}
    assert got == {
        ("core", "r9"): {"loss": 0.25}, ("own", "mine"): {"acc": 0.5}, ("each", "one"): {"size": 3.0}, ("json", "results"): {"val.loss": 0.5, "acc": 1.0},
        ("json", "results_cut"): {"loss": 0.5}, ("csv", "q"): {"acc": 0.25}, ("mlflow", "r7"): {"loss": 0.25},
    }
    bad = {(r.reader, r.path.rsplit("/", 1)[-1]): r.reasons[0] for r in quarantined.collect()}
    assert bad[("each", "two.own")] == "read: KeyError: 'metrics'" and ("json", "results-bad.json") in bad
    assert {k for k, _ in bad} == {"each", "json", "broken", "late"} and "not while it runs" in bad[("late", root.rsplit("/", 1)[-1])]
    assert {r.reader: (r.imported, r.quarantined) for r in report.collect()}["each"] == (1, 1)


def test_states_and_datasets(spark, tmp_path):
    def state(*moves, **changes):
        history = [{"state": s, "at": t} for s, t in moves]
        return {"schema": "ledgerbook.state/1", "run_id": "r", "backend": "local", "job_id": "1", "state": moves[-1][0], "updated_at": moves[-1][1], "message": None, "history": history} | changes

    a, b, c = (f"2026-01-01T0{i}:00:00Z" for i in range(3))
    files = {"ok": state(("submitted", a), ("running", b), ("complete", c)), "first": state(("running", a)), "back": state(("submitted", b), ("running", a)), "jump": state(("submitted", a), ("complete", b)), "other": state(("submitted", a), ("running", b), state="failed")}
    root = write(tmp_path / "s", {f"{k}/ledgerbook/state.json": v for k, v in files.items()})
    got = {r.run_dir.rsplit("/", 1)[1]: " ".join(r.reasons) for r in records.state_files(spark, root, PREFIX).collect()}
    assert got["ok"] == "" and "submitted" in got["first"] and "back in time" in got["back"] and "allowed" in got["jump"] and "last entry" in got["other"]
    data = {"schema": "ledgerbook.dataset/1", "dataset_id": "d", "name": "n", "created_at": a, "content_sha256": SHA, "rows": 3, "files": [{"path": "x", "bytes": 1, "sha256": SHA}]}
    out = data | {"files": [{"path": "../x", "bytes": 1, "sha256": SHA}]}
    twice = data | {"files": data["files"] * 2}
    root = write(tmp_path / "d", {"ok/dataset.json": data, "out/dataset.json": out, "twice/dataset.json": twice})
    assert {r.run_dir.rsplit("/", 1)[1]: len(r.reasons) for r in records.dataset_records(spark, root, PREFIX).collect()} == {"ok": 0, "out": 1, "twice": 1}


def test_histories(spark, tmp_path):
    head, loss = '{"schema":"ledgerbook.history/1"}', '{"series":0,"name":"loss","split":"train"}'
    point = lambda s, k, v: json.dumps({"series": s, "step": k, "value": v, "at": None})
    root = write(tmp_path, {"ok/ledgerbook/history.jsonl": "\n".join([head, loss, point(0, 1, 0.5), point(0, 2, 0.25)]) + "\n", "bad/ledgerbook/history.jsonl": "\n".join([head, loss, point(0, 2, 0.5), point(0, 2, 0.5), point(7, 1, 1.0), '{"series":0,"st'])})
    points, broken = records.histories(spark, root, PREFIX)
    assert [(r.name, r.step, r.value) for r in points.filter("run_dir LIKE '%ok'").orderBy("step").collect()] == [("loss", 1, 0.5), ("loss", 2, 0.25)]
    assert sorted(r.reason for r in broken.collect()) == ["a series that isn't declared", "a step that doesn't rise", "no JSON"]


def test_status_rules(spark):
    t = lambda h: datetime(2026, 1, 1, h)
    rows = [("a", "running", t(1), t(1), False), ("b", "running", t(1), t(9), False), ("c", "submitted", t(1), t(1), False), ("d", "complete", t(1), None, False), ("e", "complete", t(1), None, True), ("f", "running", t(1), None, True), ("g", None, None, None, False), ("h", None, None, None, True)]
    got = inflight.status(spark.createDataFrame(rows, "run string, state string, updated_at timestamp_ntz, seen_at timestamp_ntz, has_record boolean"), F.lit(t(10)))
    assert [(r.run, r.kind, r.stale) for r in inflight.in_order(got).collect()] == [("a", "in_flight", True), ("b", "in_flight", False), ("c", "in_flight", False), ("d", "unrecorded", False), ("f", "lagging", False), ("g", "unreadable", False)]
    assert {r.name: r.n for r in inflight.counts(got.filter("run = 'c'")).collect()} == {"in_flight": 1, "unrecorded": 0, "lagging": 0, "unreadable": 0, "submitted": 1, "running": 0, "stale": 0}


def test_corpora(spark):
    kind = "name string, source string, tokenizer string"
    stored = spark.createDataFrame([("x", "s1", None), ("y", None, "t")], kind)
    new = spark.createDataFrame([("x", "s2", "t1", 1), ("x", "s1", "t1", 2), ("y", "s9", "t", 3), ("z", "s3", None, 4), (None, "s", None, 5)], kind + ", place long")
    got = {r.name: (r.source, r.tokenizer, r.contested) for r in corpora.upsert(stored, new, ("source", "tokenizer")).collect()}
    assert got == {"x": ("CONTESTED: s1 vs s2", "t1", True), "y": ("s9", "t", False), "z": ("s3", None, False)}


def test_cleaning(spark):
    cases = [("a\u0000b\n\t c​ ", 40), ("x" * 50, 10), ("😀" * 30, 10), (None, 5), ("é" * 9, 9), ("ab cd ef gh ij", 7)]
    for value, limit in cases:
        got = spark.range(1).select(X.clean(F.lit(value).cast("string"), limit)).first()[0]
        assert len(got) <= limit and len(got.encode()) <= 2 * limit, value
    assert spark.range(1).select(X.clean(F.lit(cases[0][0]), 40)).first()[0] == "a b c"
    assert spark.range(1).select(X.clean(F.lit("ab cd ef gh ij"), 7)).first()[0] == "ab cd…"
    assert [spark.range(1).select(X.published_at(F.lit(x))).first()[0] for x in ("2026-01-02T03:04:05Z", "2026-01-02 03:04:05", "nonsense")] == [datetime(2026, 1, 2, 3, 4, 5)] * 2 + [None]


def test_library_upkeep(spark):
    refs = spark.createDataFrame([(1, "doi:10.1/a", "smith2000", "10.1/a", None, "deep nets", 2000), (2, "arxiv:1.2", "jones2001", None, "1.2", "wide nets", 2001)], "ref_id long, identity string, bib_key string, doi string, arxiv string, title_key string, year int")
    aliases = spark.createDataFrame([("old-key", 2)], "alias string, ref_id long")
    asked = [(1, "doi:10.1/a", None, None, None, None), (2, "jones2001", None, None, None, None), (3, "old-key", None, None, None, None), (4, None, "10.1/a", None, None, None), (5, None, None, "1.2", None, None), (6, None, None, None, "deep nets", None), (7, "nothing", None, None, "", None)]
    got = {r.ask_id: (r.ref_id, r.rung) for r in library.resolve(spark.createDataFrame(asked, "ask_id long, key string, doi string, arxiv string, title_key string, year int"), refs, aliases).collect()}
    assert got == {1: (1, 0), 2: (2, 1), 3: (2, 2), 4: (1, 3), 5: (2, 4), 6: (1, 5), 7: (None, None)}

    rows = spark.createDataFrame([("i", 1, "A", 2000), ("i", 2, "A", None), ("i", 3, "B", 2001), ("j", 4, "", 1)], "identity string, ref_id long, title string, year int")
    assert sorted(tuple(r) for r in library.merge_conflicts(rows, ("title", "year")).collect()) == [("i", "title", "A", "B"), ("i", "year", "2000", "2001")]

    log = library.edit_log(spark.createDataFrame([(1, "t", "a", 1), (1, "t", "a", 2), (1, "t", None, 3), (1, "t", "b", 4)], "ref_id long, field string, value string, at long"))
    assert [tuple(r)[2:] for r in log.orderBy("from_at").collect()] == [("a", 1, 3), (None, 3, 4), ("b", 4, None)]

    near = spark.createDataFrame([("title:x:1", "B", False), ("doi:1", "C", False), ("title:y:2", "a", True), ("arxiv:2", None, False)], "identity string, title string, in_library boolean")
    assert [r.identity for r in library.neighbours_in_order(near).collect()] == ["title:y:2", "arxiv:2", "doi:1", "title:x:1"]


def test_close_titles(spark):
    asked = [(1, "attention is all you need"), (2, "a very different title"), (3, "")]
    hits = [(1, 5, "attention is all you needed"), (1, 4, "attention is all you needed"), (1, 6, "attention is what you want"), (2, 7, "nothing alike"), (3, 8, "")]
    got = library.close_titles(spark.createDataFrame(asked, "ask_id long, title_key string"), spark.createDataFrame(hits, "ask_id long, ref_id long, title_key string")).collect()
    assert [(r.ask_id, r.ref_id, r.ratio) for r in got] == [(1, 4, difflib.SequenceMatcher(None, asked[0][1], hits[0][2]).ratio())]
