"""The ten rules on run directories that the test writes."""

import hashlib
import json

from tracewright.functions.records import canonical_json
from tracewright.sources import conformance, records
from tests.test_records import PREFIX, run

A, B, C = (f"2026-01-01T0{i}:00:00Z" for i in range(3))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def state(last="complete", **changes):
    moves = [("submitted", A), ("running", B)] + ([(last, C)] if last != "running" else [])
    return {"schema": f"{PREFIX}.state/1", "run_id": "r1", "backend": "local", "job_id": "1", "state": moves[-1][0], "updated_at": moves[-1][1], "message": None, "history": [{"state": s, "at": t} for s, t in moves]} | changes


def folder(root, name, record=None, outputs=None, listed=None, bind=True, history=None, declared=None, job=None, manifest=None, raw=None):
    """Writes a run's files. What isn't given conforms."""
    outputs = {"out/model.bin": "weights", "log.txt": "lines"} if outputs is None else outputs
    files = dict(outputs)
    record = run(metrics=[], data=[]) | (record or {})
    body = manifest or canonical_json({"schema": f"{PREFIX}.digests/1", "files": {k: sha(v) for k, v in outputs.items()} if listed is None else listed})
    files[f"{PREFIX}/digests.json"] = body
    if bind:
        record["data"] = [*record["data"], {"name": f"{PREFIX}/digests.json", "sha256": sha(body) if bind is True else bind, "role": "manifest"}]
    if history is not None:
        files[f"{PREFIX}/history.jsonl"] = history
        record["history"] = {"path": f"{PREFIX}/history.jsonl", "sha256": sha(history), "series": 1, "points": 2} | (declared or {})
    files[f"{PREFIX}/run.json"] = canonical_json(record) if raw is None else raw
    files[f"{PREFIX}/state.json"] = canonical_json(job or state())
    for k, v in files.items():
        path = root / name / k
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(v if isinstance(v, bytes) else v.encode())


def test_rules(spark, tmp_path):
    line = lambda **x: canonical_json(x)
    curve = "\n".join([line(schema=f"{PREFIX}.history/1"), line(series=0, name="loss", split="train"), line(series=0, step=1, value=0.5), line(series=0, step=2, value=0.25)]) + "\n"
    put = lambda name, **kw: folder(tmp_path, name, **kw)
    put("good"), put("with space", history=curve), put("curve", history=curve), put("bad space", history=curve + "{")
    put("cut", raw='{"schema": "ledge'), put("bytes", raw=b"\xff\xfe"), put("twice", raw='{"schema":"a","schema":"b"}'), put("arm", record={"arm": " "})
    put("spaced", raw=json.dumps(run(metrics=[], data=[])))
    put("missing", listed={"out/model.bin": sha("weights"), "log.txt": sha("lines"), "gone.txt": sha("")}), put("unlisted", listed={"out/model.bin": sha("weights")}), put("changed", listed={"out/model.bin": sha("other"), "log.txt": sha("lines")})
    put("unbound", bind=False), put("bound", bind="0" * 64), put("shape", manifest=canonical_json({"files": {}})), put("hex", listed={"log.txt": "abc"}), put("broken", manifest="{"), put("flat", manifest=canonical_json({"files": 3, "schema": f"{PREFIX}.digests/1"}))
    put("points", history=curve, declared={"points": 3}), put("digest", history=curve, declared={"sha256": "0" * 64}), put("back", history=curve.replace('"step":2', '"step":1')), put("tail", history=curve + '{"series":0,"st')
    put("loose", history=curve), put("nocurve", record={"history": {"path": f"{PREFIX}/history.jsonl", "sha256": "0" * 64, "series": 0, "points": 0}})
    (tmp_path / "loose" / PREFIX / "run.json").write_text((tmp_path / "good" / PREFIX / "run.json").read_text())
    put("other", job=state(run_id="r2")), put("jump", job=state(history=[{"state": "submitted", "at": A}, {"state": "complete", "at": C}])), put("failed", job=state("failed")), put("running", job=state("running")), put("unsaid", record={"status": None})
    put("gone"), (tmp_path / "gone" / PREFIX / "run.json").unlink()
    dependency = lambda s: {"dependencies": [{"name": "x", "version": "1", "source": s}, {"name": "y", "version": "1", "source": "index:main"}]}
    put("ftp", record=dependency("ftp somewhere")), put("query", record=dependency("url:https://x.org/a.whl?x=1"))
    put("key", record={"config": {"db_password": "hunter2", "hidden": {"api-key": "${KEY}", "where": ["https://me:pw@x.org/"]}}})
    put("space", record={"ext": {"Bad Name": {}, PREFIX: {}, "ok.deep": {"a": 1}, "flat": 3}})
    put("job", record={"config": {"lr": 0.5}, "family": "g"})
    root = f"file://{tmp_path}"
    specs = spark.createDataFrame([(f"file:{tmp_path}/{n}", "r1", "f", "a", '{ "lr": 0.10 }') for n in ("job", "good")], "run_dir string, run_id string, family string, arm string, config string")
    found = conformance.violations(spark, root, PREFIX, specs)
    got = {}
    for r in found.collect():
        got.setdefault(r.run_dir.rsplit("/", 1)[1], set()).add((r.rule, r.file, r.json_path))
    record, said, listed, curves = "run.json", "state.json", "digests.json", "history.jsonl"
    assert got == {
        "cut": {("read", record, "$")}, "bytes": {("read", record, "$")}, "twice": {("read", record, "$")}, "arm": {("read", record, "$.arm")},
        "spaced": {("canonical", record, "$"), ("manifest", record, "$.data")},
        "missing": {("manifest", listed, '$.files["gone.txt"]')}, "unlisted": {("manifest", listed, '$.files["log.txt"]')}, "changed": {("manifest", listed, '$.files["out/model.bin"]')},
        "unbound": {("manifest", record, "$.data")}, "bound": {("manifest", record, "$.data[0].sha256")}, "shape": {("manifest", listed, "$")}, "hex": {("manifest", listed, '$.files["log.txt"]')}, "broken": {("manifest", listed, "$")}, "flat": {("manifest", listed, "$.files")},
        "points": {("history", record, "$.history.points")}, "digest": {("history", curves, "$")}, "back": {("history", curves, "line 4")}, "tail": {("history", curves, "$"), ("history", curves, "line 5")},
        "bad space": {("history", curves, "$"), ("history", curves, "line 5")}, "loose": {("history", curves, "$")}, "nocurve": {("history", curves, "$")},
        "other": {("state", said, "$.run_id")}, "jump": {("state", said, "$.history")}, "failed": {("terminal", said, "$.state")}, "unsaid": {("terminal", record, "$.status")}, "gone": {("terminal", said, "$.state")},
        "ftp": {("source", record, "$.dependencies[0].source")}, "query": {("source", record, "$.dependencies[0].source")},
        "key": {("credentials", record, "$.config.db_password"), ("credentials", record, "$.config.hidden.where[0]")},
        "space": {("ext-namespace", record, '$.ext["Bad Name"]'), ("ext-namespace", record, f"$.ext.{PREFIX}"), ("ext-namespace", record, "$.ext.flat")},
        "job": {("spec", record, "$.family"), ("spec", record, "$.config")},
    }
    reports = {r.run_dir.rsplit("/", 1)[1]: (r.ok, r.rules) for r in conformance.report(spark, root, PREFIX, found).collect()}
    assert reports["good"] == reports["curve"] == reports["with space"] == reports["running"] == (True, []) and reports["spaced"] == (False, ["canonical", "manifest"])


def test_no_run_directory(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert conformance.violations(spark, f"file://{tmp_path}", PREFIX).count() == 0
    assert records.run_records(spark, f"file://{tmp_path}", PREFIX).count() == 0
