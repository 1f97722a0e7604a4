"""Artifact readers on small files."""

import hashlib
import json

from pyspark.sql import functions as F

from tracewright.sources import artifacts as A


def put(folder, name, text):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_json(spark, tmp_path):
    put(tmp_path, "a/flat.json", json.dumps({"wer": 0.2, "seed": 3, "name": "x", "bad": None}))
    put(tmp_path, "a/nested.json", json.dumps({"test": {"acc": 0.5}, "epoch": 2}))
    put(tmp_path, "b/log.jsonl", '{"step": 1, "loss": 3.0}\n{"step": 2, "loss": 2.0}\n{"step": 3, "lo')
    put(tmp_path, "b/samples.json", json.dumps([{"wer": 1.0}, {"wer": 3.0}]))
    put(tmp_path, "b/table.json", json.dumps({f"k{i}": i for i in range(100)}))
    rows = A.read_json(spark, str(tmp_path)).collect()
    got = {(r.path.rsplit("/", 1)[1], r.metric, r.step, r.split, r.value) for r in rows if r.metric}
    assert got == {("flat.json", "wer", None, None, 0.2), ("flat.json", "seed", None, None, 3.0), ("nested.json", "acc", 2, "test", 0.5), ("log.jsonl", "loss", 1, None, 3.0), ("log.jsonl", "loss", 2, None, 2.0), ("samples.json", "wer", None, None, 2.0), ("samples.json", "wer_sd", None, None, 1.0), ("samples.json", "wer_n", None, None, 2.0)}
    assert [r.problem for r in rows if r.problem] == ["1 lines don't parse"]


def test_files_of_many_lines(spark, tmp_path):
    put(tmp_path, "a.json", json.dumps({"test": {"acc": 0.5}, "epoch": 2}, indent=2))
    assert [(r.metric, r.step, r.split, r.value, r.problem) for r in A.read_json(spark, str(tmp_path)).collect()] == [("acc", 2, "test", 0.5, None)]
    put(tmp_path, "l.bib", "@article{k1,\n  title = {A\n Title},\n  year = 2020\n}\n")
    assert A.read_bibtex(spark, str(tmp_path)).first().fields == {"title": "A\n Title", "year": "2020"}
    put(tmp_path, "d.md", "<!-- claim: p/run1\n metric=wer value=0.5 -->")
    assert A.read_claims(spark, str(tmp_path)).first().claimed == 0.5
    put(tmp_path, "t.tex", "\\cite{k1,\nk2} 5\\% % \\cite{no}\n")
    assert sorted(r.key for r in A.read_citations(spark, str(tmp_path)).collect()) == ["k1", "k2"]


def test_csv(spark, tmp_path):
    put(tmp_path, "r.csv", "config,wer,axis\na,0.5,x\nb,nan,1\n")
    assert {(r.run, r.metric, r.value) for r in A.read_csv(spark, str(tmp_path), "config").collect()} == {("a", "wer", 0.5), ("b", "axis", 1.0)}


def test_mlflow(spark, tmp_path):
    put(tmp_path, "0/r1/metrics/loss", "100 3.0 1\n200 2.0 2\n150 2.5 2\n")
    put(tmp_path, "0/r1/params/lr", "0.1")
    points = A.read_mlflow(spark, str(tmp_path))
    assert points.count() == 3 and [tuple(r) for r in A.latest(points).collect()] == [("0", "r1", "loss", 2.0)]


def test_names(spark):
    rows = spark.createDataFrame([("/x/lr=0.1,seed=3,a=b/run.json", "eval_step_5k"), ("/x/plain/run.json", "final")], "p string, s string")
    got = rows.select(A.arm_of(A.overrides(F.col("p"))), A.step_of(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("a=b,lr=0.1", 5000), (None, None)]


def test_manifest(spark, tmp_path):
    put(tmp_path, "d/x.txt", "abc")
    r = A.manifest(spark, str(tmp_path)).first()
    assert (r.bytes, r.sha256) == (3, hashlib.sha256(b"abc").hexdigest())


def test_bibtex(spark, tmp_path):
    put(tmp_path, "l.bib", '@article{k1, title = {A {Nested} Title}, year = 2020, author = "B, C"}\n@book{k2, title = {Broken\n')
    rows = {r.key: r for r in A.read_bibtex(spark, str(tmp_path)).collect()}
    assert rows["k1"].fields == {"title": "A {Nested} Title", "year": "2020", "author": "B, C"} and rows["k1"].problem is None
    assert rows["k2"].problem


def test_drafts(spark, tmp_path):
    put(tmp_path, "d.md", "x <!-- claim: p/run1 metric=WER value=0.5 tol=0.01 -->\n<!-- claim: nonsense -->")
    rows = A.read_claims(spark, str(tmp_path)).collect()
    assert [(r.project, r.run, r.metric, r.claimed, r.tol, r.problem) for r in rows] == [("p", "run1", "wer", 0.5, 0.01, None), (None, None, None, None, 0.0, "malformed")]
    put(tmp_path, "t.tex", "a \\cite{k1, k2} % \\cite{no}\n\\citep[p.~3]{k3}")
    assert sorted(r.key for r in A.read_citations(spark, str(tmp_path)).collect()) == ["k1", "k2", "k3"]


def test_feed(spark):
    body = "<rss><channel><item><guid>g1</guid><link>u</link><title>t</title><description>d</description></item><item><guid>g2</guid></item></channel></rss>"
    rows = A.parse_feed(spark.createDataFrame([(body,)], "body string")).collect()
    assert [r.guid for r in rows] == ["g1", "g2"] and rows[0].summary == "d"
