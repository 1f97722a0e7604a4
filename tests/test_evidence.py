"""Lineage, untraced models, evaluation of clicks, claims in both kinds of drafts and both kinds of feeds, on rows written here."""

import pytest

from tracewright.operators import lineage
from tracewright.operators import verification as V
from tracewright.sources import artifacts as A


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_data_links(spark):
    inputs = spark.createDataFrame([("r", 0, "corpus/train", "c1"), ("r", 1, "corpus", None), ("r", 2, "corpus-b", None), ("r", 3, "corpus/x", "gone"), ("r", 4, "elsewhere", "gone"), ("r", 5, "y", "s1"), ("r", 6, "z", "f1"), ("r", 7, None, "f1")], "run_key string, pos int, name string, sha256 string")
    datasets = spark.createDataFrame([("A", "corpus", "c1"), ("B", "corpus", "c2"), ("C", "other", None)], "key string, dataset_id string, sha256 string")
    parts = spark.createDataFrame([("B", "split", "c1"), ("B", "split", "s1"), ("C", "file", "s1"), ("A", "file", "f1"), ("C", "file", "f1")], "dataset_key string, tier string, sha256 string")
    edges, issues = lineage.data_links(inputs, datasets, parts)
    assert rows(edges, "up", "down", "via") == [("A", "r", "content"), ("A", "r", "file"), ("B", "r", "split"), ("C", "r", "file")]
    assert rows(issues, "at", "kind", "severity") == [("data[1]", "undigested-data", "unverified"), ("data[3]", "dataset-digest-mismatch", "broken"), ("data[6]", "ambiguous", "unverified"), ("data[7]", "ambiguous", "unverified")]


def test_source_links(spark):
    datasets = spark.createDataFrame([("A", True), ("B", False)], "key string, recorded boolean")
    sources = [("A", 0, None, "one", "d1"), ("A", 1, "f", "one", "d1"), ("A", 2, None, "one", "no"), ("A", 3, "f", "none", "no"), ("A", 4, "f", "none", None), ("A", 5, None, "one", None), ("A", 6, "f", "two", None)]
    runs = spark.createDataFrame([("d1", None, "one"), ("d2", "f", "two"), ("d3", "f", "two")], "key string, family string, run_id string")
    edges, issues = lineage.source_links(datasets, spark.createDataFrame(sources, "dataset_key string, pos int, family string, run_id string, record_sha256 string"), runs)
    assert rows(edges, "up", "down") == [("d1", "A"), ("d2", "A"), ("d3", "A")]
    want = [("B", "source_runs", "unrecorded-source-runs")]
    want += [("A", f"source_runs[{i}]", k) for i, k in [(1, "source-run-identity-mismatch"), (2, "source-run-digest-mismatch"), (3, "missing-source-run"), (4, "missing-source-run"), (5, "undigested-source-run"), (6, "undigested-source-run"), (6, "ambiguous")]]
    assert rows(issues, "node", "at", "kind") == sorted(want)


def test_closure_ends_in_cycles_and_refuses_to_cut(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "b")], "up string, down string")
    roots = spark.createDataFrame([("a",), ("d",), ("a",)], "root string")
    assert rows(lineage.closure(edges, roots), "root", "node", "hops") == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("d", "d", 0)]
    assert lineage.closure(edges, roots.filter("root = 'x'")).isEmpty()
    with pytest.raises(ValueError, match="deeper"):
        lineage.closure(edges, roots, max_hops=1)


def test_untraced(spark):
    claims = spark.createDataFrame([(1, None), (2, "m"), (3, "m"), (4, "m"), (5, "broken"), (6, "absent")], "claim_id long, model string")
    traces = spark.createDataFrame([("m", None, None), ("broken", "no-producer", "no run made it")], "model string, kind string, message string")
    producers = spark.createDataFrame([("m", 1, "f/one", True), ("m", 2, "f/two", False)], "model string, run_id long, label string, made boolean")
    matches = spark.createDataFrame([(2, 2, "two"), (3, 3, "three"), (4, 3, "three"), (4, 4, "four"), (5, 1, "one")], "claim_id long, run_id long, name string")
    assert rows(lineage.untraced(claims, traces, producers, matches), "claim_id", "message") == [
        (3, "model m comes from f/one, and run three has none of its files"),
        (5, "model broken: [no-producer] no run made it"),
        (6, "model absent: no such model"),
    ]


def test_severity(spark):
    found = spark.createDataFrame([("supported", "p", 1), ("partial", "p", 9), ("contradicted", "p", 5), ("partial", "p", 2)], "verdict string, path string, line int")
    assert [r.line for r in lineage.by_severity(found).orderBy("place").collect()] == [5, 2, 9, 1]


def test_evaluation_of_clicks(spark):
    vectors = spark.createDataFrame([(i, [1.0 if i % 2 else -1.0, i / 40]) for i in range(40)], "item_id long, embedding array<double>")
    clicks = lambda label, n=40, source="ui": spark.createDataFrame([(i, label(i), source if i % 4 else "simulated") for i in range(n)], "item_id long, useful int, source string")
    found = V.evaluate_clicks(clicks(lambda i: i % 2), vectors)
    assert found["auc"] == 1.0 and found["n_clicks"] == 40 and 0.5 < found["provenance_auc"] <= 1.0
    assert V.evaluate_clicks(clicks(lambda i: 1), vectors) is None
    assert V.evaluate_clicks(clicks(lambda i: i % 2, 9), vectors) is None
    only = V.evaluate_clicks(clicks(lambda i: i % 2, source="bootstrap").filter("source = 'bootstrap'"), vectors)
    assert only is None


def test_pseudo_clicks(spark):
    vectors = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate([0.5, 0.9, -0.3, 0.9, -1.0])], "item_id long, embedding array<double>")
    who = spark.createDataFrame([(7, [1.0, 0.0]), (8, [-1.0, 0.0])], "user_id long, embedding array<double>")
    assert rows(V.pseudo_clicks(vectors, who, 2), "user_id", "item_id", "useful") == [(7, 1, 1), (7, 4, 0), (8, 1, 0), (8, 4, 1)]
    assert V.pseudo_clicks(vectors, who).groupBy("user_id", "useful").count().select("count").distinct().collect()[0][0] == 2
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(4)], "item_id long, embedding array<double>")
    assert V.pseudo_clicks(same, who).select("user_id", "item_id").distinct().count() == 8
    assert V.pseudo_clicks(vectors.limit(0), who).isEmpty()


def test_claims_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.md").write_text("Text\n\n<!-- claim: p/run-1 metric=Acc value=0.5 tol=0.01\n as_of=2024-01-02 step=7 split=test cite=key model=models:/m/3 -->\nx <!-- claim: p/run metric=acc -->\n<!-- claim: p/r metric=a value=1 tol=x -->")
    (tmp_path / "b.tex").write_text("One\n% claim: q/run* metric=loss value=2e-1\nA 5\\% claim: none\n\nwords % claim: q/r metric=loss value=3 step=x\n")
    found = {(r.path[-4:], r.line): r for r in A.read_claims(spark, str(tmp_path)).collect()}
    assert sorted(found) == [(".tex", 2), (".tex", 5), ("a.md", 3), ("a.md", 5), ("a.md", 6)]
    first = found[("a.md", 3)]
    assert (first.project, first.run, first.metric, first.claimed, first.tol, first.as_of, first.step, first.split, first.cite, first.model, first.problem) == ("p", "run-1", "acc", 0.5, 0.01, "2024-01-02", 7, "test", "key", "models:/m/3", None)
    assert (found[(".tex", 2)].run, found[(".tex", 2)].claimed, found[(".tex", 2)].problem) == ("run*", 0.2, None)
    assert all(found[k].problem == "malformed" for k in [("a.md", 5), ("a.md", 6), (".tex", 5)])


def test_atom_and_seeds(spark, tmp_path):
    atom = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>u:1</id><link rel="self" href="s"/><link href="h"/><title>T</title><content>C</content></entry><entry><id>u:2</id><link rel="self" href="only"/><title>V</title><summary>S</summary></entry></feed>'
    rss = "<rss><channel><item><guid>g</guid><link>l</link><title>R</title><description>D</description></item></channel></rss>"
    bodies = spark.createDataFrame([(atom,), (rss,), (None,)], "body string")
    assert rows(A.parse_feed(bodies), "guid", "url", "title", "summary") == [("g", "l", "R", "D"), ("u:1", "h", "T", "C"), ("u:2", "only", "V", "S")]
    (tmp_path / "feeds.toml").write_text('[[feeds]]\nurl = "a"\ntitle = "A"\n[[feeds]]\nurl = "b"\n[[feeds]]\nurl = "a"\ntitle = "again"\n[[feeds]]\nurl = "c"\n')
    assert rows(A.seed_feeds(spark, str(tmp_path / "feeds.toml"), spark.createDataFrame([("c",)], "url string")), "url", "title") == [("a", "A"), ("b", None)]
