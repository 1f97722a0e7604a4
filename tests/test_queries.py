"""Every query with SQL against DuckDB; those without by brute force on small tables."""

import random

import pytest
from pyspark.sql import functions as F

import tracewright.plans.drafts
import tracewright.plans.feed
import tracewright.plans.judging  # noqa: F401
import tracewright.plans.ledger
import tracewright.plans.library  # noqa: F401
import tracewright.plans.stating  # noqa: F401
import tracewright.plans.status
import tracewright.plans.upkeep  # noqa: F401
from tests.oracle import check
from tracewright.functions import text as X
from tracewright.operators import graph, ledger, library, ranking
from tracewright.plans.registry import ORACLE_SQL, QUERIES
from tracewright.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    check(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_bootstrap_stays_in_range():
    values = [0.1, 0.4, 0.2, 0.9]
    lo, hi = ledger.bootstrap_ci(values)
    assert min(values) <= lo < sum(values) / 4 < hi <= max(values) and ledger.bootstrap_ci(values) == (lo, hi)
    assert ledger.bootstrap_ci([0.5] * 3) == (0.5, 0.5)


@pytest.mark.parametrize(("name", "stem"), [("best_val_loss", "loss"), ("ndcg_at_10", "ndcg"), ("test_f1_macro", "f1"), ("val_", "val_"), ("top1_accuracy", "accuracy"), ("loss", "loss")])
def test_metric_stem(spark, name, stem):
    assert spark.range(1).select(ledger.metric_stem(F.lit(name))).first()[0] == stem


def test_split_rank(spark):
    rows = spark.createDataFrame([("test",), ("VAL_clean",), (None,), ("other",), ("training",)], "s string")
    assert [r[0] for r in rows.select(ledger.split_rank(F.col("s"))).collect()] == [0, 2, 7, 7, 8]


def path_counts(near, source, target):
    """All shortest paths between two nodes."""
    level, done = [[source]], {source}
    while level:
        hit = [p for p in level if p[-1] == target]
        if hit:
            return hit
        level = [[*p, w] for p in level for w in near[p[-1]] if w not in done]
        done |= {p[-1] for p in level}
    return []


def test_betweenness(spark):
    rng = random.Random(1)
    names = [f"n{i}" for i in range(9)]
    pairs = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(12)})
    near = {n: [] for n in names}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    want = dict.fromkeys(names, 0.0)
    for i, s in enumerate(names):
        for t in names[i + 1 :]:
            paths = path_counts(near, s, t)
            for p in paths:
                for v in p[1:-1]:
                    want[v] += 1 / len(paths)
    got = dict(graph.betweenness(spark.createDataFrame([(*p, 2) for p in pairs], "a string, b string, weight long")).collect())
    assert all(abs(want[n] - got.get(n, 0)) < 1e-9 for n in names)


def test_communities(spark):
    cliques = [(a, b, 5) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w", 1)]
    got = dict(graph.communities(spark.createDataFrame(cliques, "a string, b string, weight long")).collect())
    assert len(set(got.values())) == 2 and len({got[c] for c in "abcd"}) == 1


def test_ranks_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randint(0, 20))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, s double")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert {r.id: r["rank"] for r in ranking.positions(df, "s", "id").collect()} == {r[0]: k for k, r in enumerate(order)}
    places = {}
    for k, r in enumerate(order):
        places.setdefault(r[1], []).append(k)
    assert {r.id: r.avg_rank for r in ranking.average_ranks(df, "s").collect()} == {i: sum(places[s]) / len(places[s]) for i, s in rows}


def test_identifiers(spark):
    rows = [("https://doi.org/10.1/ABC", "arXiv:2106.02347v3 [cs.LG]"), ("doi: 10.48550/arXiv.1", " "), (None, None)]
    r = spark.createDataFrame(rows, "d string, a string").select(X.normalise_doi(F.col("d")), X.normalise_arxiv(F.col("a"))).collect()
    assert [tuple(x) for x in r] == [("10.1/abc", "2106.02347"), (None, None), (None, None)]
    assert spark.range(1).select(X.normalise_title(F.lit("Ünder  the Séa!"))).first()[0] == "under the sea"
    assert library.export_keys(spark.createDataFrame([(1, "a b", 2000), (2, "a c", 2000), (3, "", None)], "ref_id long, title_key string, year int")).count() == 3


def test_text():
    t = "One, e.g. two. Three!  Four\n\nFive"
    assert [t[a:b] for a, b in X.sentence_spans(t)] == ["One, e.g. two.", "Three!", "Four", "Five"]
    assert X.sentence_spans("") == []


def test_family(spark):
    names = ["clf_knn_seed3", "eval_step_22000", "dit_small_rope", "single", "run_a"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.family_of(F.col("n"))).collect()]
    assert got == ["clf", "eval", "dit-small", None, "run"]


def test_stream_of_jobs(spark, tmp_path):
    states = [(1, 1, "submitted"), (1, 2, "running"), (2, 1, "running"), (2, 2, "submitted"), (1, 3, "submitted"), (1, 4, "complete")]
    spark.createDataFrame([(k, n, n, s) for k, n, s in states], "run_id long, ts long, event_id long, state string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("run_id long, ts long, event_id long, state string").parquet(f"{tmp_path}/in")
    q = jobs.track_jobs(stream).writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("jobs").collect()} == {(1, "complete", 1), (2, "submitted", 1)}


def test_stream_dedup_and_sessions(spark, tmp_path):
    spark.sql("SELECT 1L AS k, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1, timestamp'2024-01-01 00:10:00' UNION ALL SELECT 2, timestamp'2024-01-01 05:00:00'").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, ts timestamp").parquet(f"{tmp_path}/in")
    q = jobs.dedup_stream(stream, ["k"]).writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.k for r in spark.table("once").collect()) == [1, 2]
    assert jobs.idle_sessions(spark.read.parquet(f"{tmp_path}/in"), "k").count() == 2


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
