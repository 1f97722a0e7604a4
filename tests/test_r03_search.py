"""Searches: pairs of literal hits and queries aren't shuffled."""

from tests.test_r03_growth import _rows_joined
from tracewright.operators import feed

N = 120


def _shuffled(df):
    """Rows that the shuffles of the run plan wrote."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        at = plan.pop()
        name = at.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(at.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            plan.append(at.plan())
            continue
        rows = at.metrics().get("shuffleRecordsWritten")
        total += rows.get().value() if rows.isDefined() else 0
        plan += [at.children().apply(i) for i in range(at.children().size())]
    return total


def _searched(spark):
    items = spark.range(N).selectExpr("id AS item_id", "CASE WHEN id % 3 = 0 THEN 'a needle' ELSE 'hay' END AS title", "CASE WHEN id % 2 = 0 THEN 'Needle' ELSE '' END AS summary")
    queries = spark.range(N).selectExpr("id AS query_id")
    semantic = spark.range(N).selectExpr("id AS query_id", "explode(array(id, (id + 1) % 120)) AS item_id").selectExpr("*", "CAST(item_id / 200 AS DOUBLE) AS similarity")
    own = spark.range(0, N, 5).selectExpr("id AS item_id", "0.5D AS profile_similarity")
    return feed.search_each(items, semantic, queries, own, "needle")


def test_pairs_of_literal_hits_and_queries(spark):
    got = {(r.query_id, r.item_id): (round(r.score, 9), r.how) for r in _searched(spark).collect()}
    want = {}
    for q in range(N):
        for i in range(N):
            t, b, s = i % 3 == 0, i % 3 == 0 or i % 2 == 0, i / 200 if i in (q, (q + 1) % N) else None
            if b or s is not None:
                score = 0.75 * min((s or 0) + (feed.TITLE_BOOST if t else feed.BODY_BOOST if b else 0), 1) + (0.25 * 0.5 if i % 5 == 0 else 0)
                want[q, i] = (round(score, 9), "both" if b and s is not None else "literal" if b else "semantic")
    assert got == want and _searched(spark).count() == len(want)


def test_pairs_are_not_shuffled(spark):
    pairs = _searched(spark)
    assert _rows_joined(pairs) > 8000
    assert _shuffled(pairs) < 2000


def test_a_block_scores_a_few_queries_at_a_time(spark, monkeypatch):
    vectors = spark.range(150).selectExpr("id AS item_id", "array(cos(id), sin(id)) AS embedding")
    queries = spark.range(0, 150, 2).selectExpr("id AS query_id", "array(cos(id), sin(id)) AS embedding")
    whole = sorted(map(tuple, feed.nearest_each(vectors, queries, 5).collect()))
    monkeypatch.setattr(feed, "SLICE", 4)  # fails where blocks aren't cut
    assert sorted(map(tuple, feed.nearest_each(vectors, queries, 5).collect())) == whole and len(whole) == 75 * 5
