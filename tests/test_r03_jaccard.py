"""The nearest user by common words, against all pairs, and without a row for each pair."""

import random

import pytest

from tracewright.operators import feed


def nearest(sets):
    out = []
    for u, a in sets.items():
        best = max(((len(a & b) / len(a | b), -v) for v, b in sets.items() if v != u), default=(0, 0))
        if best[0] > 0:
            out.append((u, -best[1], best[0]))
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"rows": 16, "step": 7, "wide": 5}])
def test_against_all_pairs(spark, bounds):
    rng = random.Random(5)
    sets = {u: set(rng.sample(range(40), rng.randint(1, 12))) for u in range(120)}
    sets |= {200: {100, 101}, 201: {100, 101}, 199: {100, 101}, 300: {777}, 301: set(sets[3]) | {900}}
    rows = spark.createDataFrame([(u, w) for u, s in sets.items() for w in [*s, min(s)]], "user_id long, word long").repartition(3)
    assert sorted(map(tuple, feed.jaccard_nearest(rows, **bounds).collect())) == nearest(sets)
    assert feed.jaccard_nearest(rows.filter("user_id = 300")).isEmpty()


def test_no_row_for_each_pair(spark):
    words = spark.createDataFrame([(u, w) for u in range(50) for w in (0, u + 1)], "user_id long, word long")
    assert "SortMergeJoin [word" not in feed.jaccard_nearest(words)._jdf.queryExecution().toString()
    assert feed.jaccard_nearest(words).count() == 50
