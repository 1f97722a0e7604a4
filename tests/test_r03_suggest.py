"""Suggested sources: a user meets classes of tags, not each tag with each source that holds it."""

from tests.test_r03_growth import _rows_joined
from tracewright.operators import feed


def _tables(spark):
    clicks = [(u, i, int((u + i) % 3 > 0)) for u in range(30) for i in range(40) if (u * i) % 7 == 1]
    tags = [(i, f"t{i}-{k}" if k % 2 else f"c{k}" if k % 8 else f"d{k}-{i % 5}") for i in range(60) for k in range(80)]
    sources = [(i, f"s{i % 9}" if i % 10 else None) for i in range(58)]
    return spark.createDataFrame(clicks, "user_id long, item_id long, useful int"), spark.createDataFrame(tags, "item_id long, tag string"), spark.createDataFrame(sources, "item_id long, source string")


def test_scores(spark):
    clicks, tags, sources = (df.collect() for df in _tables(spark))
    of_item, source, want = {}, dict(map(tuple, sources)), []
    for i, t in tags:
        of_item.setdefault(i, set()).add(t)
    held = {}
    for i, s in source.items():
        held.setdefault(s, set()).update(of_item[i])
    for u in {c.user_id for c in clicks}:
        liked = set().union(*(of_item[c.item_id] for c in clicks if c.user_id == u and c.useful))
        has = {source[c.item_id] for c in clicks if c.user_id == u} - {None}
        scores = [(u, s, len(liked & tags)) for s, tags in held.items() if s not in has and liked & tags]
        want += sorted(scores, key=lambda r: (-r[2], r[1] is not None, r[1] or ""))[:5]
    got = [tuple(r) for r in feed.suggest_sources(*_tables(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and got


def test_users_meet_classes(spark):
    assert _rows_joined(feed.suggest_sources(*_tables(spark))) < 8000
