"""Citations in both directions, under the names that papers had."""

import tracewright.plans.stating  # noqa: F401
from tests.oracle import check
from tracewright.operators import citations
from tracewright.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
REFS = [
    (1, "doi:10.1/a", "10.1/a", "2101.00001", "Beta", "beta", 2001), (2, "arxiv:2101.00002", None, "2101.00002", "alpha", "alpha", None), (3, "title:gamma:1999", None, None, "Gamma", "gamma", 1999),
    (4, "doi:10.1/d", "10.1/d", None, None, "", None), (5, "title:alpha:2005", None, None, "Alpha 5", "alpha", 2005),
]
EDGES = [
    (3, "arxiv:2101.00001", "x"), (3, "doi:10.1/a", "x"), (3, "title:alpha:2005", "x"), (3, "title:alpha:1990", "x"), (3, "title:nobody:-", "Zeta"), (3, "doi:10.9/q", "Yota"), (3, "doi:10.9/q", "Yota"),
    (3, "doi:10.1/gone", "x"), (3, "title::2001", None), (3, None, "x"), (4, "doi:10.1/a", None), (9, "doi:10.1/a", None), (4, "title:gamma:-", None),
]


def tables(spark, edges=EDGES):
    return (spark.createDataFrame(REFS, "ref_id long, identity string, doi string, arxiv string, title string, title_key string, year int"), spark.createDataFrame(edges, "citing_id long, cited_identity string, cited_title string"),
            spark.createDataFrame([("doi:10.1/gone", 4), ("doi:10.1/a", 5)], "alias string, ref_id long"))


def test_neighbours(spark):
    rows = citations.neighbours(*tables(spark), most=None).orderBy("ref_id", "direction", "place").collect()
    got = {}
    for r in rows:
        got.setdefault((r["ref_id"], r["direction"]), []).append((r["identity"], r["other_id"]))
    # In the library: two by title (no row of 1990, so the one without a year), then ids by title of their rows; an alias leads to a row without a title.
    assert got[(3, "cites")] == [("doi:10.1/gone", 4), ("arxiv:2101.00001", 1), ("doi:10.1/a", 1), ("title:alpha:1990", 2), ("title:alpha:2005", 5), ("doi:10.9/q", None), ("title::2001", None), ("title:nobody:-", None)]
    assert got[(4, "cites")] == [("doi:10.1/a", 1), ("title:gamma:-", 3)]
    assert got[(1, "cited_by")] == [("doi:10.1/d", 4), ("title:gamma:1999", 3)] and got[(5, "cited_by")] == [("title:gamma:1999", 3)]
    assert (3, "cited_by") not in got and (2, "cited_by") not in got  # names by title aren't looked for backwards, unless they are the identity


def test_lists_are_cut_and_counted(spark):
    edges = [(3, f"doi:10.8/{i}", f"t{i:02}") for i in range(30)]
    rows = citations.neighbours(*tables(spark, edges), most=4).orderBy("place").collect()
    assert [(r["title"], r["total"]) for r in rows] == [(f"t{i:02}", 30) for i in range(4)]
    assert citations.neighbours(*tables(spark, edges[:0])).count() == 0


def test_against_sql(spark):
    assert check(QUERIES["citation_neighbours"](spark, SF), ORACLE_SQL["citation_neighbours"], SF) > 50
