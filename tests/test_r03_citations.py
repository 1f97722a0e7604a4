"""Rows that share a much-cited id: each gets its first neighbours and the true count, and doesn't meet all that cites the id."""

from tests.test_r03_growth import _rows_joined
from tracewright.operators import citations

N = 200


def _tables(spark):
    refs = spark.range(N).selectExpr("id AS ref_id", "'doi:d' || id AS identity", "'d' || id AS doi", "CASE WHEN id % 9 <> 0 THEN 'a' END AS arxiv", "'T' || id % 7 AS title", "'t' AS title_key", "2000 AS year")
    edges = refs.selectExpr("ref_id AS citing_id", "'arxiv:a' AS cited_identity", "'x' AS cited_title").unionByName(refs.filter("ref_id % 3 <> 0").selectExpr("ref_id AS citing_id", "'doi:d' || (ref_id % 5) AS cited_identity", "'x' AS cited_title"))
    edges = edges.filter("citing_id % 4 <> 0 OR cited_identity <> 'arxiv:a'")  # some cite a row by its DOI alone
    return refs, edges, spark.createDataFrame([], "alias string, ref_id long")


def test_cut_lists_are_those_of_whole_lists(spark):
    whole = [tuple(r) for r in citations.neighbours(*_tables(spark), most=None).collect()]
    columns = citations.neighbours(*_tables(spark), most=4).columns
    place, total = columns.index("place"), columns.index("total")
    cut = [tuple(r) for r in citations.neighbours(*_tables(spark), most=4).collect()]
    assert sorted(cut, key=str) == sorted((r for r in whole if r[place] <= 4), key=str)
    assert {r[total] for r in cut} >= {N - N // 4} and max(r[total] for r in cut) > N - N // 4


def test_a_shared_id_is_no_square(spark):
    assert _rows_joined(citations.neighbours(*_tables(spark), most=4)) < 10 * N
