"""Joins, groups and shuffles that grow no faster than their rows."""

from __spark_entry__ import oracle_sql, queries
from tests.oracle import check
from tracewright.operators import ledger, library

SF = "/root/testdata/sf0.01"


def _rows_joined(df):
    """The most rows that an operator of the run plan gave out."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        at = plan.pop()
        if at.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan.append(at.executedPlan())
            continue
        if at.getClass().getSimpleName().endswith("QueryStageExec"):
            plan.append(at.plan())
            continue
        rows = at.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        plan += [at.children().apply(i) for i in range(at.children().size())]
    return most


def test_lookup_of_one_id_that_all_rows_share(spark):
    refs = spark.range(300).selectExpr("id AS ref_id", "'d' AS doi", "'a' AS arxiv", "'t' AS title_key", "CAST(2000 + id % 3 AS INT) AS year")
    asked = refs.withColumnRenamed("ref_id", "ask_id")
    found = library.lookup(asked, refs)
    assert {(r.ref_id, r.rung) for r in found.collect()} == {(0, 0)}
    assert _rows_joined(library.lookup(asked, refs)) < 5000
    by_title = library.lookup(asked.selectExpr("ask_id", "CAST(NULL AS STRING) AS doi", "CAST(NULL AS STRING) AS arxiv", "title_key", "year"), refs)
    assert {(r.ref_id, r.rung) for r in by_title.collect()} == {(0, 2), (1, 2), (2, 2)}


def test_first_rows_write_all_metrics(spark):
    rows = spark.createDataFrame([(1, 1, None, 2, 0.5, 7.0), (1, 1, None, 1, None, 8.0), (1, 2, "a", 3, 0.1, 9.0)], "run_id long, step int, split string, ord int, a double, b double")
    got = {tuple(r) for r in ledger.first_rows(rows, {"x": "a", "y": "b"}).collect()}
    assert got == {(1, "x", 1, None, None), (1, "y", 1, None, 8.0), (1, "x", 2, "a", 0.1), (1, "y", 2, "a", 9.0)}


def test_words_are_not_shuffled(spark):
    df = queries()["inverted_index_rebuild"](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert check(df, oracle_sql()["inverted_index_rebuild"], SF) > 500
