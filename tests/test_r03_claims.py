"""Numbers just at a claim's tolerance, against SQL."""

from __spark_entry__ import oracle_sql, queries
from tests.oracle import check


def test_numbers_at_the_tolerance(spark, tmp_path):
    texts = [f"{i / 100:.2f} and -{i / 100:.2f}" for i in range(5100)] + ["http://a.b/\x0b0.55 x 1.25 y", None, "none"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "all"))
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    own = tmp_path / "own"
    own.mkdir()
    (tmp_path / "documents.parquet").rename(own / "documents.parquet")
    assert check(queries()["claims_coverage"](spark, str(own)), oracle_sql()["claims_coverage"], str(own)) > 5000
