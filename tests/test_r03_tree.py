"""The include tree beyond the rows that a recursive query may have."""

from __spark_entry__ import oracle_sql, queries
from tests.oracle import check

SF = "/root/testdata/sf0.01"


def test_no_limit_of_rows(spark):
    key = "spark.sql.cteRecursionRowLimit"
    was = spark.conf.get(key)
    spark.conf.set(key, "100")
    try:
        assert check(queries()["include_tree"](spark, SF), oracle_sql()["include_tree"], SF) > 1000
    finally:
        spark.conf.set(key, was)
