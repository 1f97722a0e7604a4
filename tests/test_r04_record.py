"""Means next to a half are rounded as SQL rounds doubles."""

import os

from tests.oracle import check
from tracewright.plans.registry import ORACLE_SQL
from tracewright.plans.stating import record_plan


def test_means_just_below_a_half(spark, tmp_path):
    """Scaled by a thousand, some of these are halves as doubles, though each is below a half as spelled."""
    values = [0.058499999999999996, 0.10149999999999999, 0.0495, 0.05049999999999997, 0.0585, 20.014499999999998]
    rows = [(k, x, q) for k, (x, q) in enumerate(zip(values, reversed(values), strict=True))]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "out"))
    part = next(f for f in os.listdir(tmp_path / "out") if f.endswith(".parquet"))
    (tmp_path / "t").mkdir()
    os.rename(tmp_path / "out" / part, tmp_path / "t" / "lineitem.parquet")
    assert check(record_plan(spark, str(tmp_path / "t")), ORACLE_SQL["record_plan"], str(tmp_path / "t")) == 12
