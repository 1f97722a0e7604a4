"""Global ranks without one window over everything.

Scores are counted first, so equal ones are one row. A table of up to
``RANGE_ROWS`` rows is ranked in one window; a larger one is dealt into ranges of
about that many distinct scores, by approximate quantiles, and the rows before each range
are added. A score that many rows share is dealt into ranges of its tie column
in the same way. Null scores (and NaN with them) rank after all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1 << 18


def _range(rows: DataFrame, n: int, column: str, descending: bool):
    """The number of the range that a row's value falls into; nulls into the last."""
    k = -(-n // RANGE_ROWS)
    cuts = sorted(set(rows.approxQuantile(column, [i / k for i in range(1, k)], 0.25 / k))) if k > 1 else []
    if not cuts:
        return F.lit(0)
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col(column) if descending else c < F.col(column)))
    return F.when(F.col(column).isNull(), len(cuts) + 1).otherwise(above)


def _before(parts: DataFrame, by: list[str], order: str, n: str) -> DataFrame:
    """parts with _before: the sum of n of the earlier rows; a row for each range."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", F.coalesce(F.sum(n).over(w), F.lit(0)))


def _score_places(rows: DataFrame, score: str) -> DataFrame:
    """_score, _n and _first: how many rows have a score, and how many stand before them."""
    clean = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    counts = rows.groupBy(clean.alias("_score")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = counts.withColumn("_range", _range(counts, counts.count(), "_score", descending=True))
    starts = _before(dealt.groupBy("_range").agg(F.sum("_n").alias("_rows")), [], "_range", "_rows").select("_range", "_before")  # a row per range
    w = Window.partitionBy("_range").orderBy(F.desc_nulls_last("_score")).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(starts), "_range").select("_score", "_n", (F.coalesce(F.sum("_n").over(w), F.lit(0)) + F.col("_before")).alias("_first"))


def positions(rows: DataFrame, score: str, tie: str, out: str = "rank") -> DataFrame:
    """0 for the highest score, ties by the tie column (a number if large tables have common scores), nulls last."""
    n = rows.count()
    clean = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    if n <= RANGE_ROWS:
        return rows.withColumn("_score", clean).withColumn(out, F.row_number().over(Window.orderBy(F.desc_nulls_last("_score"), tie)) - 1).drop("_score")
    numeric = rows.schema[tie].dataType.typeName() in ("integer", "long", "double", "float", "short", "byte")
    dealt = rows.withColumns({"_score": clean, "_part": _range(rows, n, tie, descending=False) if numeric else F.lit(0)})
    parts = dealt.groupBy("_score", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    parts = _before(parts, ["_score"], "_part", "_rows").select(F.col("_score").alias("_s"), F.col("_part").alias("_p"), "_before")
    places = _score_places(rows, score).select(F.col("_score").alias("_t"), "_first")
    starts = parts.join(places, F.col("_s").eqNullSafe(F.col("_t"))).select("_s", "_p", (F.col("_before") + F.col("_first")).alias("_start"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_score", "_part").orderBy(tie)) - 1)
    ranked = own.join(starts, F.col("_score").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    return ranked.withColumn(out, F.col("_start") + F.col("_own")).drop("_score", "_part", "_s", "_p", "_own", "_start")


def average_ranks(rows: DataFrame, score: str, out: str = "avg_rank") -> DataFrame:
    """0 for the highest score; equal scores share the mean of their places, nulls (last) too."""
    places = _score_places(rows, score).select(F.col("_score").alias("_s"), (F.col("_first") + (F.col("_n") - 1) / 2).cast("double").alias(out))
    clean = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    return rows.withColumn("_score", clean).join(places, F.col("_score").eqNullSafe(F.col("_s"))).drop("_score", "_s")
