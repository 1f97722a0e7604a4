"""Claims against the ledger: lookups that refuse to guess, tolerance coverage, agreement and preregistered pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Claimed numbers are dealt into cells of this width, so that coverage is an equi-join.
CELL = 0.5


def matching_runs(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """claim_id, n_runs, run_id (the least): runs of that name, or with that prefix where it ends in *. Every prefix of a run's name is a key, so that patterns are looked up by equality."""
    exact = claims.filter(~F.col("run").endswith("*")).select("claim_id", F.col("run").alias("name"))
    plain = exact.join(runs.select("name", "run_id"), "name").groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_runs"), F.min("run_id").alias("run_id"))
    wild = claims.filter(F.col("run").endswith("*")).select("claim_id", F.expr("left(run, length(run) - 1)").alias("prefix"))
    prefixes = wild.select("prefix").distinct()
    cut = runs.select("run_id", "name", F.explode(F.sequence(F.lit(0), F.length("name"))).alias("n")).select("run_id", F.expr("left(name, n)").alias("prefix"))
    found = prefixes.join(cut, "prefix").groupBy("prefix").agg(F.count(F.lit(1)).alias("n_runs"), F.min("run_id").alias("run_id"))
    return plain.unionByName(wild.join(found, "prefix").select("claim_id", "n_runs", "run_id"))


def verdicts(claims: DataFrame, runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """claim_id, verdict, actual. Several runs or rows are ambiguous: the nearest value is never picked."""
    found = matching_runs(claims, runs)
    asked = claims.join(found, "claim_id", "left")
    rows = asked.filter("n_runs = 1").select("claim_id", "run_id", "metric", F.col("split").alias("s"), F.col("step").alias("k"))
    hits = rows.join(metrics, ["run_id", "metric"]).filter((F.col("s").isNull() | (F.col("s") == F.col("split"))) & (F.col("k").isNull() | (F.col("k") == F.col("step"))))
    hits = hits.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("value").alias("actual"))
    verdict = (F.when(F.col("n_runs").isNull(), "unsupported").when(F.col("n_runs") > 1, "ambiguous").when(F.col("n_rows").isNull(), "unsupported").when(F.col("n_rows") > 1, "ambiguous")
               .when(F.abs(F.col("actual") - F.col("value")) > F.col("tol"), "contradicted").when(F.col("evidence_moved"), "stale").otherwise("supported"))
    return asked.join(hits, "claim_id", "left").select("claim_id", verdict.alias("verdict"), F.when(F.col("n_rows") == 1, F.col("actual")).alias("actual"))


def uncovered(numbers: DataFrame, claimed: DataFrame) -> DataFrame:
    """doc_id, numbers, uncovered: a number is covered by a claim within its tolerance. Claims go into every cell that their tolerance reaches, and a little beyond, as sums are rounded."""
    tol = F.greatest("tol", F.lit(1e-9))
    cells = claimed.select("claimed", tol.alias("tol"), F.explode(F.sequence(F.floor((F.col("claimed") - tol) / CELL - 1e-6), F.floor((F.col("claimed") + tol) / CELL + 1e-6))).alias("cell"))
    own = numbers.select("value").distinct().withColumn("cell", F.floor(F.col("value") / CELL))
    covered = own.join(cells, "cell").filter(F.abs(F.col("value") - F.col("claimed")) <= F.col("tol")).select("value").distinct().withColumn("covered", F.lit(1))
    return numbers.join(covered, "value", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("numbers"), F.count_if(F.col("covered").isNull()).alias("uncovered"))


def corpus_agreement(runs: DataFrame) -> DataFrame:
    """Whether a family's runs share their corpus."""
    g = runs.groupBy("family").agg(F.count_distinct("corpus").alias("n_corpora"), F.count_if(F.col("corpus").isNull()).alias("unknown"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("agreement", F.when(F.col("unknown") == F.col("n"), "unknown").when(F.col("n_corpora") > 1, "differing").when(F.col("unknown") > 0, "partial").otherwise("shared"))


def judge_pairs(pooled: DataFrame, low: str, high: str, by: float, min_runs: int = 3) -> DataFrame:
    """Preregistered "low is below high by a margin", judged on intervals of two sd; too few runs have none."""
    lo, hi = F.col("mean") - 2 * F.col("sd"), F.col("mean") + 2 * F.col("sd")
    a = pooled.filter(F.col("arm") == low).select("family", F.col("arm").alias("low"), lo.alias("a0"), hi.alias("a1"), F.col("n_runs").alias("na"))
    b = pooled.filter(F.col("arm") == high).select("family", F.col("arm").alias("high"), lo.alias("b0"), hi.alias("b1"), F.col("n_runs").alias("nb"))
    bare = (F.col("na") < min_runs) | (F.col("nb") < min_runs)
    verdict = F.when(bare, "inconclusive").when(F.col("b0") - F.col("a1") >= by - 1e-9, "confirmed").when(F.col("b1") - F.col("a0") < by - 1e-9, "refuted").otherwise("inconclusive")
    return a.join(b, "family").select("family", "low", "high", verdict.alias("verdict"))
