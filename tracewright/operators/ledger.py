"""Experiment ledger: which value a run is judged by, pooling of replicates, ranking and its caveats."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Splits in the order of trust, splits of training data, affixes of metric names, declared directions.
EVAL_SPLITS = ("test", "eval", "val", "valid", "validation", "dev", "holdout")
TRAIN_SPLITS = ("train", "training", "fit")
METRIC_PREFIXES = ("train_", "val_", "valid_", "test_", "eval_", "top1_", "best_", "final_")
METRIC_SUFFIXES = ("_macro", "_micro")
DIRECTIONS = {"loss": "lower_is_better", "acc": "higher_is_better", "wer": "lower_is_better", "accuracy": "higher_is_better", "ndcg": "higher_is_better", "f1": "higher_is_better"}

UNLABELLED = len(EVAL_SPLITS)


def split_rank(split: Column) -> Column:
    """How much a split is trusted, 0 the most; unlabelled and unknown ones stand between evaluation and training."""
    low = F.lower(split)
    out = F.when(split.isNull(), UNLABELLED)
    for i, name in enumerate(EVAL_SPLITS):
        out = out.when(low.startswith(name), i)
    trained = [low.startswith(t) for t in TRAIN_SPLITS]
    return out.when(trained[0] | trained[1] | trained[2], UNLABELLED + 1).otherwise(UNLABELLED)


def metric_stem(metric: Column) -> Column:
    """The metric's name without cutoff, prefixes (any number) and one suffix."""
    body = F.regexp_replace(metric, r"(.)(_at_\d+)+$", "$1")
    body = F.regexp_replace(body, rf"^({'|'.join(METRIC_PREFIXES)})+(?=.)", "")
    body = F.regexp_replace(body, r"(.)(_at_\d+)+$", "$1")
    return F.regexp_replace(body, rf"({'|'.join(METRIC_SUFFIXES)})$", "")


def direction_of(metric: Column) -> Column:
    """The declared direction of the metric or of its stem; null: refuse to rank by it."""
    declared = F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(declared, metric), F.try_element_at(declared, metric_stem(metric)))


def first_write_wins(rows: DataFrame, order: str = "ord") -> DataFrame:
    """One value per (run_id, metric, step, split); null keys count as equal. A grouped minimum combines within tasks, where a window would not."""
    return rows.groupBy("run_id", "metric", "step", "split").agg(F.min_by("value", order).alias("value"))


def first_rows(rows: DataFrame, values: dict[str, str], order: str = "ord") -> DataFrame:
    """The same where each row (run_id, step, split) writes all metrics of values (metric: column) at once: the first row is found once, not once for each metric."""
    first = rows.groupBy("run_id", "step", "split").agg(F.min_by(F.struct(*[F.col(c).alias(m) for m, c in values.items()]), order).alias("first"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"first.{m}").alias("value")) for m in values]))
    return first.select("run_id", "step", "split", each.alias("m")).select("run_id", "m.metric", "step", "split", "m.value")


def best_steps(values: DataFrame, lower: bool) -> DataFrame:
    """run_id, step, split, value: the best value of the most trusted split that a run has; ties go to the earliest step."""
    signed = F.col("value") if lower else -F.col("value")
    own = F.struct(F.col("value"), F.col("step"), F.col("split"))
    best = values.groupBy("run_id").agg(F.min_by(own, F.struct(split_rank(F.col("split")), signed, "step", "split")).alias("best"))
    return best.select("run_id", "best.step", "best.split", "best.value")


def pool_replicates(scored: DataFrame, keys: tuple[str, ...] = ("family", "arm")) -> DataFrame:
    """Mean, sample sd (0 for one run), extremes and members of the runs of an arm."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("split").alias("n_splits"), F.min(split_rank(F.col("split"))).alias("trust"))


def rank_arms(pooled: DataFrame, lower: bool) -> DataFrame:
    """rank within the family (1: best, ties by name), the gap to the next arm, Cohen's d against it, and caveats."""
    order = [F.col("mean") if lower else -F.col("mean"), F.col("arm")]
    w = Window.partitionBy("family").orderBy(*order)
    family = Window.partitionBy("family")
    nxt = lambda c: F.lead(c).over(w)
    out = pooled.withColumns({"rank": F.row_number().over(w), "gap": F.abs(nxt("mean") - F.col("mean")), "n2": nxt("n_runs"), "sd2": nxt("sd"), "n_arms": F.count(F.lit(1)).over(family), "family_trusts": F.size(F.collect_set("trust").over(family))})
    pooled_sd = F.sqrt(((F.col("n_runs") - 1) * F.col("sd") ** 2 + (F.col("n2") - 1) * F.col("sd2") ** 2) / (F.col("n_runs") + F.col("n2") - 2))
    d = F.when((F.col("n_runs") >= 2) & (F.col("n2") >= 2) & (pooled_sd > 0), F.col("gap") / pooled_sd)
    caveats = F.concat_ws("; ", F.when(F.col("n_arms") == 1, "only one arm"), F.when(F.col("family_trusts") > 1, "different splits"), F.when(F.col("trust") > UNLABELLED, "training split"), F.when(F.col("n_runs") < 2, "single run"), F.when(F.col("gap") < 0.05 * F.abs(F.col("mean")), "within 5 percent"))
    return out.select("family", "arm", "rank", "n_runs", "mean", "sd", "lo", "hi", "gap", d.alias("effect"), caveats.alias("caveats"))


def pool_vetoes(members: DataFrame, others: DataFrame | None = None, seed_keys: tuple[str, ...] = ("seed",)) -> DataFrame:
    """family, arm, veto, differing: why the runs of an arm must not be pooled, null if they may be; differing are the settings that say so.

    members: family, arm, name, seed, split, config (map of setting to its JSON; null where there is none, which is no disagreement).
    others: family, name of runs that belong to no arm. The first of these counts: another run already has the arm's name, a seed comes twice,
    the splits differ (none is a split of its own), settings other than seeds differ or are missing from some config."""
    names = members.select("family", "name", F.col("arm").alias("owner"))
    if others is not None:
        names = names.unionByName(others.select("family", "name", F.lit(None).cast("string").alias("owner")))
    clash = names.filter(~F.col("owner").eqNullSafe(F.col("name"))).select("family", F.col("name").alias("arm")).distinct().withColumn("taken", F.lit(True))
    arms = members.groupBy("family", "arm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seed").alias("seeds"), F.count_distinct(F.coalesce("split", F.lit(""))).alias("splits"), F.count("config").alias("configs"))
    settings = members.select("family", "arm", F.explode("config").alias("key", "value")).filter(~F.col("key").isin(*seed_keys))
    per_key = settings.groupBy("family", "arm", "key").agg(F.count(F.lit(1)).alias("said"), F.count_distinct(F.coalesce("value", F.lit("null"))).alias("values"))
    odd = per_key.join(arms.select("family", "arm", "configs"), ["family", "arm"]).filter("values > 1 OR said < configs").groupBy("family", "arm").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    whole = arms.join(clash, ["family", "arm"], "left").join(odd, ["family", "arm"], "left")
    veto = F.when(F.col("taken"), "a run has this name").when(F.col("seeds") < F.col("n"), "a seed twice").when(F.col("splits") > 1, "different splits").when(F.col("keys").isNotNull(), "different settings")
    return whole.select("family", "arm", veto.alias("veto"), F.when(veto == "different settings", F.array_join("keys", ",")).otherwise("").alias("differing"))


def last_values(rows: DataFrame) -> DataFrame:
    """The last value of each (run_id, metric), by (step, split), nulls first."""
    last = rows.groupBy("run_id", "metric").agg(F.max_by(F.struct("value", "step", "split"), F.struct(F.coalesce("step", F.lit(-1)), F.coalesce("split", F.lit("")))).alias("last"))
    return last.select("run_id", "metric", "last.value", "last.step", "last.split")


def nested_arms(rows: DataFrame) -> DataFrame:
    """run_id, metric, split, n for the runs whose splits are all nested (prefix.rest), none of them a known split, and several."""
    w = Window.partitionBy("run_id", "metric")
    ok = F.coalesce(F.col("split").contains(".") & (split_rank(F.col("split")) == UNLABELLED) & ~F.col("split").endswith("."), F.lit(False))
    grouped = rows.groupBy("run_id", "metric", "split").agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("ok"))
    return grouped.withColumns({"all_ok": F.bool_and("ok").over(w), "arms": F.count(F.lit(1)).over(w)}).filter("all_ok AND arms > 1").select("run_id", "metric", "split", "n")


def interleaved(rows: DataFrame, per: str, order: list, limit: int) -> DataFrame:
    """The first of every partition, then the second of every one, and so on up to limit."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(per).orderBy(*order)))
    return ranked.filter(F.col("turn") <= limit).orderBy("turn", per).limit(limit)


def bootstrap_ci(values: list[float], resamples: int = 2000, seed: int = 0, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean. The draws are int(random() * n) of Python's Mersenne Twister, value by value."""
    draw, n = random.Random(seed).random, len(values)
    means = sorted(math.fsum([values[int(draw() * n)] for _ in range(n)]) / n for _ in range(resamples))
    tail = (1.0 - level) / 2.0
    return means[math.floor(tail * resamples)], means[min(resamples, math.ceil((1.0 - tail) * resamples)) - 1]


def bootstrap_arms(scored: DataFrame, min_runs: int = 3) -> DataFrame:
    """family, arm, n_runs, ci_low, ci_high of arms with enough runs; one arm is one group."""
    import pandas as pd

    def run(key, pdf):
        values = pdf.sort_values("run_id")["value"].tolist()
        lo, hi = bootstrap_ci(values) if len(values) >= min_runs else (None, None)
        return pd.DataFrame({"family": [key[0]], "arm": [key[1]], "n_runs": [len(values)], "ci_low": [lo], "ci_high": [hi]})

    return scored.select("family", "arm", "run_id", "value").groupBy("family", "arm").applyInPandas(run, "family string, arm string, n_runs long, ci_low double, ci_high double")
