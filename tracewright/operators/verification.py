"""Decisions about records: freshness of figures, conformance of runs, provenance tiers, settled jobs, and what clicks can teach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("complete", "failed", "cancelled")


def figure_freshness(figures: DataFrame) -> DataFrame:
    """figure, verdict for (figure, referenced, exists, made_at, source_at): missing, orphan, stale (older than its source) or fresh."""
    verdict = F.when(F.col("referenced") & ~F.col("exists"), "missing").when(~F.col("referenced"), "orphan").when(F.col("source_at") > F.col("made_at"), "stale").otherwise("fresh")
    return figures.select("figure", verdict.alias("verdict"))


def conformance(runs: DataFrame) -> DataFrame:
    """run_id, rule of every violation; a table per rule, put together. runs: run_id, status, started_at, finished_at, n_metrics, has_producer, config (text)."""
    from tracewright.functions.text import credentials

    rules = {
        "unknown status": ~F.col("status").isin("submitted", "running", *TERMINAL),
        "ends before it starts": F.col("finished_at") < F.col("started_at"),
        "terminal without an end": F.col("status").isin(*TERMINAL) & F.col("finished_at").isNull(),
        "complete without metrics": (F.col("status") == "complete") & (F.col("n_metrics") == 0),
        "no producer": ~F.col("has_producer"),
        "credential in config": credentials(F.col("config")) >= 0,
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda r: r.isNotNull())
    return runs.select("run_id", F.explode(broken).alias("rule"))


def settle_jobs(jobs: DataFrame) -> DataFrame:
    """run_id, state, ended for dead jobs (run_id, last_state, last_at, record_state, now): a terminal state stays, a record decides, without one the job has failed; the end is never before the last event."""
    terminal = F.col("last_state").isin(*TERMINAL)
    state = F.when(terminal, F.col("last_state")).when(F.col("record_state").isin(*TERMINAL), F.col("record_state")).otherwise("failed")
    return jobs.select("run_id", state.alias("state"), F.when(terminal, F.col("last_at")).otherwise(F.greatest("last_at", "now")).alias("ended"))


def lineage_tiers(entries: DataFrame, datasets: DataFrame) -> DataFrame:
    """run_id, sha256, dataset_id, tier for inputs (run_id, sha256): the digest of a dataset's content, else of a split, else of a file. datasets: dataset_id, tier, sha256."""
    order = F.array_position(F.array(F.lit("content"), F.lit("split"), F.lit("file")), F.col("tier"))
    hits = entries.join(datasets, "sha256").groupBy("run_id", "sha256").agg(F.min(F.struct(order.alias("o"), "dataset_id", "tier")).alias("b"))
    return entries.join(hits, ["run_id", "sha256"], "left").select("run_id", "sha256", "b.dataset_id", F.coalesce("b.tier", F.lit("unknown")).alias("tier"))


def model_producers(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """model, run_id, covered, issue: all runs whose outputs (run_id, sha256) cover most of a model's files (model, sha256)."""
    size = files.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    n = files.join(outputs.distinct(), "sha256").groupBy("model", "run_id").agg(F.count(F.lit(1)).alias("covered"))
    w = Window.partitionBy("model")
    best = n.withColumn("most", F.max("covered").over(w)).filter("covered = most").withColumn("runs", F.count(F.lit(1)).over(w)).join(size, "model")
    issue = F.when(F.col("runs") > 1, "ambiguous producer").when(F.col("covered") < F.col("n"), "partial output")
    return best.select("model", "run_id", "covered", issue.alias("issue"))


def click_classifier(clicks: DataFrame, vectors: DataFrame, c: float = 0.1):
    """The balanced classifier of judged items' vectors; None while only one class is there."""
    return balanced_fit(clicks.join(vectors, "item_id").select("useful", "embedding"), c)


def balanced_fit(judged: DataFrame, c: float = 0.1):
    """Logistic regression of useful (0 or 1) on embedding, classes weighted to balance; None while only one class is there. The penalty is 1 / (c n), as
    libraries that take an inverse strength define it."""
    from pyspark.ml.classification import LogisticRegression

    rows = judged.select(F.col("useful").cast("double").alias("label"), _features())
    n = dict(rows.groupBy("label").count().collect())
    if len(n) < 2:
        return None
    total = sum(n.values())
    weight = F.when(F.col("label") == 1.0, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0]))
    model = LogisticRegression(weightCol="w", regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=100)
    return model.fit(rows.withColumn("w", weight))


def _features():
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.col("embedding").cast("array<double>")).alias("features")


def classified(model, vectors: DataFrame) -> DataFrame:
    """item_id, p: how likely an item is useful."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(vectors.select("item_id", _features())).select("item_id", vector_to_array("probability")[1].alias("p"))


# Clicks of these sources come from the reader; others were generated for them.
HARVESTED = ("ui", "agent", "implicit")
FIT_ROWS = 20_000  # rows of a partition that folds are fitted on: passes over few rows cost their tasks, not their rows


def fold_auc(rows: DataFrame, label: str, folds: int) -> float | None:
    """Mean area under the curve of the click classifier over folds of rows (item_id, embedding, label column 0 or 1), None if a class is too small.

    Each class is dealt over the folds in the order of a hash of its items, so that folds hold equal shares of it; there are never more
    folds than members of the lesser class.
    """
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from tracewright.operators.ranking import positions

    n = dict(rows.groupBy(label).count().collect())  # two rows
    folds = min(folds, n.get(0, 0), n.get(1, 0))
    if folds < 2:
        return None
    own = rows.select("item_id", "embedding", F.col(label).alias("useful"), F.xxhash64("item_id").cast("double").alias("h"))
    parts = [positions(own.filter(F.col("useful") == c), "h", "item_id") for c in (0, 1)]
    dealt = parts[0].unionByName(parts[1]).select("embedding", "useful", (F.col("rank") % folds).alias("fold"))
    dealt = dealt.coalesce(1 + (n[0] + n[1]) // FIT_ROWS).persist()
    measure, out = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="useful"), []
    for k in range(folds):
        model = balanced_fit(dealt.filter(F.col("fold") != k))
        out.append(measure.evaluate(model.transform(dealt.filter(F.col("fold") == k).select(F.col("useful").cast("double").alias("useful"), _features()))))
    dealt.unpersist()
    return sum(out) / len(out)


def evaluate_clicks(clicks: DataFrame, vectors: DataFrame, n_holdout: int = 5, max_folds: int = 10) -> dict | None:
    """auc of one user's click classifier, and provenance_auc: how well the same model tells where a click came from. Bootstrap clicks don't count: their
    labels are a threshold of the same vectors. None for fewer than n_holdout + 5 clicks or one class. A fold holds n_holdout clicks out while that
    makes no more than max_folds fits; beyond, folds are larger and still hold every click out once. clicks: item_id (once each), useful, source."""
    real = clicks.filter("source <> 'bootstrap'").join(vectors.select("item_id", "embedding"), "item_id").withColumn("harvested", F.col("source").isin(*HARVESTED).cast("int")).persist()
    n = real.count()
    folds = min(max_folds, max(2, n // n_holdout))
    auc = fold_auc(real, "useful", folds) if n >= n_holdout + 5 else None
    out = None if auc is None else {"auc": auc, "n_clicks": n, "provenance_auc": fold_auc(real, "harvested", folds)}
    real.unpersist()
    return out


def pseudo_clicks(vectors: DataFrame, interests: DataFrame, k: int = 30) -> DataFrame:
    """user_id, item_id, useful, source = bootstrap: for each of interests (user_id, embedding) its k / 2 nearest vectors (item_id, embedding) as useful
    and the k / 2 farthest as not; an even number of all where there are fewer than k. For demonstrations, never for measuring."""
    from tracewright.operators.feed import nearest_each

    half = min(k, vectors.count()) // 2
    queries = interests.select(F.col("user_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    away = queries.withColumn("embedding", F.transform("embedding", lambda x: -x))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))  # at most k rows each
    top = nearest_each(vectors, queries, max(half, 1)).withColumn("place", place).filter(F.col("place") <= half)
    low = nearest_each(vectors, away, max(2 * half, 1)).join(top.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti").withColumn("place", place).filter(F.col("place") <= half)
    both = top.withColumn("useful", F.lit(1)).unionByName(low.withColumn("useful", F.lit(0)))
    return both.select(F.col("query_id").alias("user_id"), "item_id", "useful", F.lit("bootstrap").alias("source"))
