"""Passages of a source that bear on a claim: an inverted index of stems picks them, vectors reorder them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.functions.vectors import dot


def stem_index(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, stem: each content stem of a row's text once."""
    words = texts.select(*keys, F.explode(X.words(F.col("text"))).alias("w")).select(*keys, F.lower("w").alias("w")).filter(~F.col("w").isin(X.STOPWORDS))
    return words.select(*keys, X.stem(F.col("w")).alias("stem")).distinct()


def _best(rows: DataFrame, score: str, k: int) -> DataFrame:
    w = Window.partitionBy("claim_id").orderBy(F.col(score).desc(), "n")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def retrieve(claims: DataFrame, passages: DataFrame, k: int = 12) -> DataFrame:
    """claim_id, source, n, coverage, rank of the k passages of its source that have most of a claim's stems (ties: the earlier passage).

    claims: claim_id, source, text; passages: source, n, text. Pairs meet by a stem in the index of their source, so a passage without one is never looked at."""
    want = stem_index(claims, "claim_id", "source")
    size = want.groupBy("claim_id").agg(F.count(F.lit(1)).alias("size"))
    cited = passages.join(claims.select("source").distinct(), "source", "left_semi")
    hits = want.join(stem_index(cited, "source", "n"), ["source", "stem"]).groupBy("claim_id", "source", "n").agg(F.count(F.lit(1)).alias("shared"))
    scored = hits.join(size, "claim_id").select("claim_id", "source", "n", (F.col("shared") / F.col("size")).alias("coverage"))
    return _best(scored, "coverage", k)


def rerank(found: DataFrame, claim_vectors: DataFrame, passage_vectors: DataFrame, k: int = 12) -> DataFrame:
    """found with score and rank by coverage plus the dot product of the vectors (claim_id, embedding; source, n, embedding).

    A claim that lacks its vector, or one of its passages', keeps the order of coverage as a whole: scores with and without don't compare."""
    v = found.drop("rank").join(claim_vectors.select("claim_id", F.col("embedding").alias("a")), "claim_id", "left").join(passage_vectors.select("source", "n", F.col("embedding").alias("b")), ["source", "n"], "left")
    near = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), dot(F.col("a"), F.col("b")))
    claim = Window.partitionBy("claim_id")
    scored = v.withColumn("near", near).withColumn("mode", F.when((F.count(F.lit(1)).over(claim) > 1) & F.bool_and(F.col("near").isNotNull()).over(claim), "vector").otherwise("lexical"))
    score = F.col("coverage") + F.when(F.col("mode") == "vector", F.col("near")).otherwise(0.0)
    return _best(scored.select("claim_id", "source", "n", "coverage", "mode", F.round(score, 6).alias("score")), "score", k)
