"""Queries over all rows on small tables, and what the tables of the driver do not hold."""

import numpy as np
from pyspark.sql import functions as F

import tracewright.plans.drafts
import tracewright.plans.feed
import tracewright.plans.library  # noqa: F401
from tracewright.operators import claims, feed
from tracewright.plans.registry import QUERIES


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_weeks_count_all_events_and_fill_gaps(spark, tmp_path):
    times = [("2024-01-01 00:00:00", 2, "view"), ("2024-01-07 23:00:00", 1, "signup"), ("2024-01-24 10:00:00", 5, "error"), (None, 1, "signup")]
    path = write(spark, tmp_path, raw=(times, "t string, user_id long, event_type string"))
    spark.read.parquet(f"{path}/raw.parquet").withColumn("ts", F.col("t").cast("timestamp_ntz")).write.parquet(f"{path}/events.parquet")
    got = sorted(tuple(r) for r in QUERIES["weekly_ingest_zero_filled"](spark, path).collect())
    assert got == [("2024-01-01", 2), ("2024-01-08", 0), ("2024-01-15", 0), ("2024-01-22", 1)]


def test_unknown_corpora(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("b", 3, "x"), ("b", 4, None), ("c", 5, None), ("d", 6, "x"), ("d", 7, "y"), ("d", 8, None)]
    got = {r.family: (r.unknown, r.agreement) for r in claims.corpus_agreement(spark.createDataFrame(rows, "family string, run_id long, corpus string")).collect()}
    assert got == {"a": (0, "shared"), "b": (1, "partial"), "c": (1, "unknown"), "d": (1, "differing")}


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_tags_and_venues_of_whole_texts(spark, tmp_path):
    long = "a " * 40 + "Hidden Journal of the later words"
    rows = [(i, long if i < 4 else t, "en", "s", 0) for i, t in enumerate([None] * 4 + ["hidden hidden", "", None])]
    path = write(spark, tmp_path, documents=(rows, DOCS))
    got = {r.item_id: (r.label, r.overlap) for r in QUERIES["feed_digest_clusters"](spark, path).collect()}
    assert got == {0: ("en", 4), 1: ("en", 4), 2: ("en", 4), 3: ("en", 4), 4: ("en", 1)}
    sizes = {r.label: r.n for r in QUERIES["feed_digest_budget"](spark, path).collect()}
    assert sizes == {"hidden": 5, "journal": 4, "later": 4, "words": 4}
    tags = {r.tag for r in QUERIES["tag_canonical"](spark, path).collect()}
    assert tags == set(sizes)
    keys = {r.doc_id: r.venue_key for r in QUERIES["venue_keys"](spark, path).collect()}
    assert keys[0].endswith("hidden journal of the later words") and keys[5] == keys[6] == ""


def test_searches_take_every_hundredth_row(spark, tmp_path):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(450, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = [*range(1, 450), 500]  # no row 0
    v[[10, 20, 30]] = v[40]
    path = write(spark, tmp_path, embeddings=([(i, x.tolist(), i % 3) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, label long"))
    near = np.round(v @ v.T, 6)
    want = {(ids[q], ids[j], k) for q in range(450) if ids[q] % 100 == 0 for k, j in enumerate(sorted(range(450), key=lambda j: (-near[q, j], ids[j]))[:10])}

    def ranked(df):
        rows = sorted(df.collect(), key=lambda r: (r.query_id, -r.similarity, r.item_id))
        return {(r.query_id, r.item_id, k % 10) for k, r in enumerate(rows)}

    assert ranked(QUERIES["knn_topk"](spark, path)) == want and len(want) == 50
    vectors = spark.read.parquet(f"{path}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")
    queries = vectors.filter("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    assert ranked(feed.nearest_each(vectors, queries, 10, rows=60, block=2)) == want
    assert feed.nearest_each(vectors, queries.limit(0), 10).count() == 0
