"""From raw documents to packed token sequences, in five stages.

Each stage takes what the one before it kept and returns the columns of
``documents`` (the last one: pieces and their places in sequences).

* quality: documents that the compression classifier gives under 0.3 go.
* language: null texts and texts without a letter (``und``) go; one in a language
  that was not learned gets the nearest learned one and stays.
* lines: lines that at least three documents share stay in one of them; texts
  and n_chars change, and no document goes.
* near_copies: of each group of near copies (operator 9's links at 4 or fewer bits,
  and a Jaccard similarity of 0.8 or more of distinct runs of five words) one row stays, that with the smallest
  id; null ids come last, and rows with one id in the order of a hash of the text,
  then of the other columns. Rows are told apart by their place, not by their id.
* packing: whole documents into sequences of at most 4096 tokens.

Models are fitted on the labelled rows of ``documents`` outside the held-out
fold, as the stage's own input has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import langid, line_dedup, minhash, packing, quality, simhash
from tracewright.llm.components import connected_components
from tracewright.llm.queries import VOCABULARY, language_model, quality_model
from tracewright.llm.shared import settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.score(docs.select(*COLUMNS), quality_model(spark, docs, sf_dir), score_col="_quality", with_text=True)
    return scored.filter(F.col("_quality") >= 0.3).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(docs.select(*COLUMNS), language_model(docs), with_text=True)
    return found.filter(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spark, docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = settle(spark, docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    order = rows.select("row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.xxhash64("lang", "source", "n_chars"), "row").alias("order"))
    # Operator 9 finds what lies within its radius; links that it can't see (a similarity of 0.8 is mostly beyond it) come on top, and groups of both are joined.
    by_bits = settle(spark, simhash.near_groups(spark, rows, id_col="row").select(F.col("component_id").alias("a"), F.col("id").alias("b")), "pipeline-bits")
    by_words = settle(spark, minhash.near_groups(spark, rows), "pipeline-words")
    ends = by_words.groupBy("component").agg(F.min("row").alias("least"))
    links = settle(spark, by_bits.unionByName(by_words.join(ends, "component").select(F.col("least").alias("a"), F.col("row").alias("b"))).filter("a <> b"), "pipeline-links")
    groups = order.join(connected_components(spark, links), F.col("row") == F.col("node"), "left").select(F.coalesce("component", "row").alias("component"), "order")
    stays = groups.groupBy("component").agg(F.min("order").alias("order"))
    return rows.join(stays.select("order.row"), "row", "left_semi").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, VOCABULARY)


STAGES = [("quality", quality_stage), ("language", language_stage), ("lines", line_stage), ("near_copies", near_copy_stage), ("packing", packing_stage)]

#: Compression, suffix automata, covering hashes and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
