"""Exact dedup: a two-pass Bloom filter finds hashes that may be repeated.

Texts are equal when identical after lower-casing A-Z; a null text is empty.

1. Each row's normalised text becomes a SHA-256 digest; (id, digest) is written
   to the shared folder, and texts are not read again.
2. First pass: every task sets its digests' bits in a Bloom filter whose bits
   count to two. The filter is cut into chunks, and all bits of a digest lie in
   one, so chunks are added up by number, wherever they are.
3. Second pass: a digest with any bit under two occurs once for certain, and its
   row passes straight through. Only the others shuffle, to be grouped by the
   whole digest, so false positives cost a little shuffle and never a result.

The filter takes about ``bits_per_row`` bits a row, whatever the number of rows.
Up to ``broadcast_bits`` it is collected and sent to the tasks. A larger one stays
where it is: distinct digests (combined within tasks first) go to their chunk,
and those that may be repeated come back. Texts move in neither case.

Of equal texts the largest id stays; null ids rank below all others, and where
all ids of a group are null, all its rows stay. Rows that repeat an id and a
text share the decision. Groups of over a ``HOT_GROUPS``-th of all rows (so at most
as many groups) are broadcast rather than joined by digest. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.shared import kept, partitions, settle, sorted_groups

CHUNK = 1 << 16
HASHES = 4
FLUSH = 1 << 20
#: Groups with over HOT_ROWS rows, and over a HOT_GROUPS-th of all rows, are joined by broadcast.
HOT_ROWS, HOT_GROUPS = 256, 10_000


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256
    kept("digests", bool)
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sha((t or b"").lower()).digest() for t in texts], pa.binary())], ["id", "digest"])


def places(digests: list[bytes], chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk of each digest, and a row of HASHES bit numbers in it."""
    words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)
    steps = np.arange(HASHES, dtype=np.uint64)
    return (words[:, 2] % np.uint64(chunks)).astype(np.int64), (words[:, :1] + steps * (words[:, 1:2] | np.uint64(1))) & np.uint64(CHUNK - 1)


def _first_pass(chunks: int):
    def sparse(parts: list[np.ndarray]):
        at, n = np.unique(np.concatenate(parts), return_counts=True)
        chunk, offset = at // CHUNK, (at % CHUNK).astype("<u2")
        cut = [*np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]).tolist(), len(at)]
        spans = list(zip(cut, cut[1:], strict=False))
        return pa.RecordBatch.from_arrays([
            pa.array([int(chunk[a]) for a, _ in spans], pa.int64()),
            pa.array([offset[a:b][n[a:b] == 1].tobytes() for a, b in spans], pa.binary()),
            pa.array([offset[a:b][n[a:b] > 1].tobytes() for a, b in spans], pa.binary()),
        ], ["chunk", "once", "twice"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                chunk, bits = places(batch.column(0).to_pylist(), chunks)
                parts.append((chunk[:, None] * CHUNK + bits.astype(np.int64)).ravel())
                held += len(parts[-1])
            if held >= FLUSH:
                yield sparse(parts)
                parts, held = [], 0
        if parts:
            yield sparse(parts)

    return run


def _add_up(pdf):
    """One chunk: the bits that were set twice or more, as a bitmap."""
    import pandas as pd

    n = np.zeros(CHUNK, dtype=np.uint32)
    for once, twice in zip(pdf["once"], pdf["twice"], strict=True):
        n[np.frombuffer(once, dtype="<u2")] += 1
        n[np.frombuffer(twice, dtype="<u2")] += 2
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].tolist(), "bitmap": [np.packbits(n > 1, bitorder="little").tobytes()]})


def _asked(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether all bits of each row are set; bits number those of the bitmap."""
    return ((bitmap[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def _second_pass(repeated, chunks: int):
    def run(batches):
        bitmap = np.zeros(chunks * CHUNK // 8, dtype=np.uint8)
        for chunk, blob in repeated.value:
            bitmap[chunk * CHUNK // 8 : (chunk + 1) * CHUNK // 8] = np.frombuffer(blob, dtype=np.uint8)
        for batch in batches:
            if batch.num_rows:
                chunk, bits = places(batch.column(1).to_pylist(), chunks)
                maybe = _asked(bitmap, chunk[:, None].astype(np.uint64) * np.uint64(CHUNK) + bits)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], ["id", "digest", "maybe"])

    return run


def _number(chunks: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(places(batch.column(0).to_pylist(), chunks)[0]), batch.column(0)], ["chunk", "digest"])

    return run


def _ask_dealt(chunks: int):
    """Digests behind their chunk's bitmap: those that may be repeated."""

    def run(batches):
        bitmap = None
        for _, first, rows in sorted_groups(batches, ["chunk"]):
            blobs, digests = rows.column(1).to_pylist(), rows.column(2).to_pylist()
            at = 0
            if first:
                bitmap, at = np.frombuffer(blobs[0], dtype=np.uint8), 1  # every digest has set bits of its chunk, so there is one
            if own := digests[at:]:
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()).filter(pa.array(_asked(bitmap, places(own, chunks)[1])))], ["digest"])

    return run


def exact_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, broadcast_bits: int = 1 << 29) -> DataFrame:
    """One row for each of docs: id, keep_id, group_size, kept, digest."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    digests = settle(spark, rows.mapInArrow(_digest, "id long, digest binary"), "exact-digests")
    total = digests.count()
    chunks = max(1, -(-total * bits_per_row // CHUNK))
    counted = digests.select("digest").mapInArrow(_first_pass(chunks), "chunk long, once binary, twice binary")
    merged = counted.groupBy("chunk").applyInPandas(_add_up, "chunk long, bitmap binary")
    if chunks * CHUNK <= broadcast_bits:
        repeated = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in merged.collect()])  # broadcast_bits / 8 bytes at most
        marked = settle(spark, digests.mapInArrow(_second_pass(repeated, chunks), "id long, digest binary, maybe boolean"), "exact-marked")
        once, maybe = marked.filter(~F.col("maybe")).select("id", "digest"), marked.filter("maybe").select("id", "digest")
        groups = maybe.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    else:
        blank = F.lit(None).cast("binary")
        numbered = digests.groupBy("digest").count().select("digest").mapInArrow(_number(chunks), "chunk long, digest binary")
        both = merged.select("chunk", "bitmap", blank.alias("digest")).unionByName(numbered.select("chunk", blank.alias("bitmap"), "digest"))
        dealt = both.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", F.col("bitmap").isNull())
        asked = settle(spark, dealt.mapInArrow(_ask_dealt(chunks), "digest binary"), "exact-maybe")
        groups = digests.join(asked, "digest", "left_semi").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        once, maybe = None, digests
    groups = settle(spark, groups.filter("group_size > 1"), "exact-groups", total)
    limit = max(HOT_ROWS, total // HOT_GROUPS)
    hot = groups.filter(F.col("group_size") > limit).withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"}).withColumn("is_hot", F.lit(True))
    split = maybe.join(F.broadcast(hot), "digest", "left")  # at most HOT_GROUPS groups
    cold = split.filter("is_hot IS NULL").select("id", "digest").join(groups.filter(F.col("group_size") <= limit), "digest", "left")
    single = F.col("group_size").isNull()
    more = cold.select("id", F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (single | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest")
    more = more.unionByName(split.filter("is_hot").select("id", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"), F.col("id").eqNullSafe(F.col("hot_id")).alias("kept"), "digest"))
    if once is None:
        return more
    return once.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest").unionByName(more)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the copies: of each group the row with the largest id stays, one of them where several rows have it. Columns of any name pass through."""
    rows = settle(spark, docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("place")), "exact-rows")
    found = exact_groups(spark, rows, "place", "text", **options)  # by place, so that each row is told apart
    best = found.join(rows.select(F.col("place").alias("id"), F.struct(F.col("id").isNotNull(), "id", -F.col("place")).alias("order")), "id").groupBy("digest").agg(F.max("order").alias("order"))
    stays = best.select((-F.col("order.col3")).alias("place"))
    return rows.join(stays, "place", "left_semi").select("row.*")
