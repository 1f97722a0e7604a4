"""Importance resampling towards a target's distribution, by a dictionary of distinct features.

Features are the runs of 1 to 2 consecutive words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z), joined by a space, repeats counted. They are counted as strings over the whole
corpus; each distinct string is hashed once, into one of ``buckets`` buckets (its crc32); counts of
buckets follow from the dictionary, those of the corpus and of the target give each
bucket's gain, and gains are joined back to the features of each document.

A dictionary of pairs of words is nearly as large as the corpus, and a row for each document and feature
would be several times that. So documents are taken in chunks of ``CHUNK`` words: a chunk's
distinct features go to their shards, each once, with the places where they occur (document, count), packed and
compressed; a hot feature is one entry of each chunk. A shard merges the chunks' entries by string, hashes each string, and puts
its bucket in its place. These tables are settled; buckets are added up, gains (a number for each bucket) go to all
tasks, and each chunk gets its features back as gains, those of a document added up within a task before they travel. Shards are several
for each partition, sorted, so that a task holds one at a time.

A document's weight is the floored mean of its features' gains, 0 without features; its
score adds Gumbel noise from sha256(``<seed>:<id>``). Of the documents with ``min_words`` words at least
the ``percent`` % of highest scores are drawn, ties to the smaller id (null last); ranks
come from ranges of scores, counted and added up, not from one sorted task.

Null and empty texts have no features. Repeated rows are documents of their own, and repeated ids have the same noise; a null id
counts as the empty text there. An empty target has no counts, an empty corpus gives no rows. A chunk has one whole document at
least, so memory grows with the longest text. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.shared import kept, partitions, settle, sorted_groups, trim

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a chunk, and bytes of text that are split at once.
CHUNK = 3 << 19
SPLIT_BYTES = 1 << 22
#: Documents whose sums a task holds before it sends them on.
HELD = 1 << 20
SHARDS_PER_PARTITION = 2
#: Tasks that add up totals of buckets before they reach the driver.
ADDERS = 16
LEVEL = 3


def _pack(*columns: np.ndarray, words: bytes = b"") -> bytes:
    """Columns of unsigned 32-bit numbers and a text as one compressed string: the numbers' first bytes, then their second ones, and so on."""
    import zstandard

    sizes = np.array([len(columns), *map(len, columns)], dtype="<u4").tobytes()
    planes = [np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([sizes, *planes, words]))


def _unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<u4", n, 4), 4 + 4 * n, []
    for size in sizes.tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64))
        at += 4 * size
    return out, raw[at:]


def _deltas(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each value less the one before it; where a run starts, the value."""
    out = values.copy()
    out[1:] -= np.where(first[1:], 0, values[:-1])
    return out


def _sums(deltas: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values again, from runs of the given sizes (1 at least)."""
    total = np.cumsum(deltas)
    starts = np.cumsum(sizes) - sizes
    return total - np.repeat(total[starts] - deltas[starts], sizes)


class _Chunk:
    """Words of documents, split but not yet counted."""

    def __init__(self):
        self.ids: list = []
        self.parts: list[pa.Array] = []
        self.docs: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        split = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
        words, docs = split.flatten(), pc.list_parent_indices(split)
        some = pc.not_equal(words, "")
        words, docs = words.filter(some), docs.filter(some).to_numpy().astype(np.int32) + np.int32(len(self.ids))
        self.ids += ids.to_pylist()
        self.parts.append(words)
        self.docs.append(docs)
        self.size += len(words)

    def features(self, shards: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, bytes]]]:
        """Words and features of each document, and (shard, entries) of the distinct features."""
        coded = pa.chunked_array(self.parts, pa.string()).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        vocab = coded.dictionary.take(pa.array(order)).to_pylist()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        codes, docs = rank[coded.indices.to_numpy()], np.concatenate(self.docs)
        n_words = np.bincount(docs, minlength=len(self.ids))
        pair = docs[1:] == docs[:-1]
        base = len(vocab) + 1  # a feature is its first word's number times this, plus its second's from 1, or plus 0
        key = np.concatenate([codes * base, codes[:-1][pair] * base + codes[1:][pair] + 1])
        doc = np.concatenate([docs, docs[1:][pair]])
        n_features = np.bincount(doc, minlength=len(self.ids))
        return n_words, n_features, self._entries(vocab, base, key, doc, shards)

    @staticmethod
    def _entries(vocab, base, key, doc, shards):
        if not len(key):
            return
        order = np.argsort(key, kind="stable")  # documents stay in order
        key, doc = key[order], doc[order]
        new = np.r_[True, key[1:] != key[:-1]]
        place = np.flatnonzero(new | np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[place, len(key)])
        key, doc, new = key[place], doc[place], new[place]
        feature = np.cumsum(new) - 1
        own = key[new]
        first, second = own // base, own % base
        h = np.array([zlib.crc32(w.encode()) for w in vocab], dtype=np.uint64)
        h2 = np.r_[np.uint64(0), h]
        mixed = (h[first] * np.uint64(0x9E3779B97F4A7C15)) ^ (h2[second] * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        shard = ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
        by_shard = np.argsort(shard, kind="stable")
        places = np.argsort(shard[feature], kind="stable")
        sizes = np.bincount(feature)
        doc, count, new = doc[places], count[places], new[places]
        delta = _deltas(doc, new)
        first, second, sizes = first[by_shard], second[by_shard], sizes[by_shard]
        ends = np.cumsum(np.bincount(shard, minlength=shards))
        p = f = 0
        for s, end in enumerate(ends.tolist()):
            if end == f:
                continue
            q = p + int(sizes[f:end].sum())
            a, b = first[f:end], second[f:end]
            used = np.unique(np.concatenate([a, b[b > 0] - 1]))
            a_own, b_own = np.searchsorted(used, a), np.where(b > 0, np.searchsorted(used, b - 1) + 1, 0)
            yield s, _pack(np.diff(a_own, prepend=0), b_own, sizes[f:end] - 1, delta[p:q], count[p:q] - 1, words="\n".join([vocab[i] for i in used]).encode())
            p, f = q, end


SENT = "shard int, chunk long, blob binary, ids array<long>, words array<long>, features array<long>"


def _chunks(shards: int, chunk_words: int):
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary()), *[(c, pa.list_(pa.int64())) for c in ("ids", "words", "features")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("resample", bool)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        chunk = _Chunk()

        def out():
            words, features, entries = chunk.features(shards)
            yield pa.RecordBatch.from_pylist([{"shard": number % shards, "chunk": number, "ids": chunk.ids, "words": words.tolist(), "features": features.tolist()}], schema)
            yield pa.RecordBatch.from_pylist([{"shard": s, "chunk": number, "blob": blob} for s, blob in entries], schema)
            trim()

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).fill_null("")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                reach = (ends[at - 1] if at else 0) + SPLIT_BYTES
                end = max(at + 1, int(np.searchsorted(ends, reach, side="right")))
                chunk.add(ids.slice(at, end - at), texts.slice(at, end - at))
                at = end
                if chunk.size >= chunk_words:
                    yield from out()
                    chunk, number = _Chunk(), number + 1
        if chunk.ids:
            yield from out()

    return run


def _merge(blobs: list[bytes], buckets: int):
    """A shard: totals of buckets, and each chunk's entries with a bucket for the string."""
    entries, texts = [], []
    for blob in blobs:
        columns, words = _unpack(blob)
        entries.append(columns)
        texts.append(pa.array(words.decode().split("\n"), pa.string()))
    coded = pa.chunked_array(texts).combine_chunks().dictionary_encode()
    vocab = [w.encode() for w in coded.dictionary.to_pylist()]
    codes, at = coded.indices.to_numpy().astype(np.int64), 0
    keys, counts, base = [], [], len(vocab) + 1
    for (a_delta, b, sizes, _, count), words in zip(entries, texts, strict=True):
        own = codes[at : at + len(words)]
        at += len(words)
        keys.append(own[np.cumsum(a_delta.astype("<u4"), dtype="<u4").astype(np.int64)] * base + np.r_[0, own + 1][b])
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        counts.append(np.add.reduceat(count + 1, starts))
    distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(of, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    seeds = [zlib.crc32(w) for w in vocab]
    spaced = [zlib.crc32(b" ", c) for c in seeds]
    hashed = (zlib.crc32(vocab[b - 1], spaced[a]) if b else seeds[a] for a, b in zip((distinct // base).tolist(), (distinct % base).tolist(), strict=True))
    bucket = np.fromiter(hashed, dtype=np.int64, count=len(distinct)) % buckets
    totals = np.bincount(bucket, weights=n, minlength=buckets).astype(np.int64)
    mine, out, at = bucket[of], [], 0
    for _, b, sizes, delta, count in entries:
        out.append((mine[at : at + len(b)], sizes, delta, count))
        at += len(b)
    return totals, out


COUNTED = "chunk long, blob binary, ids array<long>, words array<long>, features array<long>, totals array<long>"


def _shards(buckets: int, with_places: bool):
    schema = pa.schema([("chunk", pa.int64()), ("blob", pa.binary()), *[(c, pa.list_(pa.int64())) for c in ("ids", "words", "features", "totals")]])

    def run(batches):
        kept("resample", bool)
        totals = np.zeros(buckets, dtype=np.int64)
        chunks: list[int] = []
        blobs: list[bytes] = []

        def done():
            nonlocal totals
            if blobs:
                own, entries = _merge(blobs, buckets)
                totals += own
                if with_places:
                    yield pa.RecordBatch.from_pylist([{"chunk": c, "blob": _pack(*columns)} for c, columns in zip(chunks, entries, strict=True)], schema)
            chunks.clear()
            blobs.clear()

        for _, first, rows in sorted_groups(batches, ["shard"]):
            if first:
                yield from done()
            for row in rows.to_pylist():
                if row["blob"] is not None:
                    chunks.append(row["chunk"])
                    blobs.append(row["blob"])
                elif with_places:
                    yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("chunk", "ids", "words", "features")}], schema)
        yield from done()
        yield pa.RecordBatch.from_pylist([{"totals": totals.tolist()}], schema)

    return run


def feature_counts(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, buckets: int, with_places: bool = True, chunk_words: int = CHUNK) -> DataFrame:
    """The settled table of chunks: documents with their sizes, entries with buckets, and totals of buckets."""
    n = partitions(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sent = rows.mapInArrow(_chunks(SHARDS_PER_PARTITION * n, chunk_words), SENT).repartition(n, "shard").sortWithinPartitions("shard", "chunk")
    return settle(spark, sent.mapInArrow(_shards(buckets, with_places), COUNTED), "resample-features")


def _added(batches):
    total = None
    for batch in batches:
        for row in batch.column(0).to_pylist():
            total = np.array(row, dtype=np.int64) + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["totals"])


def bucket_totals(counted: DataFrame, buckets: int) -> list[int]:
    """Occurrences of features by bucket; ADDERS rows of as many numbers as there are buckets reach the driver at most."""
    sums = counted.select("totals").filter("totals IS NOT NULL").coalesce(ADDERS).mapInArrow(_added, "totals array<long>").collect()
    return np.sum([r.totals for r in sums] or [[0] * buckets], axis=0).tolist()


def gains(raw: list[int], target: list[int]) -> list[int]:
    """For each bucket floor(1000 * ln of the ratio of its smoothed shares)."""
    n, s_all, t_all = len(raw), sum(raw), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(raw, target, strict=True)]


def _sums_of(by_bucket):
    """Sums of gains by chunk and document, over the shards of a task."""
    schema = pa.schema([("chunk", pa.int64()), ("blob", pa.binary()), *[(c, pa.list_(pa.int64())) for c in ("ids", "words", "features")]])

    def run(batches):
        kept("resample", bool)
        gain = np.array(by_bucket, dtype=np.int64)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def out():
            rows = []
            for chunk, (doc, total) in held.items():
                plain = (total << 1) ^ (total >> 63)  # signs go to the last bit
                rows.append({"chunk": chunk, "blob": _pack(np.diff(doc, prepend=0), plain & 0xFFFFFFFF, plain >> 32)})
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["blob"] is None:
                    yield pa.RecordBatch.from_pylist([row], schema)
                    continue
                (bucket, sizes, delta, count), _ = _unpack(row["blob"])
                doc = _sums(delta, sizes + 1)
                value = np.repeat(gain[bucket], sizes + 1) * (count + 1)
                known, more = held.pop(row["chunk"], (doc[:0], value[:0]))
                size -= len(known)
                both, of = np.unique(np.concatenate([known, doc]), return_inverse=True)
                total = np.zeros(len(both), dtype=np.int64)
                np.add.at(total, of, np.concatenate([more, value]))
                held[row["chunk"]] = (both, total)
                size += len(both)
                if size > HELD:
                    yield out()
                    size = 0
        yield out()

    return run


def _weights(batches):
    kept("resample", bool)
    head, parts = None, []

    def done():
        if head is None:
            return []
        total = np.zeros(len(head["ids"]), dtype=np.int64)
        for blob in parts:
            (delta, low, high), _ = _unpack(blob)
            plain = low | (high << 32)
            total[np.cumsum(delta)] += (plain >> 1) ^ -(plain & 1)
        features = np.array(head["features"], dtype=np.int64)
        weight = np.where(features > 0, total // np.maximum(features, 1), 0)
        return [pa.RecordBatch.from_arrays([pa.array(head["ids"], pa.int64()), pa.array(head["words"], pa.int64()), pa.array(features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])]

    for _, first, rows in sorted_groups(batches, ["chunk"]):
        if first:
            yield from done()
            head, parts = None, []
        for row in rows.to_pylist():
            if row["blob"] is None:
                head = row
            else:
                parts.append(row["blob"])
    yield from done()


def weighted(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = 10_000, chunk_words: int = CHUNK) -> DataFrame:
    """id, n_words, n_features, weight of each of docs."""
    counted = feature_counts(spark, docs, id_col, text_col, buckets, chunk_words=chunk_words)
    aims = feature_counts(spark, target.select(F.lit(None).cast("long").alias("id"), F.col(f"`{target_text_col}`").alias("text")), "id", "text", buckets, with_places=False, chunk_words=chunk_words)
    by_bucket = gains(bucket_totals(counted, buckets), bucket_totals(aims, buckets))
    back = counted.filter("chunk IS NOT NULL").select("chunk", "blob", "ids", "words", "features")
    back = back.mapInArrow(_sums_of(by_bucket), "chunk long, blob binary, ids array<long>, words array<long>, features array<long>")
    return back.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(_weights, "id long, n_words long, n_features long, weight long")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = 10_000, chunk_words: int = CHUNK) -> DataFrame:
    """id, n_words, n_features, weight, score and rank (null: not drawn) of each of docs."""
    rows = weighted(spark, docs, target, id_col, text_col, target_text_col, buckets, chunk_words)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranges = rows.withColumn("score", F.col("weight") + noise).withColumn("fits", F.col("n_words") >= min_words)
    ranges = settle(spark, ranges.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id()), "resample-scores")
    drawn = percent * ranges.filter("fits").count() // 100
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    out = ranges.join(F.broadcast(before), "range").withColumn("place", place)
    return out.select("id", "n_words", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
