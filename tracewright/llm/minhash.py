"""Near copies by the Jaccard similarity of their word shingles.

A document's shingles are the distinct runs of ``words`` words (split and
lower-cased as in simhash; a text with fewer words is one shingle, one without
words has none), by their XXH64 values. Documents with equal shingles are one
node. Each of BANDS bands hashes ROWS minima of the shingles; nodes that share a
band meet in its bucket. A pair of similarity s meets with probability
1 - (1 - s ** ROWS) ** BANDS: 0.99994 at 0.8, over 0.9999999 from 0.86.

Every link is tested on the shingles themselves. First each node of a bucket
against the bucket's least, its hub; hubs with many nodes are dealt into parts.
Buckets whose other nodes are then still in several components are searched
pair by pair across components, large ones in pairs of blocks. So all pairs that
meet and reach the similarity end up connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.components import connected_components
from tracewright.llm.shared import kept, partitions, settle, sorted_groups

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
BUCKET = 512
STEP = 1 << 10

_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    import xxhash

    own = text.lower().split()
    if not own:
        return np.zeros(0, dtype=np.uint64)
    h64, joined = xxhash.xxh64_intdigest, b" ".join(own)
    if len(own) <= words:
        return np.array([h64(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1)
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    return np.unique(np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), dtype=np.uint64, count=len(starts)))


def node_and_keys(own: np.ndarray) -> tuple[int, list[int]]:
    """A hash of the shingles and one of each band's minima, unsigned."""
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), STEP):
        np.minimum(least, (own[at : at + STEP, None] * _FACTORS + _OFFSETS).min(0), out=least)
    bands = least.reshape(BANDS, ROWS)
    return xxhash.xxh64_intdigest(own.tobytes(), 42), [xxhash.xxh64_intdigest(bands[v].tobytes(), v) for v in range(BANDS)]


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two ascending arrays reaches the bound."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or len(small) / len(large) < similarity:
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both / (len(a) + len(b) - both) >= similarity


def _keys(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("minhash", bool)
        for batch in batches:
            nodes, keys = [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                node, own = node_and_keys(shingles(t or b"", words))
                nodes.append(node)
                keys += own
            offsets = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.array(keys, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), lists], ["row", "node", "keys"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t or b"", words).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, type=pa.binary())], ["node", "hashes"])

    return run


def _hashes(rows: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.column(rows.schema.get_field_index("hashes"))]


def _longs(rows: pa.RecordBatch, name: str) -> list[int]:
    return rows.column(rows.schema.get_field_index(name)).to_pylist()


def _out(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], type=pa.int64()) for i in (0, 1)], ["a", "b"])


def _test_hubs(similarity: float):
    """Links of each part's first row with its others."""

    def run(batches):
        hub = None
        for _, first, rows in sorted_groups(batches, ["hub", "part"]):
            links, at = [], 0
            nodes, own = _longs(rows, "node"), _hashes(rows)
            if first:
                hub, at = (nodes[0], own[0].copy()), 1
            links = [(hub[0], n) for n, h in zip(nodes[at:], own[at:], strict=True) if similar(hub[1], h, similarity)]
            if links:
                yield _out(links)
        yield _out([])

    return run


def join_components(nodes: list[int], components: list[int], own: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect all similar pairs of different components."""
    labels = np.unique(np.array(components, dtype=np.int64), return_inverse=True)[1].reshape(-1)
    links = []
    for i in range(len(nodes) - 1):
        for j in (i + 1 + np.flatnonzero(labels[i + 1 :] != labels[i])).tolist():
            if labels[j] != labels[i] and similar(own[i], own[j], similarity):
                links.append((nodes[i], nodes[j]))
                labels[labels == labels[j]] = labels[i]
    return links


def _test_pairs(similarity: float):
    def run(batches):
        nodes, components, own = [], [], []
        for _, first, rows in sorted_groups(batches, ["key", "i", "j"]):
            if first:
                if links := join_components(nodes, components, own, similarity):
                    yield _out(links)
                nodes, components, own = [], [], []
            nodes += _longs(rows, "node")
            components += _longs(rows, "component")
            own += [h.copy() for h in _hashes(rows)]
        yield _out(join_components(nodes, components, own, similarity))

    return run


def near_groups(spark: SparkSession, rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """row and component (a number that all of its rows share) of each of rows (row, text), where row is unique."""
    texts = rows.select("row", F.col("text").cast("string").alias("text"))
    own = settle(spark, texts.mapInArrow(_keys(words), "row long, node long, keys array<long>"), "minhash-keys")
    n = own.count()
    nodes = settle(spark, own.groupBy("node").agg(F.min("row").alias("row"), F.first("keys").alias("keys")), "minhash-nodes", n)
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub")
    members = settle(spark, keyed.join(hubs, "key").select("key", "hub", "node"), "minhash-members", BANDS * n)
    n_members = members.count()

    met = nodes.select("node", "row").join(members.select("node").distinct(), "node")
    sets = settle(spark, texts.join(met, "row").select("node", "text").mapInArrow(_sets(words), "node long, hashes binary"), "minhash-sets")

    others = members.filter("node <> hub")
    pairs = settle(spark, others.select("hub", "node").distinct(), "minhash-pairs", n_members)
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / (bucket // 2)).cast("int").alias("parts"))
    dealt = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("place"), "node")
    heads = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"), F.col("hub").alias("node"))
    stars = dealt.unionByName(heads).join(sets, "node").repartition(partitions(spark), "hub", "part").sortWithinPartitions("hub", "part", "place")
    links = settle(spark, stars.mapInArrow(_test_hubs(similarity), "a long, b long"), "minhash-links", n_members)
    found = connected_components(spark, links)

    named = settle(spark, others.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "minhash-named", n_members)
    same = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("all")).filter("lo < hi")
    blocks = F.when(F.col("n") > bucket, F.ceil(F.col("n") / (bucket // 2))).otherwise(1).cast("int")
    open_ = settle(spark, same.groupBy("n", "all").agg(F.min("key").alias("key")).select("key", blocks.alias("blocks")), "minhash-open", n_members)
    if open_.limit(1).count():
        dealt = named.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.select("key", "node", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("key", "node", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        units = dealt.join(sets, "node").repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
        more = settle(spark, units.mapInArrow(_test_pairs(similarity), "a long, b long"), "minhash-more")
        if more.limit(1).count():
            found = connected_components(spark, links.unionByName(more))
    return own.select("row", "node").join(found, "node", "left").select("row", F.coalesce("component", "node").alias("component"))
