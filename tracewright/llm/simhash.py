"""SimHash near-dedup with covering locality-sensitive hashing.

A document's shingles are its runs of ``words`` words (A-Z lower-cased, split at
``[\\x20\\x09-\\x0D]``, joined by spaces, repeats included; a text with fewer
words is one shingle). A bit of its fingerprint is set where over half of the
shingles' XXH64 values (seed 42) have it set. A text without words, or a null
one, has fingerprint zero and links like any other.

Fingerprints link at ``radius`` or fewer differing bits. Each of the 64 bits
gets a nonzero vector of radius + 1 bits; for every nonzero vector v there is a
table that masks out the bits whose vector is orthogonal to v. The vectors of up
to radius differing bits leave some v orthogonal to them all, so in that table
both fingerprints are equal under the mask: no pair within the radius is missed.

Only distinct fingerprints go into tables, so copies cost nothing. A bucket of up
to ``BUCKET`` fingerprints is searched as one; a larger one is dealt into blocks,
and every two of them are searched as a unit of their own. A unit yields the
links of a spanning forest, at most one per fingerprint, never all pairs; links
between texts are kept up to connection. No rows give no rows; columns other than
the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.components import connected_components
from tracewright.llm.shared import kept, partitions, settle, sorted_groups

BITS = 64
BUCKET = 2048
STEP = 1 << 14


def fingerprint(text: bytes, words: int = 4) -> int:
    import xxhash

    own = text.lower().split()
    if not own:
        return 0
    h64, joined = xxhash.xxh64_intdigest, b" ".join(own)
    if len(own) <= words:
        return h64(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1)
    starts = np.concatenate([[0], ends[:-words]])
    n, ones = len(starts), np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, STEP):
        a, b = starts[at : at + STEP].tolist(), (ends[words - 1 :][at : at + STEP] - 1).tolist()
        h = np.array([h64(joined[x:y], 42) for x, y in zip(a, b, strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash", bool)
        for batch in batches:
            got = np.array([fingerprint(t or b"", words) for t in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["id", "fp"])

    return run


def masks(radius: int) -> list[int]:
    """One mask for each nonzero vector of radius + 1 bits; bit i of the fingerprint has the vector 1 + i mod (2 ** (radius + 1) - 1)."""
    tables = (1 << radius + 1) - 1
    vectors = [1 + i % tables for i in range(BITS)]
    return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() % 2) for v in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int, of: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of distinct fingerprints (unsigned) within the radius."""
    if len(fps) == 2:
        a, b = fps.tolist()
        return ([a], [b]) if (a ^ b).bit_count() <= radius else ([], [])
    left: list[int] = []
    right: list[int] = []
    rest = fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                got = rest[near]
                rest = rest[~near]
                left += [int(x)] * len(got)
                right += got.tolist()
                todo += list(got)
    return left, right


def _search(keys: list[str], radius: int):
    def run(batches):
        held: list[np.ndarray] = []

        def links(parts):
            fps = np.unique(np.concatenate(parts).view(np.uint64)) if len(parts) > 1 or len(parts[0]) > 1 else parts[0]
            return forest(fps, radius) if len(fps) > 1 else ([], [])

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

        left, right = [], []
        for _, first, rows in sorted_groups(batches, keys):
            if first and held:
                if len(held) > 1 or len(held[0]) > 1:
                    a, b = links(held)
                    left += a
                    right += b
                    if len(left) > 50_000:
                        yield out(left, right)
                        left, right = [], []
                held = []
            held.append(rows.column(rows.schema.get_field_index("fp")).to_numpy())
        if held:
            a, b = links(held)
            left, right = left + a, right + b
        yield out(left, right)

    return run


def link_fingerprints(spark: SparkSession, fps: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints fp (signed) within the radius."""
    tables = F.array(*[F.struct(F.lit(k).alias("v"), F.lit(_signed(m)).alias("m")) for k, m in enumerate(masks(radius))])
    rows = fps.select("fp", F.explode(tables).alias("t")).select("fp", F.col("t.v").alias("v"), F.col("fp").bitwiseAND(F.col("t.m")).alias("key"))
    large = settle(spark, rows.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket), "simhash-large")
    n_large = large.count()
    few = rows if not n_large else rows.join(large, ["v", "key"], "left_anti")
    few = few.repartition(partitions(spark), "v", "key").sortWithinPartitions("v", "key")
    out = few.mapInArrow(_search(["v", "key"], radius), "a long, b long")
    if n_large:
        blocks = F.ceil(F.col("n") / (bucket // 2)).cast("int")
        many = rows.join(large, ["v", "key"]).select("fp", "v", "key", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        many = many.select("fp", "v", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        many = many.select("fp", "v", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        many = many.repartition(partitions(spark), "v", "key", "i", "j").sortWithinPartitions("v", "key", "i", "j")
        out = out.unionByName(many.mapInArrow(_search(["v", "key", "i", "j"], radius), "a long, b long"))
    return out


def near_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """id, fp (signed) and component_id of each of docs: the smallest id reachable by links. Null ids rank last."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own = settle(spark, rows.mapInArrow(_fingerprints(words), "id long, fp long"), "simhash-fingerprints")
    nodes = settle(spark, own.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct", own.count())
    n = nodes.count()
    links = settle(spark, link_fingerprints(spark, nodes, radius, bucket).distinct(), "simhash-links", (1 << radius + 1) * n)  # a unit has a forest of links at most
    found = connected_components(spark, links)
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = settle(spark, named, "simhash-named", n)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = settle(spark, named.join(least, "component").select("fp", "component_id"), "simhash-components", n)
    return own.join(by_fp, "fp").select("id", "fp", "component_id")
