"""Embedding near-dedup with a pivot-permutation index.

* Pivots: rows of the table, the first by a hash of their values; as many as the
  square root of the rows times ``pivot_factor`` (``max_pivots`` at most, which
  bounds what is broadcast).
* Every vector is described by its ``prefix`` nearest pivots, the nearest first,
  and goes into the inverted lists of the first ``lists`` of them. All rows are
  indexed.
* Retrieval: two vectors of a list are candidates if their descriptions share at
  least ``min_shared`` pivots (never more than there are). Shared pivots are
  counted first; a pair is counted in the list of its first common one alone.
* Verification of the candidates: cosine in double precision, at least
  ``threshold``.

What the index misses are pairs without a common list or with too few shared
pivots. ``exact=True`` compares all pairs, as one list without pivots.

Lists of over ``block`` vectors are dealt into blocks, and every two blocks are a
unit of work. A unit yields a count per vector and the links of a spanning
forest, never all pairs. Equal vectors (by a 128-bit hash) share one row in the
lists, so copies cost nothing; they link with each other and their links count
once for each.

Vectors that are null, zero, or hold null or non-finite components link with
nothing. Vectors of different lengths don't link; each length is worked out on
its own. Repeated ids are vectors of their own. Null ids link like others:
component_id is the smallest id that isn't null, or null where all are, and then
all are kept. No rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.components import connected_components
from tracewright.llm.shared import partitions, settle, sorted_groups

#: Vectors with over HOT_ROWS copies, and over a HOT_GROUPS-th of all rows, are joined by broadcast.
HOT_ROWS, HOT_GROUPS = 256, 10_000
STEP = 512  # rows that are compared with a block at a time


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the scale by the largest component first keeps squares in range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _describe(shared, prefix: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        k = min(prefix, len(pivots))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                near = unit_rows(_matrix(part.column(2), dim)) @ pivots.T
                best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(near), 1))
                order = np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable"), 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["node", "n", "v", "prefix"])

    return run


def candidates(a: np.ndarray, b: np.ndarray, pivot: int, lists: int, min_shared: int) -> np.ndarray:
    """Which rows of a and of b (descriptions, all in this pivot's list) share enough pivots and no list of a smaller number."""
    shared = np.zeros((len(a), len(b)), dtype=np.uint8)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            shared += a[:, i, None] == b[None, :, j]
    fits = shared >= min_shared
    first, second = a[:, :lists], b[:, :lists]
    first, second = np.where(first < pivot, first, -1), np.where(second < pivot, second, -2)
    for i in range(first.shape[1]):
        if (first[:, i] >= 0).any():
            for j in range(second.shape[1]):
                fits &= first[:, i, None] != second[None, :, j]
    return fits


def _compare(keys: list[str], dim: int, threshold: float, lists: int, min_shared: int):
    def unit(pivot: int, parts: list[pa.RecordBatch], i: int, j: int):
        rows = pa.Table.from_batches(parts)
        node, n, own = rows["node"].to_numpy(), rows["n"].to_numpy(), rows["own"].to_numpy()
        x = unit_rows(_matrix(rows["v"], dim))
        prefix = np.array(rows["prefix"].to_pylist(), dtype=np.int32).reshape(len(x), -1)
        degree, left, right = np.zeros(len(x), dtype=np.int64), [], []
        root = np.arange(len(x))

        def find(a):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for at in range(0, len(x), STEP):
            fits = candidates(prefix[at : at + STEP], prefix[at:], pivot, lists, min_shared) if prefix.shape[1] else np.ones((len(x[at : at + STEP]), len(x) - at), dtype=bool)
            if i != j:  # only pairs between the two blocks
                fits &= own[at : at + STEP, None] != own[None, at:]
            fits = np.triu(fits, 1)
            if fits.mean() > 0.02:
                near = np.argwhere(fits & (x[at : at + STEP] @ x[at:].T >= threshold)) + at
            else:
                near = np.argwhere(fits) + at
                near = near[np.einsum("ij,ij->i", x[near[:, 0]], x[near[:, 1]]) >= threshold]
            for a, b in ((0, 1), (1, 0)):
                degree += np.bincount(near[:, a], weights=n[near[:, b]], minlength=len(x)).astype(np.int64)
            for a, b in near.tolist():
                if (p := find(a)) != (q := find(b)):
                    root[max(p, q)] = min(p, q)
                    left.append(node[a])
                    right.append(node[b])
        hit = degree > 0
        return node[hit].tolist() + left, [None] * int(hit.sum()) + right, degree[hit].tolist() + [0] * len(left)

    def run(batches):
        held: list[pa.RecordBatch] = []
        now: tuple = ()

        def out():
            a, b, d = unit(int(now[0]), held, int(now[1]), int(now[2]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.int64())], ["a", "b", "degree"])

        for key, first, rows in sorted_groups(batches, keys):
            if first and held:
                yield out()
                held = []
            now = key
            held.append(rows)
        if held:
            yield out()

    return run


def _links(spark: SparkSession, nodes: DataFrame, n: int, dim: int, threshold: float, prefix: int, lists: int, min_shared: int, m: int, block: int, exact: bool) -> DataFrame:
    """(a, b, degree) of n nodes (node, n, v) of one length: degrees where b is null, else links of forests."""
    if exact:
        described = nodes.withColumn("prefix", F.array().cast("array<int>"))
        listed = described.withColumn("pivot", F.lit(0))
    else:
        first = nodes.select(F.xxhash64("v").alias("h"), "node").orderBy("h", "node").limit(m)
        pivots = nodes.join(F.broadcast(first.select("node")), "node", "left_semi").select("v").collect()  # m rows
        pivots = unit_rows(np.array([r[0] for r in pivots], dtype=np.float64))
        described = settle(spark, nodes.select("node", "n", "v").mapInArrow(_describe(spark.sparkContext.broadcast(pivots), prefix, dim), "node long, n long, v array<double>, prefix array<int>"), "embed-described")
        listed = described.withColumn("pivot", F.explode(F.slice("prefix", 1, lists)))
    sizes = listed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = listed.join(F.broadcast(sizes), "pivot")  # a row per pivot, m at most
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "n", "v", "prefix", "pivot", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    keys = ["pivot", "i", "j"]
    dealt = rows.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_compare(keys, dim, threshold, lists, min_shared), "a long, b long, degree long")


def near_vectors(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, prefix: int = 10, lists: int = 8, min_shared: int = 2, pivot_factor: float = 2.0, max_pivots: int = 1 << 15, block: int = 2048, exact: bool = False) -> DataFrame:
    """id, n_links, component_id and kept of each of vectors."""
    all_rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.exists("v", lambda c: c != 0)
    # -0.0 and 0.0 are one number, so equal vectors meet.
    clean = all_rows.select("id", F.when(sound, F.transform("v", lambda c: c + F.lit(0.0))).alias("v"))
    keyed = clean.select("id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("g"))
    groups = keyed.filter("v IS NOT NULL").groupBy("h", "g").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    nodes = settle(spark, groups.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "embed-nodes")
    found: DataFrame | None = None
    total = 0
    for dim, n in sorted(tuple(r) for r in nodes.groupBy("dim").count().collect()):  # a row per length
        m = max(1, min(max_pivots, n, round(pivot_factor * n**0.5)))
        own = _links(spark, nodes.filter(F.col("dim") == dim), n, dim, threshold, prefix, lists, min(min_shared, prefix, m), m, block, exact)
        found = own if found is None else found.unionByName(own)
        total += n
    if found is None:
        return all_rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    got = settle(spark, found, "embed-found")
    degree = got.filter("b IS NULL").groupBy("a").agg(F.sum("degree").alias("degree"))
    joined = connected_components(spark, got.filter("b IS NOT NULL").select("a", "b"))
    named = nodes.select("h", "g", "node", "least", "n").join(degree, nodes["node"] == degree["a"], "left").join(joined, "node", "left")
    named = settle(spark, named.select("h", "g", "least", (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"), "n"), "embed-named", total)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = settle(spark, named.join(least, "component").select("h", "g", "n_links", "component_id", "n"), "embed-least", total)
    # Copies of a vector that has very many would meet in one task: at most HOT_GROUPS such vectors are broadcast.
    limit = max(HOT_ROWS, all_rows.count() // HOT_GROUPS)
    hot = named.filter(F.col("n") > limit).select("h", "g", "n_links", "component_id")
    rest = named.filter(F.col("n") <= limit).select("h", "g", "n_links", "component_id")
    ids = keyed.select("id", "h", "g")
    out = ids.join(F.broadcast(hot.withColumnsRenamed({"n_links": "hot_links", "component_id": "hot_component"}).withColumn("is_hot", F.lit(True))), ["h", "g"], "left")
    cold = out.filter("is_hot IS NULL").select("id", "h", "g").join(rest, ["h", "g"], "left").select("id", F.col("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    out = cold.unionByName(out.filter("is_hot").select("id", F.col("hot_links").alias("n_links"), F.col("hot_component").alias("component_id")))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
