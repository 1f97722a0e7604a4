"""Best-fit packing after Martello and Toth's dominance reduction.

Documents become token pieces of at most ``capacity``; only longer documents are
cut. Pieces go into as few sequences as the heuristic finds, without gaps:

1. What is packed is the histogram of piece lengths, at most ``capacity`` rows
   whatever the corpus; it alone reaches the driver.
2. Dominance reduction: for the longest length left, a set that holds it and
   dominates every other feasible set that does (it alone where nothing fits
   beside it; with the longest that fits, where that fills the sequence or only
   one more can fit; the pair or triple rules where at most two more can fit)
   is in some best packing, and is fixed for good, for all pieces of these
   lengths at once. What is left is smaller.
3. Best-fit decreasing packs the rest: the longest first, each into the fullest
   sequence that has room. Equal sequences move together as one run, so the
   steps depend on the lengths and not on the number of pieces.
4. Pieces of a length are numbered within salted buckets, which the bucket sizes
   turn into ranks; a rank finds its place in the list of runs by binary search.

At most two runs split for each length and new runs open once for each, and a
sequence holds at most sqrt(2 * capacity) different lengths; this bounds the
broadcast list of runs for any corpus.

A null text is empty: one piece with the end token. Repeated ids are packed as
rows of their own. No rows in: no rows out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.bpe import vocabulary
from tracewright.llm.shared import settle

#: So many sequences, each with these (length, copies), in this order.
Pattern = tuple[int, tuple[tuple[int, int], ...]]


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, "library")
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), v.batch([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, piece, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns[: 5 + with_ids], ["doc", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return run


def reduce_by_dominance(counts: list[int], capacity: int) -> tuple[list[Pattern], list[int]]:
    """Sequences that are in some best packing, and the counts that they leave. counts[n]: pieces of length n."""
    counts, fixed = list(counts), []
    lengths = sorted(n for n in range(1, capacity + 1) if counts[n])

    def take(*own: int) -> None:
        need = {n: own.count(n) for n in own}
        times = min(counts[n] // k for n, k in need.items())
        fixed.append((times, tuple(sorted(need.items(), reverse=True))))
        for n, k in need.items():
            counts[n] -= times * k
            if not counts[n]:
                lengths.remove(n)

    def smallest(but: int, n: int) -> list[int]:
        """The n smallest pieces beside one of length but."""
        out: list[int] = []
        for x in lengths:
            out += [x] * min(n - len(out), counts[x] - (x == but))
            if len(out) == n:
                break
        return out

    for long in range(capacity, 0, -1):
        while counts[long]:
            room, few = capacity - long, smallest(long, 3)
            if not few or few[0] > room:
                take(long)
                continue
            i = bisect_left(lengths, room + 1) - 1
            while lengths[i] == long and counts[long] < 2:
                i -= 1
            beside = lengths[i]
            if beside == room or len(few) == 1 or few[0] + few[1] > room:
                take(long, beside)
                continue
            if len(few) < 3 or sum(few) > room:
                two = _best_two(lengths, counts, long, room)
                if two is None or beside >= sum(two):
                    take(long, beside)
                    continue
                a, b = two
                between = [x for x in lengths[bisect_left(lengths, b + 1) :] if x < a for _ in range(min(2, counts[x] - (x == long)))][:2]
                if beside == a and (len(between) < 2 or sum(between) > room):  # no two between b and a fit instead
                    take(long, a, b)
                    continue
            break
    return fixed, counts


def _best_two(lengths: list[int], counts: list[int], but: int, room: int) -> tuple[int, int] | None:
    """The two pieces (the longer first) beside one of length but that fill room best."""
    best, lo, hi = None, 0, len(lengths) - 1
    free = lambda x: counts[x] - (x == but)
    while lo <= hi:
        a, b = lengths[hi], lengths[lo]
        if a + b > room or free(a) < 1:
            hi -= 1
        elif free(b) < 1 or (a == b and free(a) < 2):
            lo += 1
        else:
            if best is None or a + b > sum(best):
                best = (a, b)
            lo += 1
    return best


def best_fit(counts: list[int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram."""
    rooms: list[int] = []  # those with open sequences, ascending
    open_: dict[int, list[Pattern]] = {}

    def put(room: int, run: Pattern) -> None:
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append(run)

    for length in range(capacity, 0, -1):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, run = capacity, (left, ())
            else:
                room = rooms[at]
                run = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            each = room // length  # the sequence just used stays the fullest that fits
            n, own = run
            full = min(n, left // each)
            if full:
                put(room - each * length, (full, (*own, (length, each))))
            left -= full * each
            n -= full
            if n and left and left < each:
                put(room - left * length, (1, (*own, (length, left))))
                n, left = n - 1, 0
            if n and own:
                put(room, (n, own))
    return [run for runs in open_.values() for run in runs]


def plan(counts: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, copies in each, offset of the first), sorted; and the number of sequences."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    at, sequences, rows = [0] * (capacity + 1), 0, []
    for n, own in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for length, each in own:
            rows.append((length, at[length], sequences, each, offset))
            at[length] += n * each
            offset += length * each
        sequences += n
    assert at == [0, *counts[1:]], "each piece has one place"
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), sequences


def _place(runs):
    def run(batches):
        r = runs.value
        keys = (r[:, 0] << 44) + r[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            own = r[np.searchsorted(keys, (length << 44) + rank, side="right") - 1] if len(rank) else np.zeros((0, 5), dtype=np.int64)
            j = rank - own[:, 1]
            keep = [c for c in batch.schema.names if c != "rank"]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own[:, 2] + j // own[:, 3]), pa.array(own[:, 4] + j % own[:, 3] * length)], [*keep, "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False, bucket_rows: int = 20_000) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = settle(spark, rows.mapInArrow(_cut(path, capacity, end_id, with_ids), schema), "pack-pieces")
    counts = [0] * (capacity + 1)
    for length, n in pieces.groupBy("length").count().collect():  # at most capacity rows
        counts[length] = n
    runs, _ = plan(counts, capacity)
    buckets = max(1, -(-sum(counts) // bucket_rows))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc", "piece"), F.lit(buckets)))
    own = Window.partitionBy("length", "bucket")
    ranked = dealt.withColumn("rank", F.row_number().over(own.orderBy("doc", "piece")).cast("long") - 1)
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = ranked.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).select(*pieces.columns, "rank")
    placed = ranked.mapInArrow(_place(spark.sparkContext.broadcast(runs)), schema + ", sequence_id long, offset long")
    return placed.withColumnRenamed("doc", id_col)
