"""Token output as one wavelet matrix per shard.

A shard file (bytes, little-endian)::

    "WVM1" | tokens u64 | documents u64 | bits u8 | size of the packed part u64
    packed by zstandard:
      document ids i64 each | document lengths u64 each
      for each bit from the highest: zeros u64, the bit-plane (8 tokens a byte)

In plane 0 tokens stand in order; each further plane holds them stably
partitioned by the bits before. With ranks at 512-token steps, made on opening,
``access`` (the token at a place), ``rank`` (how often a token occurs before a
place) and ``select`` (the place of its n-th occurrence) take a step a plane;
``tokens`` undoes all planes at once.

Shards hold whole documents in ascending id order (nulls first) and about
``shard_tokens`` tokens; a longer document is a shard of its own. Documents are
dealt by ranges of their ids; where every document before a shard ends follows
from the sizes of the ranges (one number each reaches the driver) and of the
shards before it in its range. Files are rows of a table, so Spark's writer
takes them to any store; ``export`` writes them as single files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.bpe import vocabulary
from tracewright.llm.shared import partitions, settle

MAGIC = b"WVM1"
STEP = 512
#: Encoded words that a worker keeps; with their spaces and case they are more than others keep.
WORDS_KEPT = 900_000
FILES = "part int, shard int, documents long, before long, tokens long, file binary"


def build(tokens: np.ndarray, ids: list[int | None], lengths: list[int], bits: int) -> bytes:
    """A shard file."""
    import zstandard

    out = [np.array([np.iinfo(np.int64).min if i is None else i for i in ids], dtype="<i8").tobytes(), np.array(lengths, dtype="<u8").tobytes()]
    kind = np.uint16 if bits <= 16 else np.uint32
    now = tokens.astype(kind)
    for bit in range(bits - 1, -1, -1):
        one = (now & kind(1 << bit)).astype(bool)
        zeros = len(now) - int(np.count_nonzero(one))
        out += [struct.pack("<Q", zeros), np.packbits(one, bitorder="little").tobytes()]
        dealt = np.empty_like(now)
        np.compress(~one, now, out=dealt[:zeros])
        np.compress(one, now, out=dealt[zeros:])
        now = dealt
    packed = zstandard.ZstdCompressor(level=1).compress(b"".join(out))
    return MAGIC + struct.pack("<QQBQ", len(tokens), len(ids), bits, len(packed)) + packed


class Shard:
    """An opened shard file."""

    def __init__(self, file: bytes):
        import zstandard

        if file[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.n, documents, self.bits, size = struct.unpack_from("<QQBQ", file, 4)
        head = 4 + struct.calcsize("<QQBQ")
        raw = zstandard.ZstdDecompressor().decompress(file[head : head + size])
        ids = np.frombuffer(raw, dtype="<i8", count=documents)
        self.ids = [None if i == np.iinfo(np.int64).min else i for i in ids.tolist()]
        self.lengths = np.frombuffer(raw, dtype="<u8", count=documents, offset=8 * documents).astype(np.int64)
        at, plane = 16 * documents, (self.n + 7) // 8
        self.zeros, self.planes = [], []
        for _ in range(self.bits):
            self.zeros.append(struct.unpack_from("<Q", raw, at)[0])
            self.planes.append(np.frombuffer(raw, dtype=np.uint8, count=plane, offset=at + 8))
            at += 8 + plane
        self.ranks: list[np.ndarray] | None = None

    def _ones(self, plane: int, at: int) -> int:
        """Ones before a place."""
        if self.ranks is None:
            width = STEP // 8
            self.ranks = [np.r_[0, np.cumsum([int(np.bitwise_count(p[i : i + width]).sum()) for i in range(0, len(p), width)])].astype(np.int64) for p in self.planes]
        block, byte = at // STEP, at // 8
        n = int(self.ranks[plane][block]) + int(np.bitwise_count(self.planes[plane][block * STEP // 8 : byte]).sum())
        return n + (int(self.planes[plane][byte] & ((1 << at % 8) - 1)).bit_count() if at % 8 else 0)

    def access(self, at: int) -> int:
        """The token at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for k in range(self.bits):
            one = int(self.planes[k][at // 8]) >> at % 8 & 1
            ones = self._ones(k, at)
            at = self.zeros[k] + ones if one else at - ones
            token = token << 1 | one
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for k in range(self.bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> self.bits - 1 - k & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, end: int | None = None) -> int:
        """How often the token occurs before a place (in the shard, if none is given)."""
        if token >> self.bits:
            return 0
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def select(self, token: int, nth: int) -> int:
        """The place of the token's occurrence number nth, from 0."""
        if token >> self.bits:
            raise IndexError(nth)
        lo, hi = self._range(token, self.n)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        at = lo + nth
        for k in range(self.bits - 1, -1, -1):
            one = token >> self.bits - 1 - k & 1
            at = self._nth(k, one, at - self.zeros[k] if one else at)
        return at

    def _nth(self, plane: int, bit: int, nth: int) -> int:
        """The place of the bit's occurrence number nth in a plane: a binary search over ranks."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > nth:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def tokens(self) -> np.ndarray:
        """All tokens in order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, dtype=kind)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, dtype=kind)
            up[np.flatnonzero(~one)] = now[: self.zeros[k]]
            up[np.flatnonzero(one)] = now[self.zeros[k] :] | kind(1 << self.bits - 1 - k)
            now = up
        return now


def _write(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = vocabulary(path, "library", WORDS_KEPT)
        bits = max(max(v.names), end_id).bit_length()
        part, shard, end = TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        held: list[bytes] = []
        ids: list[int | None] = []
        size = before = 0

        def flush():
            file = build(np.frombuffer(b"".join(held), dtype="<u4"), ids, [len(x) // 4 for x in held], bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([file], pa.binary())], ["part", "shard", "documents", "before", "tokens", "file"])

        for batch in batches:
            for doc, got in zip(batch.column(0).to_pylist(), v.batch([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                n = len(got) // 4 + 1
                if held and size + n > shard_tokens:
                    yield flush()
                    held, ids, size, shard, before = [], [], 0, shard + 1, before + size
                held.append(got + end)
                ids.append(doc)
                size += n
        if held:
            yield flush()

    return run


def write_shards(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_tokens: int = 1 << 20) -> DataFrame:
    """Shard files in ascending id order, stored in the shared folder: (part, shard, documents, before, tokens, file)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "text")
    return settle(spark, ordered.mapInArrow(_write(path, end_id, shard_tokens), FILES), "wavelet-shards")


def _save(folder: str):
    def run(rows):
        from pyarrow import fs

        for row in rows:
            store, at = fs.FileSystem.from_uri(folder)
            with store.open_output_stream(f"{at.rstrip('/')}/part-{row.part:05d}-{row.shard:05d}.wvm") as f:
                f.write(row.file)

    return run


def export(files: DataFrame, folder: str) -> None:
    """Each shard as one file part-NNNNN-NNNNN.wvm in an existing folder, a URI that all executors can write."""
    files.select("part", "shard", "file").foreachPartition(_save(folder))


def _read(starts):
    def run(batches):
        first = starts.value
        for batch in batches:
            for part, file, before in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                shard = Shard(file.as_py())
                raw = shard.tokens().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.ids, pa.int64()), pa.array(begins + before + first[part]), pa.array(shard.lengths), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return run


def read_documents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Each document as the shard files hold it: id, start, n_tokens, ids_crc32."""
    starts, at = {}, 0
    for part, n in sorted(files.groupBy("part").agg(F.sum("tokens")).collect()):  # a number for each range
        starts[part], at = at, at + n
    return files.select("part", "file", "before").mapInArrow(_read(spark.sparkContext.broadcast(starts)), "id long, start long, n_tokens long, ids_crc32 long")


def _count(token: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([Shard(f.as_py()).rank(token) for f in batch.column(2)], pa.int64())], ["part", "shard", "n"])

    return run


def count_token(files: DataFrame, token: int) -> DataFrame:
    """How often a token occurs in each shard, from the files' ranks: (part, shard, n)."""
    return files.select("part", "shard", "file").mapInArrow(_count(token), "part int, shard int, n long")
