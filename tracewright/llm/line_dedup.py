"""Line dedup by sharded cuckoo filters over exact reference-count tables.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z
lower-cased. A key of at least ``min_chars`` code points that at least
``min_docs`` documents hold is *active*: its lines go from every document but
the one with the largest id that holds it.

State of a :class:`LineIndex` (tables in the shared folder):

* ``postings``: one row (key, doc) for each document and distinct long key;
* ``refs``: the exact reference counts (key, n_docs, max_doc);
* ``filters``: one cuckoo filter of the active keys for each shard of the keys.

``insert`` adds documents and ``delete`` takes documents out again. Both count anew
the keys concerned only, and change only the filters of their shards, by
inserting or deleting fingerprints; tables are written anew, as files don't
change. A deletion undoes an insertion: the lines it made redundant come back. A
document that is inserted twice counts twice; deleting its id takes both out.

``apply`` probes the filters first, and then looks up the exact counts of what
they let through. While the filters and the active part of the reference counts
stay within ``broadcast_bytes`` (checked), both go to the tasks and documents
don't move. Beyond that, (key, doc) rows of the documents are joined with the
exact counts by key, after the filters were probed where the rows are, if they
can be sent there; else the distinct keys go to their shard's filter.

There are ``shards`` shards; by default as many as give each ``SHARD_KEYS`` active
keys when the index is begun, 64 at least.

Nulls: a null text is one empty line. A null id ranks below every other id;
where all holders of a key have null ids, all keep it. Each row counts as a
document of its own. Keys are compared by 128-bit hashes. No rows give no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.shared import kept, partitions, settle, sorted_groups

SLOTS = 4
MAX_KICKS = 500
SHARD_KEYS = 1 << 18


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key's second bucket follows from the first and the fingerprint, so that keys can be deleted."""

    def __init__(self, buckets: np.ndarray, stash: list[int] | None = None):
        self.buckets = buckets
        self.mask = len(buckets) - 1
        self.stash = Counter(stash or ())  # how many fingerprints (with a place of theirs) found no room

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        size = 1
        while size * SLOTS * 0.85 < max(n, 1):
            size *= 2
        return cls(np.zeros((size, SLOTS), dtype=np.uint16))

    @staticmethod
    def _spread(fp):
        return (fp.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)

    def _places(self, h: np.ndarray):
        fp = (h >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        one = h & np.uint64(self.mask)
        return fp, one, (one ^ self._spread(fp)) & np.uint64(self.mask)

    def insert(self, hashes: np.ndarray) -> None:
        """Hashes that aren't in the filter yet, each once."""
        fps, ones, twos = (x.tolist() for x in self._places(hashes))
        b = self.buckets
        for h, fp, one, two in zip(hashes.tolist(), fps, ones, twos, strict=True):
            at = one if 0 in b[one] else two
            for kick in range(MAX_KICKS):
                row = b[at]
                free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = fp
                    break
                out = int(row[kick % SLOTS])
                row[kick % SLOTS] = fp
                fp = out
                at = (at ^ ((fp * 0x5BD1E995) >> 7)) & self.mask
            else:  # full: twice the size needs the hashes; keep what was pushed out as a bucket pair
                self.stash[(at << 16) | fp] += 1

    def delete(self, hashes: np.ndarray) -> None:
        """Hashes that are in the filter, as often as they were inserted. One that isn't may take another's fingerprint away, so the exact counts decide what is deleted."""
        fps, ones, twos = (x.tolist() for x in self._places(hashes))
        for fp, one, two in zip(fps, ones, twos, strict=True):
            for at in (one, two):
                if len(hit := np.flatnonzero(self.buckets[at] == fp)):
                    self.buckets[at, hit[0]] = 0
                    break
            else:
                at = next((x for x in ((one << 16) | fp, (two << 16) | fp) if self.stash[x]), None)
                if at is not None:
                    self.stash -= Counter([at])

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(h)
        hit = (self.buckets[one] == fp[:, None]).any(1) | (self.buckets[two] == fp[:, None]).any(1)
        if self.stash:
            for at in (one, two):
                hit |= np.isin((at << np.uint64(16)) | fp.astype(np.uint64), np.fromiter(self.stash, dtype=np.uint64))
        return hit

    def to_bytes(self) -> bytes:
        return len(self.buckets).to_bytes(8, "little") + self.buckets.tobytes() + np.fromiter(sorted(self.stash.elements()), dtype=np.uint64).tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        n = int.from_bytes(blob[:8], "little")
        end = 8 + n * SLOTS * 2
        return cls(np.frombuffer(blob[8:end], dtype=np.uint16).reshape(n, SLOTS).copy(), np.frombuffer(blob[end:], dtype=np.uint64).tolist())


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def long_keys(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """The 128-bit hash of each line's key; None for keys under min_chars code points."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    out = []
    for line in lines:
        key = line.strip().lower()
        n = len(key)
        out.append(digest(key) if n >= min_chars and (key.isascii() or len(key.decode()) >= min_chars) else None)
    return out


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _postings(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("lines", bool)
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                found = set(long_keys(text.split(b"\n"), min_chars))
                found.discard(None)
                keys += found
                ids += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc"])

    return run


def _half(keys: list[bytes], half: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)[:, half].copy() if keys else np.zeros(0, dtype=np.uint64)


def _build(pdf):
    import pandas as pd

    keys = _half(pdf["key"].tolist(), 0)
    f = CuckooFilter.sized(len(keys))
    f.insert(keys)
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1].tolist(), "filter": [f.to_bytes()]})


def _update(key, state, change):
    """The shard's filter after deletions and insertions; rebuilt twice as large where it would be too full."""
    import pandas as pd

    gone, new = (_half(change["key"][change["add"] == a].tolist(), 0) for a in (False, True))
    f = CuckooFilter.from_bytes(state["filter"].iloc[0]) if len(state) else CuckooFilter.sized(len(new))
    f.delete(gone)
    f.insert(new)
    return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes()]})


@dataclass(frozen=True)
class LineIndex:
    """Reversible state of line dedup; see the module's text."""

    spark: SparkSession
    min_chars: int = 20
    min_docs: int = 3
    shards: int | None = None
    broadcast_bytes: int = 64 << 20
    postings: DataFrame | None = None
    refs: DataFrame | None = None
    filters: DataFrame | None = None

    def _shard(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int")

    def _posted(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
        return rows.mapInArrow(_postings(self.min_chars), "key binary, doc long")

    @staticmethod
    def _count(postings: DataFrame) -> DataFrame:
        return postings.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("max_doc"))

    def active(self) -> DataFrame:
        return self.refs.filter(F.col("n_docs") >= self.min_docs)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with these documents too; an id that it holds already counts again."""
        new = settle(self.spark, self._posted(docs, id_col, text_col), "line-postings")
        if self.refs is None:
            out = replace(self, postings=new, refs=settle(self.spark, self._count(new), "line-refs"))
            out = replace(out, shards=self.shards or max(64, -(-out.active().count() // SHARD_KEYS)))
            built = out.active().select("key", out._shard(F.col("key")).alias("shard")).groupBy("shard").applyInPandas(_build, "shard int, filter binary")
            return replace(out, filters=settle(self.spark, built, "line-filters", out.shards))
        added = settle(self.spark, self._count(new), "line-added")
        touched = added.select("key")
        merged = self.refs.join(touched, "key", "left_semi").unionByName(added).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        refs = self.refs.join(touched, "key", "left_anti").unionByName(merged)
        return self._moved(self.postings.unionByName(new), settle(self.spark, refs, "line-refs"), touched)

    def delete(self, doc_ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The index as if the documents with these ids had never been inserted."""
        gone = doc_ids.select(F.col(id_col).cast("long").alias("doc")).distinct()
        rest = settle(self.spark, self.postings.join(gone, self.postings["doc"].eqNullSafe(gone["doc"]), "left_anti"), "line-postings")
        touched = self.postings.join(gone, self.postings["doc"].eqNullSafe(gone["doc"]), "left_semi").select("key").distinct()
        touched = settle(self.spark, touched, "line-touched")
        counted = self._count(rest.join(touched, "key", "left_semi"))
        refs = self.refs.join(touched, "key", "left_anti").unionByName(counted)
        return self._moved(rest, settle(self.spark, refs, "line-refs"), touched)

    def _moved(self, postings: DataFrame, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """With these postings and counts; the filters follow where a touched key became active or ceased to be."""
        out = replace(self, postings=postings, refs=refs)
        was, now = (x.active().join(touched, "key", "left_semi").select("key") for x in (self, out))
        change = was.join(now, "key", "left_anti").withColumn("add", F.lit(False)).unionByName(now.join(was, "key", "left_anti").withColumn("add", F.lit(True)))
        change = settle(self.spark, change.withColumn("shard", self._shard(F.col("key"))), "line-change")
        kept = self.filters.join(change.select("shard").distinct(), "shard", "left_anti")
        over = out._overfull(change)
        moved = self.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(_update, "shard int, filter binary")
        moved = moved.join(change.select("shard").distinct(), "shard", "left_semi").join(over, "shard", "left_anti")
        rebuilt = out.active().select("key", self._shard(F.col("key")).alias("shard")).join(over, "shard", "left_semi").groupBy("shard").applyInPandas(_build, "shard int, filter binary")
        return replace(out, filters=settle(self.spark, kept.join(over, "shard", "left_anti").unionByName(moved).unionByName(rebuilt), "line-filters", self.shards))

    def _overfull(self, change: DataFrame) -> DataFrame:
        """Shards with more keys than their filter is sized for; these are built anew, at a fitting size."""
        n = self.active().groupBy(self._shard(F.col("key")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
        room = self.filters.select("shard", ((F.length("filter") - 8) / 2 * 0.85).alias("room"))
        return n.join(room, "shard", "left").filter(F.col("room").isNull() | (F.col("n") > F.col("room"))).select("shard").join(change.select("shard").distinct(), "shard", "left_semi")

    def _hits(self, keys: DataFrame) -> DataFrame:
        """Those of distinct keys that their shard's filter holds. Keys go to the filters, in order, so that a task has one filter and a batch of keys at a time."""
        blank = F.lit(None).cast("binary")
        rows = self.filters.select("shard", "filter", blank.alias("key")).unionByName(keys.select(self._shard(F.col("key")).alias("shard"), blank.alias("filter"), "key"))
        dealt = rows.repartition(max(partitions(self.spark), self.shards), "shard").sortWithinPartitions("shard", F.col("filter").isNull())
        return dealt.mapInArrow(_probe_dealt, "key binary")

    def sizes(self) -> tuple[int, int]:
        """Bytes of all filters, and of the active reference counts as arrays."""
        f = self.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        return int(f), 25 * self.active().count()

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs with text_col less its redundant lines, and n_lines (before) and n_dropped. All other columns stay; columns of these two names are replaced."""
        f_bytes, a_bytes = self.sizes()
        sc = self.spark.sparkContext
        filters = sc.broadcast({s: b for s, b in self.filters.collect()}) if f_bytes <= self.broadcast_bytes else None
        rest = [c for c in docs.columns if c != text_col]
        out = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest"), F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"))
        if filters is not None and a_bytes <= self.broadcast_bytes:
            got = self.active().select("key", "max_doc").toArrow()
            keys = got.column("key").combine_chunks().to_pylist()
            order = np.argsort(lo := _half(keys, 0), kind="stable")
            largest = got.column("max_doc").combine_chunks()
            exact = sc.broadcast((lo[order], _half(keys, 1)[order], largest.fill_null(0).to_numpy()[order], largest.is_null().to_numpy(zero_copy_only=False)[order]))
            run = _drop_exact(filters, exact, self.min_chars, self.shards, uuid.uuid4().hex)
            found = out.withColumn("_drop", F.lit(None).cast("array<binary>"))
        else:
            posted = self._posted(docs, id_col, text_col)
            if filters is not None:
                hits, exact = posted.mapInArrow(_probe(filters, self.shards, uuid.uuid4().hex), "key binary, doc long"), self.active()
            else:
                hits = posted = settle(self.spark, posted, "line-asked")
                exact = self.active().join(self._hits(posted.select("key").distinct()), "key", "left_semi")
            lose = hits.join(exact.select("key", "max_doc"), "key").filter(~F.col("doc").eqNullSafe(F.col("max_doc")))
            lose = lose.groupBy(F.col("doc").alias("_lose")).agg(F.collect_set("key").alias("_drop"))
            found = out.join(lose, F.col("_doc").eqNullSafe(F.col("_lose")), "left").drop("_lose")
            run = _drop_listed(self.min_chars)
        schema = T.StructType([found.schema["_rest"], T.StructField("_new", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        done = found.select("_rest", "_doc", "_text", "_drop").mapInArrow(run, schema)
        named = [F.col("_new").alias(c) if c == text_col else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
        return done.select(*named, "n_lines", "n_dropped")


def _emit(batch: pa.RecordBatch, texts: list[bytes], n: list[int], dropped: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], ["_rest", "_new", "n_lines", "n_dropped"])


def _shards_of(keys: list[bytes], shards: int) -> np.ndarray:
    """As Spark's pmod(xxhash64(key), shards)."""
    import xxhash

    h = np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), dtype=np.uint64, count=len(keys)).view(np.int64)
    return np.mod(h, shards)


class _Filters:
    """The filters of all shards, opened once in each worker."""

    def __init__(self, blobs: dict[int, bytes], shards: int):
        self.by_shard, self.shards = {s: CuckooFilter.from_bytes(b) for s, b in blobs.items()}, shards

    def hits(self, keys: list[bytes]) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        lo, shard = _half(keys, 0), _shards_of(keys, self.shards)
        for s in np.unique(shard).tolist():
            if s in self.by_shard:
                at = shard == s
                out[at] = self.by_shard[s].contains(lo[at])
        return out


def _drop_exact(filters, exact, min_chars: int, shards: int, token: str):
    def run(batches):
        probe, (lo, hi, keep, no_id) = kept(("line filters", token), lambda: _Filters(filters.value, shards)), exact.value
        for batch in batches:
            docs = batch.column(1).to_pylist()
            lines = [t.split(b"\n") for t in _texts(batch.column(2))]
            keys = [long_keys(x, min_chars) for x in lines]
            asked = list({k for x in keys for k in x} - {None})
            asked = [k for k, hit in zip(asked, probe.hits(asked).tolist(), strict=True) if hit]
            largest = {}
            for k, a, b in zip(asked, _half(asked, 0), _half(asked, 1), strict=True):  # the filter's hits, against the exact counts
                i = int(np.searchsorted(lo, a))
                while i < len(lo) and lo[i] == a:
                    if hi[i] == b:
                        largest[k] = None if no_id[i] else int(keep[i])
                        break
                    i += 1
            texts, n, dropped = [], [], []
            for doc, own, ks in zip(docs, lines, keys, strict=True):
                stay = [x for x, k in zip(own, ks, strict=True) if k is None or k not in largest or largest[k] == doc]
                texts.append(b"\n".join(stay))
                n.append(len(own))
                dropped.append(len(own) - len(stay))
            yield _emit(batch, texts, n, dropped)

    return run


def _drop_listed(min_chars: int):
    def run(batches):
        for batch in batches:
            texts, n, dropped = [], [], []
            for text, drop in zip(_texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                own = text.split(b"\n")
                gone = set(drop or ())
                stay = [x for x, k in zip(own, long_keys(own, min_chars), strict=True) if k not in gone] if gone else own
                texts.append(b"\n".join(stay))
                n.append(len(own))
                dropped.append(len(own) - len(stay))
            yield _emit(batch, texts, n, dropped)

    return run


def _probe(filters, shards: int, token: str):
    def run(batches):
        probe = kept(("line filters", token), lambda: _Filters(filters.value, shards))
        for batch in batches:
            yield batch.filter(pa.array(probe.hits(batch.column(0).to_pylist())))

    return run


def _probe_dealt(batches):
    now = None
    for _, first, rows in sorted_groups(batches, ["shard"]):
        if first:
            now = None  # a shard without a filter holds no key
        blobs, keys = rows.column(1).to_pylist(), rows.column(2).to_pylist()
        at = 0
        if blobs[0] is not None:
            now, at = CuckooFilter.from_bytes(blobs[0]), 1
        if now is not None and keys[at:]:
            own = pa.array(keys[at:], pa.binary())
            yield pa.RecordBatch.from_arrays([own.filter(pa.array(now.contains(_half(keys[at:], 0))))], ["key"])


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One batch through a new index."""
    return LineIndex(spark, **options).insert(docs, id_col, text_col).apply(docs, id_col, text_col)
