"""Spelling variants of words, by full neighbourhood generation.

A word's neighbourhood is every string that one deleted, replaced or inserted code point of
the observed alphabet makes of it, each once: of equal neighbours only the last
is deleted, a code point is never replaced by itself, and one that equals the
code point it would stand before is inserted behind it instead. Candidates that are words are
neighbours, so no distance is computed; the join with the vocabulary by the string decides.

A word of ten letters has over a thousand candidates. They are made as hashes: a
polynomial hash of a candidate follows from those of the word's prefixes, for many words at once.
A bitmap over the vocabulary's hashes, broadcast in slices of at most
``SLICE_BITS`` (as many passes over the words as there are slices), tells which candidates
may be words; those few become strings and go to the hash join. The bitmap errs on one side only.

Words are the runs of ``[A-Za-z\\u00C0-\\u00FF]`` in whole texts, with A-Z lower-cased, of
``min_length`` code points and ``min_count`` occurrences at least. A word's form is
its most frequent neighbour (ties: the smallest in code-point order), if
that occurs ``ratio`` times as often at least; its root is where forms end. Frequencies at
least double along forms for the ratio 2, so chains are short, and pointers that double their
reach settle them in a number of joins that the largest frequency gives.

Null and empty texts have no words; no rows give no words. Repeated rows count again. A null id
counts as the empty text where ids matter (``drop_every``). Texts are read in pieces cut between runs, so a
very long one costs no more memory. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.shared import kept, partitions, settle, sorted_groups

RUN = re.compile("[a-zÀ-ÿ]+")
GAP = re.compile("[^a-zÀ-ÿ]")
PIECE = 1 << 20
#: Distinct words that a task counts before it sends them on.
HELD = 1 << 18
#: Bits of the bitmap for a word, and of one slice of it (64 MB) at most.
BITS_PER_WORD = 32
SLICE_BITS = 1 << 29
#: Bits of one row of a slice while it is built.
BLOCK_BITS = 1 << 19
#: Candidates that are made at once.
AT_ONCE = 1 << 20

BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _pieces(text: str) -> Iterator[str]:
    """The text in parts of about PIECE code points, cut where no run is."""
    at = 0
    while len(text) - at > PIECE:
        cut = GAP.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _runs(drop_every: int | None, min_length: int):
    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("variants-words", bool)
        held: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1)).to_pylist(), strict=True):
                seed = zlib.crc32(f"{i or ''}:".encode())
                for piece in _pieces(text or ""):
                    for word, n in Counter(RUN.findall(piece)).items():
                        if drop_every:
                            h = zlib.crc32(word.encode(), seed)
                            if h % drop_every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                        if len(word) >= min_length:
                            held[word] += n
                    if len(held) > HELD:
                        yield out(held)
                        held = Counter()
        yield out(held)

    return run


def vocabulary(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, drop_every: int | None = None) -> DataFrame:
    """word, n of whole texts. drop_every plants slips: where it divides the crc32 of ``<id>:<run>``, the run loses the code point at that number modulo its length."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = rows.mapInArrow(_runs(drop_every, min_length), "word string, n long")
    return settle(spark, counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), "variants-words")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    return h ^ (h >> np.uint64(29))


class Layout:
    """Where a hash's two bits lie: in one of the slices, at two places of it."""

    def __init__(self, words: int, slice_bits: int = SLICE_BITS):
        want = 1 << max(16, (max(1, words) * BITS_PER_WORD - 1).bit_length())
        self.bits = min(want, slice_bits)
        self.slices = want // self.bits
        self.block = min(BLOCK_BITS, self.bits)

    def slice_of(self, h: np.ndarray) -> np.ndarray:
        return h & np.uint64(self.slices - 1)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - (self.bits.bit_length() - 1))
        return h >> shift, (h * np.uint64(MIX[1])) >> shift


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = np.uint64(BASE)
    return np.multiply.accumulate(out)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


def _by_length(words: list[str]) -> Iterator[list[int]]:
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and len(words[order[end]]) == len(words[order[at]]):
            end += 1
        yield order[at:end]
        at = end


def _places(layout: Layout):
    def run(batches):
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if w]
            for own in _by_length(words):
                codes = _codes([words[i] for i in own])
                h = _mixed((codes * _powers(codes.shape[1])).sum(1, dtype=np.uint64))
                part = layout.slice_of(h)
                for p in layout.places(h):
                    at = part * np.uint64(layout.bits) + p
                    yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(layout.block)).astype(np.int64)), pa.array((at % np.uint64(layout.block)).astype(np.int32))], ["block", "bit"])

    return run


def _blocks(size: int):
    def run(batches):
        def out(block, parts):
            bits = np.zeros(size, dtype=np.uint8)
            for p in parts:
                bits[p] = 1
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["block", "bytes"])

        held, now = [], None
        for (block,), first, rows in sorted_groups(batches, ["block"]):
            if first and held:
                yield out(now, held)
                held = []
            now = int(block)
            held.append(rows.column(1).to_numpy())
        if held:
            yield out(now, held)

    return run


def candidates(words: list[str], alphabet: np.ndarray, may_be) -> Iterator[tuple[int, str]]:
    """(place of the word, candidate) for every neighbour whose hash may_be lets pass, each once."""
    for own in _by_length(words):
        length = len(words[own[0]])
        if not length:
            continue
        power = _powers(length + 2)
        step = max(1, AT_ONCE // ((length + 1) * len(alphabet)))
        for k in range(0, len(own), step):
            at = own[k : k + step]
            codes = _codes([words[i] for i in at])
            left = np.zeros((len(at), length + 1), dtype=np.uint64)
            np.cumsum(codes * power[:length], axis=1, out=left[:, 1:])
            whole = left[:, -1:]
            differs = codes[:, :, None] != alphabet
            # deletions: the right part moves one place down
            ok = np.ones(codes.shape, dtype=bool)
            ok[:, :-1] = codes[:, :-1] != codes[:, 1:]
            for r, i in may_be(left[:, :-1] + (whole - left[:, 1:]) * np.uint64(UNBASE), ok):
                w = words[at[r]]
                yield at[r], w[:i] + w[i + 1 :]
            for r, i, a in may_be(whole[:, :, None] + (alphabet - codes[:, :, None]) * power[:length, None], differs):
                w = words[at[r]]
                yield at[r], w[:i] + chr(int(alphabet[a])) + w[i + 1 :]
            # insertions: the right part moves one place up
            ok = np.ones((len(at), length + 1, len(alphabet)), dtype=bool)
            ok[:, :-1] = differs
            moved = left + (whole - left) * np.uint64(BASE)
            for r, i, a in may_be(moved[:, :, None] + alphabet * power[: length + 1, None], ok):
                w = words[at[r]]
                yield at[r], w[:i] + chr(int(alphabet[a])) + w[i:]


def _near(layout: Layout, part: int, bitmap, alphabet: list[int]):
    def run(batches):
        kept("variants-near", bool)
        filled = np.frombuffer(bitmap.value, dtype=np.uint8)

        def hit(p):
            return (filled[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1

        def may_be(h, ok):
            flat = np.flatnonzero(ok)
            mixed = _mixed(h.reshape(-1)[flat])
            if layout.slices > 1:
                mine = layout.slice_of(mixed) == part
                flat, mixed = flat[mine], mixed[mine]
            one, two = layout.places(mixed)
            passed = np.flatnonzero(hit(one))
            passed = passed[hit(two[passed]).astype(bool)]
            return zip(*(x.tolist() for x in np.unravel_index(flat[passed], ok.shape)), strict=True)

        letters = np.array(alphabet, dtype=np.uint64)
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got = list(candidates(words, letters, may_be))
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i, _ in got], pa.string()), pa.array([counts[i] for i, _ in got], pa.int64()), pa.array([c for _, c in got], pa.string())], ["word", "n", "near"])

    return run


def near_words(spark: SparkSession, words: DataFrame, slice_bits: int = SLICE_BITS) -> DataFrame:
    """word, n, near, near_n: every two of words (word, n; distinct, settled) that one code point makes differ, both ways round."""
    alphabet = sorted(ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect())
    layout = Layout(words.count(), slice_bits)
    found = None
    if alphabet:
        bits = words.select("word").mapInArrow(_places(layout), "block long, bit int")
        blocks = settle(spark, bits.repartition(partitions(spark), "block").sortWithinPartitions("block").mapInArrow(_blocks(layout.block), "block long, bytes binary"), "variants-bitmap")
        per_slice, size = layout.bits // layout.block, layout.block // 8
        spread = words.select("word", "n").repartition(partitions(spark))
        for part in range(layout.slices):
            bitmap = bytearray(layout.bits // 8)
            for block, part_bytes in blocks.filter((F.col("block") >= part * per_slice) & (F.col("block") < (part + 1) * per_slice)).collect():
                at = (block - part * per_slice) * size
                bitmap[at : at + size] = part_bytes
            shared = spark.sparkContext.broadcast(bytes(bitmap))
            own = spread.mapInArrow(_near(layout, part, shared, alphabet), "word string, n long, near string")
            found = own if found is None else found.unionByName(own)
    if found is None:
        found = words.select("word", "n", F.col("word").alias("near")).limit(0)
    # Both sides are spread by whole words, of which each has no more neighbours than candidates: no key is hot.
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(spark: SparkSession, forms: DataFrame, steps: int) -> DataFrame:
    """word, root from forms (word, form), whose chains have no more than steps links."""
    at = settle(spark, forms.select("word", F.col("form").alias("root")), "variants-forms")
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("then"))
        at = settle(spark, at.join(ahead, "root", "left").select("word", F.coalesce("then", "root").alias("root")), "variants-roots")
    return at


def spelling_variants(spark: SparkSession, words: DataFrame, ratio: int = 2, slice_bits: int = SLICE_BITS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of words (word, n; distinct, settled)."""
    if ratio < 2:
        raise ValueError("ratio must be 2 at least: chains of forms must end")
    near = near_words(spark, words, slice_bits)
    best = near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best"))
    large = -F.col("best.rank") >= ratio * F.col("n")
    best = best.select("word", "n_near", F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.rank")).alias("form_n"))
    best = settle(spark, best, "variants-near")
    ends = words.agg(F.min("n"), F.max("n")).first()
    steps = math.floor(math.log(ends[1] / ends[0], ratio) + 1e-9) if ends[0] else 0
    found = best.join(roots(spark, best.filter("form IS NOT NULL"), steps), "word", "left")
    out = words.select("word", "n").join(found, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
