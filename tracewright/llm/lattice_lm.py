"""LM scoring by the marginal likelihood of a subword lattice.

The pieces are those of an existing SentencePiece vocabulary. A word's lattice
has an edge for every piece that matches at a place, so a path is a
segmentation; the forward recursion in log space sums over all paths. Pieces
that begin with the word mark begin a word and no others do, so the lattices of
a text's words are independent, and each distinct word is worked out once.

Weights come from the vocabulary's scores alone, by one map: a piece whose score
ranks r-th (from 0) weighs ``1 / (ZIPF + r)``, over the sum of all. A unigram
vocabulary's scores are log probabilities already; those of a BPE vocabulary are
ranks, and Zipf's law turns ranks into probabilities. Byte pieces have no score
and rank last. Pieces add up to 1, and so do the marginals of all words.

A text is its words and one end. Without word pieces (``word_pieces=False``, the
default) all that is learned is how likely an end is: ``ends / N`` of N training
tokens; a word has the rest times its lattice. With them the words of the
training texts join the vocabulary as pieces of their own, which have one more
edge over the whole word: with c of N tokens, V distinct words and absolute
discount d, a word has probability ``(c - d) / N + d V / N * lattice(word)``.
Either way all tokens add up to 1. d is n1 / (n1 + 2 n2) of the counts of counts.

At scale: words are counted within each task first, then by key. The ``HOT``
most frequent words, of ``HOT_BYTES`` bytes together at most (a bounded
broadcast), are scored where the text is read; only other words travel, one row
per document and distinct word, to be joined with the counts. Words that no
training text holds get their lattice after that join.

A null text is empty and has one token, its end. Repeated rows and ids are scored
as rows of their own, and no rows give no rows. Without training texts N is 0,
and words and ends are taken to be equally likely.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.shared import kept, settle

HOT = 1 << 16
HOT_BYTES = 4 << 20
FLUSH = 250_000
MARK = "▁"
#: Where the map from ranks to weights begins.
ZIPF = 10.0


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return text.lower().split()


def open_pieces(path: str) -> tuple[list[str], list[float]]:
    """The vocabulary's pieces and scores; control pieces as empty strings."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    return ["" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]


def weights_of(pieces: list[str], scores: list[float]) -> list[float]:
    """The weights of the module's text; of equal scores the earlier piece ranks first. Control pieces weigh nothing."""
    is_byte = [len(p) == 6 and p.startswith("<0x") for p in pieces]
    order = sorted((i for i, p in enumerate(pieces) if p), key=lambda i: (is_byte[i], -scores[i], i))
    out = [0.0] * len(pieces)
    for rank, i in enumerate(order):
        out[i] = 1.0 / (ZIPF + rank)
    total = sum(out) or 1.0
    return [x / total for x in out]


class Lattice:
    """Natural-log marginals of words under weighted pieces."""

    def __init__(self, pieces: list[str], weights: list[float]):
        total = sum(weights)
        self.logp = {p: math.log(w / total) for p, w in zip(pieces, weights, strict=True) if p and w > 0}
        self.byte = [self.logp.get(f"<0x{b:02X}>", -30.0) for b in range(256)]
        for b in range(256):  # a byte piece's name is no text
            self.logp.pop(f"<0x{b:02X}>", None)
        self.longest = max(map(len, self.logp), default=1)
        self.ends = {p[i:] for p in self.logp for i in range(len(p))}

    def forward(self, text: str, alpha: list[float], done: int) -> list[float]:
        """alpha[i]: log probability of all ways to the first i characters; alpha holds done + 1 of them already."""
        logp, ends, exp, log = self.logp, self.ends, math.exp, math.log
        del alpha[done + 1 :]
        for i in range(done + 1, len(text) + 1):
            best, terms = -math.inf, []
            for j in range(i - 1, max(-1, i - 1 - self.longest), -1):
                piece = text[j:i]
                if piece not in ends:  # no piece ends like this, so no longer one does
                    break
                w = logp.get(piece)
                if w is not None:
                    w += alpha[j]
                    terms.append(w)
                    if w > best:
                        best = w
            if not terms:  # no piece covers the last character: its bytes do
                alpha.append(alpha[i - 1] + sum(self.byte[b] for b in text[i - 1].encode()))
            elif len(terms) == 1:
                alpha.append(best)
            else:
                alpha.append(best + log(sum([exp(t - best) for t in terms])))
        return alpha

    def words(self, words: list[str]) -> list[float]:
        """The marginal of each word. Sorted words share the recursion over common prefixes."""
        out = [0.0] * len(words)
        before, alpha = "", [0.0]
        for k in sorted(range(len(words)), key=words.__getitem__):
            text = MARK + words[k]
            n = 0
            for a, b in zip(before, text, strict=False):
                if a != b:
                    break
                n += 1
            self.forward(text, alpha, n)
            before, out[k] = text, alpha[-1]
        return out


@dataclass(frozen=True)
class Totals:
    tokens: int  # N
    distinct: int  # V, the end included
    ends: int
    discount: float  # 0 without word pieces

    @property
    def unseen(self) -> float:
        """The share of tokens that the lattice stands for."""
        if not self.tokens:
            return 0.5
        return (self.discount * (self.distinct - (self.ends > 0)) if self.discount else self.tokens - self.ends) / self.tokens

    def words(self, c, lattice):
        """log10 probabilities of words that occur c times (arrays)."""
        import numpy as np

        with np.errstate(divide="ignore"):
            whole = np.log(np.where((c > 0) & (self.discount > 0), (c - self.discount) / max(self.tokens, 1), 0.0))
        both = np.logaddexp(whole, math.log(self.unseen) + lattice) if self.unseen > 0 else whole
        return np.where(np.isneginf(both), math.log(0.5) + lattice, both) / math.log(10)

    def end(self) -> float:
        return math.log10(self.ends / self.tokens) if self.ends else math.log10(0.5)

    def base(self, c: int) -> float:
        return math.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept("words", bool)
    seen: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            seen.update((text or b"").lower().split())
            if len(seen) > FLUSH:
                yield flush()
    if seen:
        yield flush()


def _marginals(shared):
    def run(batches):
        lattice = Lattice(*shared.value)
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lattice.words(words), pa.float64())], [*batch.schema.names, "lattice"])

    return run


def _read_texts(hot, totals: Totals):
    """One row per document (word null: its sums over the end and hot words) and one per document and other word."""

    names = ["row", "held_out", "word", "n", "n_known", "base", "score"]

    def run(batches):
        import numpy as np

        scores = totals.words(*(np.array([x[i] for x in hot.value], dtype=np.float64) for i in (1, 2))).tolist()
        known = {w.encode(): (totals.base(c), x) for (w, c, _), x in zip(hot.value, scores, strict=True)}
        end = (totals.base(totals.ends), totals.end())
        for batch in batches:
            sums: list[tuple] = []
            words, tfs, sizes = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                base, score, n_known, n, before = end[0], end[1], int(totals.ends > 0), 1, len(words)
                for w, tf in Counter((text or b"").lower().split()).items():
                    n += tf
                    got = known.get(w)
                    if got is None:
                        words.append(w)
                        tfs.append(tf)
                    else:
                        base += tf * got[0]
                        score += tf * got[1]
                        n_known += tf
                sizes.append(len(words) - before)
                sums.append((n, n_known, base, score))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*sums, strict=True), kinds, strict=True)] if sums else [pa.nulls(0, kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.nulls(len(sizes), pa.string()), *columns], names)
            m, at = len(words), pa.array(np.repeat(np.arange(len(sizes)), sizes))
            nothing = [pa.nulls(m, kind) for kind in kinds[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.nulls(m, pa.bool_()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64()), *nothing], names)

    return run


def _sum_rare(totals: Totals, shared):
    """base and score of joined rows (row, word, tf, c, lattice); a word without c gets its lattice here."""

    def run(batches):
        import numpy as np

        model = Lattice(*shared.value)
        for batch in batches:
            tf, counts, lattice = batch.column(2).to_numpy(), batch.column(3).fill_null(0).to_numpy(), np.array(batch.column(4).fill_null(0.0))
            new = np.flatnonzero(counts == 0)
            if len(new):
                words = batch.column(1).take(pa.array(new)).dictionary_encode()
                lattice[new] = np.array(model.words(words.dictionary.to_pylist()))[words.indices.to_numpy()]
            distinct, place = np.unique(counts, return_inverse=True)
            base = np.array([totals.base(c) for c in distinct.tolist()])[place] if len(tf) else lattice
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(counts > 0, tf, 0)), pa.array(tf * base), pa.array(tf * totals.words(counts, lattice))], ["row", "n_known", "base", "score"])

    return run


def fit(spark: SparkSession, texts: DataFrame, path: str, word_pieces: bool = False) -> tuple[DataFrame, Totals, tuple[list[str], list[float]]]:
    """(counts: word, c, lattice), totals and weighted pieces from a column of training texts."""
    counts = settle(spark, texts.mapInArrow(_count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).sortWithinPartitions("word"), "lm-counts")  # neighbours share the recursion over their prefixes
    ends = texts.count()
    n, v, n1, n2 = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    totals = Totals(n + ends, v + (ends > 0), ends, discount if word_pieces else 0.0)
    pieces, scores = open_pieces(path)
    model = (pieces, weights_of(pieces, scores))
    with_lattice = counts.mapInArrow(_marginals(spark.sparkContext.broadcast(model)), "word string, c long, lattice double")
    return settle(spark, with_lattice, "lm-lattice"), totals, model


def hot_words(spark: SparkSession, counts: DataFrame) -> list[tuple[str, int, float]]:
    """The HOT most frequent words (with c and lattice), left out where they take more than what is left of HOT_BYTES. Hashes and lengths come to the driver first, then the words that fit."""
    own = F.xxhash64("word")
    top = counts.select(own.alias("h"), "c", F.octet_length("word").alias("size")).orderBy(F.desc("c"), "h").limit(HOT).collect()
    room, fits = HOT_BYTES, []
    for h, _, size in top:
        if size <= room:
            room -= size
            fits.append((h,))
    chosen = spark.createDataFrame(fits, "h long")  # HOT rows at most
    return [tuple(r) for r in counts.join(F.broadcast(chosen), own == F.col("h"), "left_semi").select("word", "c", "lattice").collect()]


def score_texts(spark: SparkSession, docs: DataFrame, held_out, path: str, id_col: str = "doc_id", text_col: str = "text", word_pieces: bool = False) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of each of docs; rows where held_out is false train. A repeated id is scored as rows of its own."""
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("n")).alias("row"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts, totals, model = fit(spark, rows.filter(~F.col("held_out")).select("text"), path, word_pieces)
    hot = spark.sparkContext.broadcast(hot_words(spark, counts))
    id_type = docs.schema[id_col].dataType.simpleString()
    read = rows.mapInArrow(_read_texts(hot, totals), f"row struct<id: {id_type}, n: bigint>, held_out boolean, word string, n long, n_known long, base double, score double")
    read = settle(spark, read, "lm-read")
    own = read.filter(F.col("word").isNull()).select("row", "held_out", F.col("n").alias("n_tokens"), "n_known", "base", "score")
    rare = read.filter(F.col("word").isNotNull()).select("row", "word", F.col("n").alias("tf")).join(counts, "word", "left")
    summed = rare.select("row", "word", "tf", "c", "lattice").mapInArrow(_sum_rare(totals, spark.sparkContext.broadcast(model)), f"row struct<id: {id_type}, n: bigint>, n_known long, base double, score double")
    everything = own.unionByName(summed, allowMissingColumns=True)
    out = everything.groupBy("row").agg(*[F.max(c).alias(c) for c in ("held_out", "n_tokens")], *[F.sum(c).alias(c) for c in ("n_known", "base", "score")])
    return out.select(F.col("row.id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
