"""Quality classifier by compression.

Two zstandard dictionaries are trained, from good and from bad labelled text. A
text that resembles one of them compresses better with it; the difference of the
compressed sizes over the text's size, taken in blocks of ``BLOCK`` bytes over
the whole text, is the raw score. Logistic regression calibrates it. It also
sees the smaller compressed size over the text's size: how much a difference
means depends on how far the text compresses at all (noise does with neither).

Fitting takes at most ``max_rows`` labels of each class, in the order of a hash of
the id, and their whole texts. Lines of ``shared_line_bytes`` or more that several of these texts have are left out of the
dictionaries (never of a score): they tell nothing of either class. None keeps them. Half of them build the
dictionaries, the other half calibrate, so the calibration sees no text that a
dictionary holds. Scoring covers whole texts of all rows.

Rows with a null text count as empty; an empty text gets the score of the
average text (the intercept). Labels other than 0 and 1 are left out, and an id
labelled both counts as both. Where one class has no labels, every score is the
share of label 1 (0.5 with no labels). Repeated rows score alike, no rows give
no rows, and columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.shared import kept

BLOCK = 1 << 12
LEVEL = 6
#: Bytes of the pieces that dictionaries are trained on, of the segments they take, and of the matches that these are rated by.
PIECE, SEGMENT, MATCH = 2048, 256, 8


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]


class _Scorer:
    def __init__(self, model: Model):
        import zstandard

        self.model = model
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.sides = []
        for raw in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(raw)  # with its entropy tables, if it was trained
            d.precompute_compress(compression_params=params)
            self.sides.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d))

    def features(self, text: bytes) -> tuple[float, ...]:
        n = len(text)
        if not n:
            return (float("nan"),) * 2
        good, bad = self.sides
        a = b = 0
        for at in range(0, n, BLOCK):
            part = text[at : at + BLOCK]
            a += len(good.compress(part))
            b += len(bad.compress(part))
        return ((b - a) / n, min(a, b) / n)

    def scores(self, x: np.ndarray) -> np.ndarray:
        m = self.model
        z = np.where(np.isnan(x), 0, (x - np.array(m.mean)) / np.array(m.scale))
        return 1 / (1 + np.exp(-np.clip(z @ np.array(m.weights[:-1]) + m.weights[-1], -50, 50)))


def without_repeats(texts: dict[int, list[bytes]], min_bytes: int = 20) -> dict[int, list[bytes]]:
    """The texts less the lines that occur in several of them: shared passages tell nothing of either class."""
    from collections import Counter

    seen = Counter(line for own in texts.values() for t in own for line in set(t.split(b"\n")) if len(line) >= min_bytes)
    return {y: [b"\n".join(line for line in t.split(b"\n") if seen[line] < 2) for t in own] for y, own in texts.items()}


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary of the given size at most: the segments of the texts that zstandard's training picks, or the texts themselves where there are too few for it."""
    import zstandard

    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method. A step is halved until the loss falls: where the classes all but part, whole steps overshoot and run away."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + ridge / 2 * (w @ w)

    was = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        while (now := loss(w - step)) > was and np.abs(step).max() >= 1e-9:
            step /= 2
        if np.abs(step).max() < 1e-9:
            break
        w, was = w - step, now
    return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4000, dictionary_bytes: int = 112_640, shared_line_bytes: int | None = 20) -> Model:
    """A model from docs (id, text) and labels (id, label 0 or 1). max_rows labels of each class, in the order of a hash of their ids, are looked up in docs; their texts reach the driver."""
    rows = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.col(id_col).cast("string")).alias("h")).distinct()
    picked = [tuple(r) for y in (0, 1) for r in rows.filter(F.col("y") == y).orderBy("h", "id").limit(max_rows).collect()]
    wanted = spark.createDataFrame(picked, rows.schema)  # 2 * max_rows ids at most, so it may be broadcast
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    found = docs.select(F.col(id_col).alias("id"), text.alias("t")).join(F.broadcast(wanted), "id").select("y", "h", "t").collect()
    got = {k: [bytes(t) for y, _, t in sorted(tuple(r) for r in found) if y == k] for k in (0, 1)}
    built = {y: t[::2] for y, t in got.items()}
    if shared_line_bytes is not None:
        built = without_repeats(built, shared_line_bytes)
    halves = {y: (t, got[y][1::2]) for y, t in built.items()}
    n0, n1 = len(got[0]), len(got[1])
    if min(len(halves[0][1]), len(halves[1][1])) == 0:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(b"-" * 16, b"-" * 16, (0.0, 0.0, float(np.log(share / (1 - share)))), (0.0, 0.0), (1.0, 1.0))
    good, bad = _dictionary(halves[1][0], dictionary_bytes), _dictionary(halves[0][0], dictionary_bytes)
    scorer = _Scorer(Model(good, bad, (), (), ()))
    texts = [(t, y) for y in (0, 1) for t in halves[y][1] if t]
    x, y = np.array([scorer.features(t) for t, _ in texts]), np.array([y for _, y in texts], dtype=float)
    mean, scale = x.mean(0), x.std(0) + 1e-12
    w = logistic((x - mean) / scale, y)
    return Model(good, bad, tuple(w.tolist()), tuple(mean.tolist()), tuple(scale.tolist()))


def _score(model, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(model.value, lambda: _Scorer(model.value))
        for batch in batches:
            x = np.array([scorer.features(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + with_text], pa.array(scorer.scores(x))], ["row", *["text"] * with_text, "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", with_text: bool = False) -> DataFrame:
    """docs with score_col (replaced if there): how likely label 1 is, from the whole text. The text comes back only if asked for."""
    keep = [c for c in docs.columns if c != score_col and (with_text or c != text_col)]
    rest = [F.col(f"`{c}`") for c in keep if c != text_col]
    rows = docs.select(F.struct(*rest, F.lit(0).alias("_one")).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [*rows.schema.fields[: 1 + with_text], T.StructField("score", T.DoubleType())]
    out = rows.mapInArrow(_score(shared, with_text), T.StructType(fields))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in keep], F.col("score").alias(score_col))
