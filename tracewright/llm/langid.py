"""Language ID by cross-parsing entropy.

Each language's labelled text becomes a suffix automaton. A text is parsed
against it greedily: every phrase is the longest match from where the last one
ended (a character that the language never shows is a phrase of its own). A text
of a language breaks into few phrases of its automaton and many of the others'.

A phrase names a place in the learned text, which takes the logarithm of that
text's length; so phrases times that logarithm, per character, estimate the
cross entropy, and languages may learn from texts of different lengths. The
least wins.

What is learned and parsed is a text's words, runs of letters (``str.isalpha``)
in lower case, with one space around each; matches run across words.

Fitting takes at most ``max_docs`` labelled rows of each language, in the order of
a hash of id and text, and their whole texts; that bound is the only one. Null
languages and texts are left out; repeated rows count again, and null or repeated ids are like others. The automata take
some hundred bytes for each character learned, in every worker.

Predictions cover whole texts: ``und`` for a null text, a text without a letter
(an empty one too), or where no language was learned. Ties go to the first
language in alphabetical order. The score is the winner's share in a softmax of
minus the entropies, scaled by ``SHARP``. Repeated rows are predicted alike, and
no rows give no rows.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.shared import kept

UNDETERMINED = "und"
MARK = " "
BETWEEN = "\n"
ALNUM = re.compile(r"[^\W\d_]+")
SHARP = 4.0


class SuffixAutomaton:
    """All substrings of a text. A state is a dictionary from the next character to the next state."""

    def __init__(self, text: str):
        nexts: list[dict] = [{}]
        link, length, last = array("i", [-1]), array("i", [0]), 0
        for c in text:
            now = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = now
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        for ways in nexts:  # numbers of states become the states
            for c, to in ways.items():
                ways[c] = nexts[to]
        self.size, self.start = len(text), nexts[0]

    def phrases(self, text: str) -> int:
        """How many longest matches, one after the other, make up the text."""
        start = state = self.start
        n = 0
        for c in text:
            then = state.get(c)
            if then is None:
                if state is start:  # a character that is nowhere
                    n += 1
                    continue
                n += 1  # the phrase ends here, and the next begins with c
                then = start.get(c)
                if then is None:
                    n += 1
                    then = start
            state = then
        return n + (state is not start)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    texts: tuple[str, ...]


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. What the expression takes beside letters are numerals that aren't decimal digits."""
    found = ALNUM.findall(text.lower())
    if text.isascii():
        return found
    return [w for part in found for w in ((part,) if part.isalpha() else "".join(c if c.isalpha() else " " for c in part).split())]


def marked(text: str) -> str:
    """The text in the form that is learned and parsed; empty without a letter."""
    words = words_of(text)
    return MARK + MARK.join(words) + MARK if words else ""


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 24) -> Model:
    """A model from rows (id, text, language). At most max_docs rows of each language reach the driver, whole."""
    from pyspark.sql import Window

    # The hash is of id and text, and tasks keep max_docs rows of each language before anything is shuffled: one id for many rows takes none of them out, nor to one task.
    h = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), h.alias("h"), F.col(text_col).cast("string").alias("t"))
    best = Window.partitionBy("lang").orderBy("h", "t")
    picked = rows.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= max_docs).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["n"])):
        if own := marked(r["t"]):
            texts.setdefault(r["lang"], []).append(own)
    return Model(tuple(sorted(texts)), tuple(BETWEEN.join(texts[lang]) for lang in sorted(texts)))


class Parser:
    def __init__(self, model: Model):
        self.languages = model.languages
        self.automata = [SuffixAutomaton(t) for t in model.texts]
        self.bits = [math.log2(a.size + 1) for a in self.automata]

    def entropies(self, own: str) -> list[float]:
        """Of a marked text, in bits a character, by language."""
        return [a.phrases(own) * bits / len(own) for a, bits in zip(self.automata, self.bits, strict=True)]

    def predict(self, text: str | None) -> tuple[str, float]:
        own = marked(text) if text is not None and self.languages else ""
        if not own:
            return UNDETERMINED, 0.0
        found = self.entropies(own)
        least = min(found)
        return self.languages[found.index(least)], 1.0 / sum([math.exp(-SHARP * (x - least)) for x in found])


def _predict(model, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = kept(model.value, lambda: Parser(model.value))
        for batch in batches:
            got = [parser.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + with_text], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["row", *["text"] * with_text, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """docs with lang_pred and score (replaced if there), from whole texts. The text comes back only if asked for."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score") and (with_text or c != text_col)]
    rest = [F.col(f"`{c}`") for c in keep if c != text_col]
    rows = docs.select(F.struct(*rest, F.lit(0).alias("_one")).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [*rows.schema.fields[: 1 + with_text], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    out = rows.mapInArrow(_predict(shared, with_text), T.StructType(fields))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in keep], "lang_pred", "score")
