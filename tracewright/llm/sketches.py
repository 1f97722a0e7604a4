"""Document fingerprints: threshold-scaled sketches, with DataFrame functions only.

A text's shingles are its runs of ``words`` words (A-Z lower-cased, split at
``[\\x20\\x09-\\x0D]``, joined by spaces; a text with fewer words is one shingle, one without words
has none). A shingle's hash is the first 64 bits of its MD5. The sketch retains every
distinct hash below ``fraction`` of the range, so a long text keeps more hashes than a short
one, and the same shingle is kept or left in every document. That makes sketches

* mergeable: the sketch of several documents' shingles together is the union of
  theirs (``merge``), whatever their lengths and order;
* fit for containment: the share of one text's hashes that another also has estimates the share of its
  shingles that stand there, however much longer the other is (``containment``).

A short text may have no hash below the threshold. It keeps its smallest hash then, the one exception, which a merge
drops as soon as any hash is below; so only a text without words has an empty sketch.

A sketch is a sorted array of hashes in 16 hex digits; a fingerprint is these in one string.
``likeness`` is the containment of the smaller sketch in the other: 1 for equal sketches, two
empty ones included, and 0 where one alone is empty.

Null texts count as empty. Cost is linear in a text's length and nothing is shuffled to sketch it.
``edited`` orders documents by id, from large to small, null last; rows with one id are one
place there and have the same next document. Where that place has several rows, the least of
their heads (as many code points as are asked for at most) and of their sketches stands for them. One id
alone is followed by itself, and no rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.shared import UPPER, partitions, settle

WORDS, FRACTION = 5, 1 / 8
DIGITS = 16
#: At most so many ids count as hot, those with over this share of the rows; each is dealt into parts.
HOT = 10_000


def bound(make, value: Column) -> Column:
    """make(value), with value computed once for a row however often make reads it."""
    return F.transform(F.array(value), make)[0]


def limit(fraction: float) -> str:
    """Hashes below this one, in hex digits, are that fraction of all."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and 1 at most")
    return "g" if fraction == 1 else f"{int(fraction * (1 << 4 * DIGITS)):0{DIGITS}x}"


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles, in order, repeats included."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    own = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i + 1, words), " ").cast("binary")), 1, DIGITS))

    return bound(hashes, own)


def retained(hashes: Column, fraction: float = FRACTION) -> Column:
    """The sorted distinct hashes below the threshold, or else the smallest."""

    def keep(h: Column) -> Column:
        below = F.filter(h, lambda x: x < F.lit(limit(fraction)))
        return bound(lambda b: F.when(F.size(b) > 0, F.array_sort(F.array_distinct(b))).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(b), below)

    return bound(keep, hashes)


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    return retained(shingle_hashes(text, words), fraction)


def fingerprint(sketched: Column) -> Column:
    return F.array_join(sketched, "")


def merge(sketches: Column, fraction: float = FRACTION) -> Column:
    """The sketch of all shingles together, from an array of sketches."""
    return retained(F.flatten(sketches), fraction)


def merged(rows: DataFrame, keys: list[str], sketch_col: str, fraction: float = FRACTION) -> DataFrame:
    """One sketch for each of keys, from rows' sketches: distinct hashes are grouped before they meet."""
    hashes = rows.select(*keys, F.explode(sketch_col).alias("h")).distinct()
    least = hashes.groupBy(*keys).agg(F.min("h").alias("least"))
    below = hashes.filter(F.col("h") < limit(fraction)).groupBy(*keys).agg(F.array_sort(F.collect_list("h")).alias("own"))
    out = least.join(below, keys, "left")
    return out.select(*keys, F.coalesce("own", F.array("least")).alias(sketch_col))


def containment(a: Column, b: Column) -> Column:
    """The share of sketch a that sketch b has; null for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def next_ids(spark: SparkSession, ids: DataFrame) -> DataFrame:
    """id, next_id and the other columns of ids (distinct ids, null may be among them): the next smaller id, and for the last the first."""
    order = F.col("id").desc_nulls_last()
    ranges = settle(spark, ids.repartitionByRange(partitions(spark), order).withColumn("range", F.spark_partition_id()), "sketches-ids")
    after = F.lead(F.struct("id")).over(Window.partitionBy("range").orderBy(order))
    # One row for each range, as many as there are partitions: where the next one starts, and the first for the last.
    line = Window.orderBy("range")
    starts = ranges.groupBy("range").agg(F.max(F.struct("id")).alias("start"))
    turns = starts.select("range", F.coalesce(F.lead("start").over(line), F.first("start").over(line)).alias("turn"))
    out = ranges.withColumn("after", after).join(F.broadcast(turns), "range")
    return out.withColumn("next_id", F.coalesce("after", "turn")["id"]).drop("after", "turn", "range")


def _place(id_col: str) -> list[Column]:
    """An id as columns that plain equality joins on: its value, and whether it is null."""
    return [F.coalesce(F.col(id_col), F.lit(0)).alias("key"), F.col(id_col).isNull().alias("none")]


def _dealt(rows: DataFrame, parts: str) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)).alias("deal")).drop(parts)


def edited(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, fraction: float = FRACTION, part: int = 3) -> DataFrame:
    """id, n_chars, text, edited (its last floor(n_chars / part) code points replaced by the first as many of the next document), and the sketches own, of_edited and of_next."""
    keys = ["key", "none", "deal"]
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    ids = docs.groupBy("id").agg(F.floor(F.max(F.length("text")) / part).cast("int").alias("need"), F.count(F.lit(1)).alias("rows"))
    turns = settle(spark, next_ids(spark, ids), "sketches-next")
    most = max(1000, (turns.agg(F.sum("rows")).first()[0] or 0) // HOT)  # so at most HOT ids have more rows
    hot = settle(spark, turns.filter(F.col("rows") > most).select("id", F.ceil(F.col("rows") / most).cast("int").alias("parts")), "sketches-hot")
    hot_of = lambda of, name: F.broadcast(hot.select(F.col("id").alias(of), F.col("parts").alias(name)))
    rows = docs.join(hot_of("of", "parts"), F.col("id").eqNullSafe(F.col("of")) & F.col("parts").isNotNull(), "left")
    rows = rows.select(*_place("id"), F.pmod(F.xxhash64("text"), F.coalesce("parts", F.lit(1))).cast("int").alias("deal"), "text")
    rows = rows.repartition(partitions(spark), *keys)  # moved once for both joins
    asks = turns.join(hot_of("of", "parts"), F.col("id").eqNullSafe(F.col("of")), "left").join(hot_of("next", "next_parts"), F.col("next_id").eqNullSafe(F.col("next")), "left")
    asks = asks.select(*_place("next_id"), F.struct(*_place("id")).alias("asker"), "need", F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("next_parts", F.lit(1)).alias("next_parts"))
    # A sketch costs less to make again than to move: only that of the next document travels, in half the bytes of its digits.
    packed = F.unhex(fingerprint(sketch(F.col("text"), words, fraction)))
    heads = rows.join(_dealt(asks, "next_parts"), keys).select("asker.*", "parts", F.struct(F.substring("text", F.lit(1), F.col("need")).alias("head"), packed.alias("own")).alias("next"))
    heads = _dealt(heads, "parts").groupBy(*keys).agg(F.min("next").alias("next"))
    size = F.length("text")
    cut = F.floor(size / part).cast("int")
    out = rows.join(heads, keys).withColumn("edited", F.concat(F.substring("text", F.lit(1), size - cut), F.substring("next.head", F.lit(1), cut)))
    digits = F.regexp_extract_all(F.hex("next.own"), F.lit(f".{{{DIGITS}}}"), F.lit(0))
    return out.select(
        F.when(~F.col("none"), F.col("key")).alias("id"), size.cast("long").alias("n_chars"), "text", "edited",
        sketch(F.col("text"), words, fraction).alias("own"), sketch(F.col("edited"), words, fraction).alias("of_edited"),
        F.transform(digits, F.lower).alias("of_next"),
    )
