"""The reference library: one row per paper, duplicates, lookups, merges and citation edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import text as X


def normalised(references: DataFrame) -> DataFrame:
    """With doi, arxiv, title_key and identity."""
    doi, arxiv = X.normalise_doi(F.col("raw_doi")), F.coalesce(X.normalise_arxiv(F.col("raw_arxiv")), X.arxiv_of_doi(F.col("raw_doi")))
    out = references.select("*", doi.alias("doi"), arxiv.alias("arxiv"), X.normalise_title(F.col("title")).alias("title_key"))
    return out.withColumn("identity", X.identity(F.col("doi"), F.col("arxiv"), F.col("title_key"), F.col("year")))


def duplicate_groups(refs: DataFrame) -> DataFrame:
    """reason, key, n, first_id: groups that share a DOI, an arXiv id, or title and year."""
    keys = F.array(F.struct(F.lit("doi").alias("reason"), F.col("doi").alias("key")), F.struct(F.lit("arxiv").alias("reason"), F.col("arxiv").alias("key")), F.struct(F.lit("title").alias("reason"), F.when(F.col("title_key") != "", F.concat_ws(":", "title_key", F.coalesce(F.col("year").cast("string"), F.lit("-")))).alias("key")))
    rows = refs.select("ref_id", F.explode(keys).alias("k")).select("ref_id", "k.*").filter("key IS NOT NULL")
    return rows.groupBy("reason", "key").agg(F.count(F.lit(1)).alias("n"), F.min("ref_id").alias("first_id")).filter("n > 1")


def merge_fill(refs: DataFrame) -> DataFrame:
    """One row per identity: for each field the first value by ref_id that isn't empty, and how many differing ones were offered. Minima combine within tasks."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ref_id"))).alias(c)
    return refs.groupBy("identity").agg(F.min("ref_id").alias("ref_id"), F.count(F.lit(1)).alias("n"), first("title"), first("year"), first("lang"), (F.count_distinct("year") > 1).alias("year_conflict"))


def lookup(asked: DataFrame, refs: DataFrame) -> DataFrame:
    """ask_id, ref_id, rung: by DOI, then arXiv id, then title with a year that agrees or is missing on a side; the first rung that hits, present years first, then the least id."""
    a = asked.select(F.col("ask_id"), *[F.col(c).alias(f"a_{c}") for c in ("doi", "arxiv", "year")], F.nullif("title_key", F.lit("")).alias("a_title_key"))  # an empty title matches nothing
    # One least id stands for all rows of a DOI, of an arXiv id, and of a title and year, so that no ask meets more of them than there are years.
    least = F.min("ref_id").alias("ref_id")
    by_doi = a.join(refs.filter("doi IS NOT NULL").groupBy("doi").agg(least), F.col("a_doi") == F.col("doi")).select("ask_id", "ref_id", F.lit(0).alias("rung"), F.lit(0).alias("no_year"))
    by_arxiv = a.join(refs.filter("arxiv IS NOT NULL").groupBy("arxiv").agg(least), F.col("a_arxiv") == F.col("arxiv")).select("ask_id", "ref_id", F.lit(1).alias("rung"), F.lit(0).alias("no_year"))
    years = F.col("year").isNull() | F.col("a_year").isNull() | (F.col("year") == F.col("a_year"))
    titles = refs.filter("title_key IS NOT NULL").groupBy("title_key", "year").agg(least)
    by_title = a.join(titles, (F.col("a_title_key") == F.col("title_key")) & years).select("ask_id", "ref_id", F.lit(2).alias("rung"), F.col("year").isNull().cast("int").alias("no_year"))
    hits = by_doi.unionByName(by_arxiv).unionByName(by_title)
    best = hits.groupBy("ask_id").agg(F.min(F.struct("rung", "no_year", "ref_id")).alias("b"))
    return asked.select("ask_id").join(best, "ask_id", "left").select("ask_id", "b.ref_id", "b.rung")


def related(edges: DataFrame, known: DataFrame) -> DataFrame:
    """citing, cited, in_library for edges (citing, cited); cited keys without a row in known (key) are stubs."""
    return edges.distinct().join(known.select(F.col("key").alias("cited")).distinct().withColumn("in_library", F.lit(True)), "cited", "left").select("citing", "cited", F.coalesce("in_library", F.lit(False)).alias("in_library"))


def export_keys(refs: DataFrame) -> DataFrame:
    """ref_id, bib_key: first word of the title, year, and a suffix where keys collide."""
    word = F.coalesce(F.nullif(F.split("title_key", " ")[0], F.lit("")), F.lit("untitled"))
    base = F.concat(word, F.coalesce(F.col("year").cast("string"), F.lit("")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("ref_id"))
    return refs.select("ref_id", base.alias("base")).withColumn("n", n).select("ref_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n"))).alias("bib_key"))


def substring_search(refs: DataFrame, words: list[str], limit: int) -> DataFrame:
    """Rows whose title holds every word, newest first."""
    hit = F.lit(True)
    for w in words:
        hit = hit & F.lower("title").contains(w.lower())
    return refs.filter(hit).orderBy(F.desc_nulls_last("year"), "ref_id").select("ref_id", "year").limit(limit)


def weekly_counts(events: DataFrame, time: str = "ts") -> DataFrame:
    """week (its Monday), n: events of each week from the first to the last, 0 where there are none."""
    w = events.groupBy(F.to_date(F.date_trunc("week", time)).alias("week")).agg(F.count(F.lit(1)).alias("n")).filter("week IS NOT NULL")
    s = w.agg(F.min("week").alias("a"), F.max("week").alias("z")).select(F.explode(F.sequence("a", "z", F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return s.join(w, "week", "left").select(F.date_format("week", "yyyy-MM-dd").alias("week"), F.coalesce("n", F.lit(0)).alias("n"))


def neighbours_in_order(neighbours: DataFrame) -> DataFrame:
    """Those in the library first, then stubs with an id before stubs with a title alone, then by title."""
    return neighbours.orderBy(~F.col("in_library"), F.col("identity").startswith("title:"), F.lower(F.coalesce("title", F.lit(""))), "identity")


def resolve(asked: DataFrame, refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """ask_id, ref_id, rung of asked (ask_id, key, doi, arxiv, title_key, year) in refs (ref_id, identity, bib_key, doi, arxiv, title_key, year): by identity, bibliography key, alias (alias, ref_id), DOI, arXiv id, then title; the first rung that hits, then the least id."""
    by = lambda side, column, rung: asked.join(side, asked["key"] == side[column]).select("ask_id", side["ref_id"], F.lit(rung).alias("rung"))
    exact = by(refs, "identity", 0).unionByName(by(refs, "bib_key", 1)).unionByName(by(aliases, "alias", 2))
    rest = lookup(asked, refs).filter("rung IS NOT NULL").select("ask_id", "ref_id", (F.col("rung") + 3).alias("rung"))
    best = exact.unionByName(rest).groupBy("ask_id").agg(F.min(F.struct("rung", "ref_id")).alias("b"))
    return asked.select("ask_id").join(best, "ask_id", "left").select("ask_id", "b.ref_id", "b.rung")


def merge_conflicts(refs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """identity, field, kept, offered: values that differ from the first one by ref_id, each once. Empty values offer nothing."""
    filled = F.array(*[F.struct(F.lit(c).alias("field"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("value")) for c in fields])
    rows = refs.select("identity", "ref_id", F.explode(filled).alias("f")).select("identity", "ref_id", "f.*").filter("value IS NOT NULL")
    values = rows.groupBy("identity", "field", "value").agg(F.min("ref_id").alias("ref_id"))
    kept = values.groupBy("identity", "field").agg(F.min_by("value", "ref_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return values.join(kept, ["identity", "field"]).filter("value <> kept").select("identity", "field", "kept", F.col("value").alias("offered"))


def edit_log(edits: DataFrame) -> DataFrame:
    """Versions of fields from edits (ref_id, field, value, at): each value with the time it held from and to (null for the present one); an edit to the value that holds changes nothing."""
    w = Window.partitionBy("ref_id", "field").orderBy("at", "value")
    changed = edits.withColumn("was", F.lag(F.struct("value")).over(w)).filter(F.col("was").isNull() | ~F.col("was.value").eqNullSafe(F.col("value")))
    return changed.select("ref_id", "field", "value", F.col("at").alias("from_at"), F.lead("at").over(w).alias("to_at"))


def pivoted(items: DataFrame, data: DataFrame, fields: DataFrame, values: DataFrame, deleted: DataFrame, wanted: list[str]) -> DataFrame:
    """key and one column for each wanted field, from a reference manager's tables of entities, attributes and values; deleted items go."""
    rows = items.join(deleted, "itemID", "left_anti").join(data, "itemID").join(F.broadcast(fields.filter(F.col("fieldName").isin(wanted))), "fieldID").join(values, "valueID")
    per = rows.groupBy("key").pivot("fieldName", wanted).agg(F.min("value"))
    return items.join(deleted, "itemID", "left_anti").select("key").join(per, "key", "left")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    import difflib

    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def close_titles(asked: DataFrame, hits: DataFrame, least: float = 0.9) -> DataFrame:
    """ask_id, ref_id, ratio: of each search's hits (ask_id, ref_id, title_key) the one whose title is most like the asked title_key (twice the matching characters over both lengths), at a ratio of least or more; ties to the least id. Empty titles are like nothing."""
    both = asked.select("ask_id", F.col("title_key").alias("asked_key")).join(hits.select("ask_id", "ref_id", "title_key"), "ask_id").filter("asked_key <> '' AND title_key <> ''")
    close = both.withColumn("ratio", _ratio("asked_key", "title_key")).filter(F.col("ratio") >= least)
    best = close.groupBy("ask_id").agg(F.max(F.struct("ratio", (-F.col("ref_id")).alias("less"))).alias("b"))
    return best.select("ask_id", (-F.col("b.less")).alias("ref_id"), "b.ratio")


def tagged_papers(item_tags: DataFrame, reference_tags: DataFrame, from_feed: DataFrame) -> DataFrame:
    """pid, tag, each once: items (pid, tag) by their own number; references (ref_id, tag) by the item that from_feed (ref_id, item_id) has for them, or else by their negative number."""
    own = reference_tags.join(from_feed, "ref_id", "left").select(F.coalesce("item_id", -F.col("ref_id")).alias("pid"), "tag")
    return item_tags.select("pid", "tag").unionByName(own).distinct()
