"""Who cites whom: what each paper of a library cites and what in it cites the paper, for all papers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: as many neighbours are listed in a direction, beside the true count.
MOST = 20


def forms(refs: DataFrame) -> DataFrame:
    """ref_id, form, rung: an identity, then the DOI and the arXiv id written as identities, each once."""
    named = lambda rung, c: F.struct(F.lit(rung).alias("rung"), c.alias("form"))
    names = F.array(named(0, F.col("identity")), named(1, F.concat(F.lit("doi:"), "doi")), named(2, F.concat(F.lit("arxiv:"), "arxiv")))
    each = refs.select("ref_id", F.inline(F.filter(names, lambda x: x["form"].isNotNull())))
    return each.groupBy("ref_id", "form").agg(F.min("rung").alias("rung"))


def named_rows(cited: DataFrame, refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """cited_identity, other_id: the row that each of the distinct identities names; those that none has are absent.

    By identity, DOI, arXiv id, then the normalised title of ``title:<key>:<year>`` (rows of that year, or of any if none is given, before rows without a
    year), then an alias (alias, ref_id) of a row that was merged; the first that hits, then the least id. Rows are joined as one least id for each form, title
    and year, so many rows of one title are one row of the join.
    """
    asked = cited.select("cited_identity").filter("cited_identity IS NOT NULL").distinct()
    direct = forms(refs).groupBy("form", "rung").agg(F.min("ref_id").alias("ref_id"))
    exact = direct.unionByName(aliases.groupBy(F.col("alias").alias("form")).agg(F.min("ref_id").alias("ref_id")).withColumn("rung", F.lit(4)))
    hits = asked.join(exact, F.col("cited_identity") == F.col("form")).select("cited_identity", "rung", F.lit(False).alias("no_year"), "ref_id")
    key, tail = F.regexp_extract("cited_identity", "(?s)^title:(.*):[^:]*$", 1), F.regexp_extract("cited_identity", "(?s):([^:]*)$", 1)
    titled = asked.filter(F.col("cited_identity").startswith("title:") & (key != "")).select("cited_identity", key.alias("title_key"), F.when(tail.rlike("^[0-9]+$"), tail.try_cast("int")).alias("_year"))
    years = refs.groupBy("title_key", "year").agg(F.min("ref_id").alias("ref_id"))
    fits = F.col("year").isNull() | F.col("_year").isNull() | (F.col("year") == F.col("_year"))
    by_title = titled.join(years, "title_key").filter(fits).select("cited_identity", F.lit(3).alias("rung"), F.col("year").isNull().alias("no_year"), "ref_id")
    return hits.unionByName(by_title).groupBy("cited_identity").agg(F.min(F.struct("rung", "no_year", "ref_id"))["ref_id"].alias("other_id"))


def citing_totals(own: DataFrame, citing: DataFrame) -> DataFrame:
    """ref_id, total: how many different rows cite one of a row's forms (own: ref_id, form; citing: form, other_id, distinct).

    The form that most cite is counted as it is, and only those that cite another form are looked for among them, so that rows that share a much-cited form
    don't meet everything that cites it."""
    sizes = citing.groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    sets = own.join(sizes, "form").groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("n", "form"))).alias("forms"))
    several = sets.filter(F.size("forms") > 1).select("forms").distinct()
    fewer = several.select("forms", F.element_at("forms", -1)["form"].alias("largest"), F.explode(F.slice("forms", F.lit(1), F.size("forms") - 1)["form"]).alias("form"))
    there = fewer.join(citing, "form").select("forms", "largest", "other_id").distinct()
    beyond = there.join(citing.withColumnRenamed("form", "largest"), ["largest", "other_id"], "left_anti").groupBy("forms").agg(F.count(F.lit(1)).alias("beyond"))
    return sets.join(beyond, "forms", "left").select("ref_id", (F.element_at("forms", -1)["n"] + F.coalesce("beyond", F.lit(0))).alias("total"))


def neighbours(refs: DataFrame, edges: DataFrame, aliases: DataFrame, most: int | None = MOST) -> DataFrame:
    """ref_id, direction (cites, cited_by), place, identity, title, in_library, other_id, total for each row of refs that has a neighbour.

    refs: ref_id, identity, doi, arxiv, title, title_key, year; edges: citing_id, cited_identity, cited_title, repeats counting once, and those of rows that
    aren't in refs not at all. A cited identity lands on the row that it names by now; others are stubs with the title of the edge (the least of several). A row is cited
    by what names its identity, DOI or arXiv id. In order: rows of the library, stubs with an id, stubs with a title alone, then by title. ``most`` are listed
    (None: all), and total counts them all.
    """
    e = edges.groupBy("citing_id", "cited_identity").agg(F.min("cited_title").alias("cited_title")).filter("cited_identity IS NOT NULL")
    e = e.join(refs.select(F.col("ref_id").alias("citing_id")), "citing_id", "left_semi")
    row = refs.select(F.col("ref_id").alias("other_id"), F.col("identity").alias("_identity"), F.col("title").alias("_title"))
    found = e.join(named_rows(e, refs, aliases), "cited_identity", "left").join(row, "other_id", "left")
    there = F.col("other_id").isNotNull()
    cites = found.select(F.col("citing_id").alias("ref_id"), F.lit("cites").alias("direction"), F.col("cited_identity").alias("identity"), F.when(there, F.col("_title")).otherwise(F.col("cited_title")).alias("title"), there.alias("in_library"), "other_id")
    order = [~F.col("in_library"), F.col("identity").startswith("title:"), F.lower(F.coalesce("title", F.lit(""))), "identity", "other_id"]
    citing = e.select(F.col("cited_identity").alias("form"), F.col("citing_id").alias("other_id"))
    by_form = citing.join(row, "other_id").select("form", F.lit("cited_by").alias("direction"), F.col("_identity").alias("identity"), F.col("_title").alias("title"), F.lit(True).alias("in_library"), "other_id")
    if most is not None:  # a row's first ones are among the first ones of its forms
        by_form = by_form.withColumn("_place", F.row_number().over(Window.partitionBy("form").orderBy(*order))).filter(F.col("_place") <= most).drop("_place")
    own = forms(refs).select("ref_id", "form")
    cited_by = own.join(by_form, "form").select(*cites.columns).distinct()
    of_cited = cited_by.groupBy("ref_id", "direction").agg(F.count(F.lit(1)).alias("total")) if most is None else citing_totals(own, citing).withColumn("direction", F.lit("cited_by"))
    totals = cites.groupBy("ref_id", "direction").agg(F.count(F.lit(1)).alias("total")).unionByName(of_cited)
    placed = cites.unionByName(cited_by).withColumn("place", F.row_number().over(Window.partitionBy("ref_id", "direction").orderBy(*order)))
    return (placed if most is None else placed.filter(F.col("place") <= most)).join(totals, ["ref_id", "direction"])
