"""Bodies of literature searches as rows of papers: Atom and XML by from_xml, JSON by from_json; and one row per paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.shared import may_checkpoint
from tracewright.functions.text import normalise_arxiv

# What of each service's body is read, and kinds of records that are no papers.
ATOM = "entry ARRAY<STRUCT<id: STRING, title: STRING, summary: STRING, published: STRING, author: ARRAY<STRUCT<name: STRING>>, `arxiv:doi`: STRING, doi: STRING>>"
PUBMED = """PubmedArticle ARRAY<STRUCT<
    MedlineCitation: STRUCT<PMID: STRING, Article: STRUCT<ArticleTitle: STRING, Abstract: STRUCT<AbstractText: ARRAY<STRING>>, Journal: STRUCT<Title: STRING, JournalIssue: STRUCT<PubDate: STRUCT<Year: STRING, Month: STRING, Day: STRING>>>, AuthorList: STRUCT<Author: ARRAY<STRUCT<LastName: STRING, ForeName: STRING, CollectiveName: STRING>>>>>,
    PubmedData: STRUCT<ArticleIdList: STRUCT<ArticleId: ARRAY<STRUCT<_VALUE: STRING, _IdType: STRING>>>>>>"""
CROSSREF = "message STRUCT<items: ARRAY<STRUCT<DOI: STRING, type: STRING, title: ARRAY<STRING>, abstract: STRING, `container-title`: ARRAY<STRING>, issued: STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>, author: ARRAY<STRUCT<family: STRING, given: STRING, name: STRING>>, URL: STRING>>>"
OPENALEX = "results ARRAY<STRUCT<id: STRING, type: STRING, doi: STRING, title: STRING, display_name: STRING, publication_date: STRING, abstract_inverted_index: MAP<STRING, ARRAY<INT>>, authorships: ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>>>"
NO_PAPERS = ("component", "journal", "journal-issue", "paratext", "erratum", "peer-review", "grant")


def _tidy(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def family_first(name: Column) -> Column:
    """"Given Family" as "Family, Given"."""
    bare = _tidy(name)
    return F.when(bare.contains(",") | ~bare.contains(" "), bare).otherwise(F.concat(F.regexp_extract(bare, r"(\S+)$", 1), F.lit(", "), F.regexp_replace(bare, r"\s*\S+$", "")))


def rebuilt(index: Column) -> Column:
    """The text whose words' places an inverted index gives."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(spots), lambda s: s["w"]), " ")


def _date(y: Column, m: Column, d: Column) -> Column:
    months = F.array(*[F.lit(x) for x in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")])
    named = F.nullif(F.array_position(months, F.lower(F.substring(m, 1, 3))), F.lit(0))
    return F.when(y.rlike(r"^\d{4}$"), F.format_string("%s-%02d-%02d", y, F.coalesce(m.try_cast("int"), named.cast("int"), F.lit(1)), F.coalesce(d.try_cast("int"), F.lit(1))))


def _rows(bodies: DataFrame, items: Column, client: str, **columns) -> DataFrame:
    rows = bodies.select(F.posexplode(items).alias("place", "e"))
    out = rows.select(F.lit(client).alias("client"), "place", *[c.alias(n) for n, c in columns.items()])
    return out.filter("external_id IS NOT NULL AND title IS NOT NULL")


def parse_arxiv(bodies: DataFrame, body: str = "body") -> DataFrame:
    """client, place, external_id, title, abstract, authors, published, venue, doi, arxiv_id of Atom bodies; ids have no version. Entries without
    an id or a title name no paper and go."""
    e = F.col("e")
    aid = normalise_arxiv(F.nullif(F.regexp_extract(e["id"], r"/abs/(.+)$", 1), F.lit("")))
    authors = F.transform(F.coalesce(e["author"], F.array()), lambda a: family_first(a["name"]))
    return _rows(bodies, F.from_xml(body, ATOM)["entry"], "arxiv", external_id=aid, title=_tidy(e["title"]), abstract=_tidy(e["summary"]), authors=authors, published=F.nullif(F.substring(e["published"], 1, 10), F.lit("")), venue=F.lit(None).cast("string"), doi=_tidy(F.lower(F.coalesce(e["arxiv:doi"], e["doi"]))), arxiv_id=aid)


def parse_pubmed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The same columns of PubMed bodies; the DOI is the article's own."""
    e = F.col("e")
    article, own = e["MedlineCitation"]["Article"], e["PubmedData"]["ArticleIdList"]["ArticleId"]
    date = article["Journal"]["JournalIssue"]["PubDate"]
    person = lambda a: F.coalesce(F.concat_ws(", ", a["LastName"], F.when(a["LastName"].isNotNull(), a["ForeName"])), F.lit(""))
    authors = F.filter(F.transform(F.coalesce(article["AuthorList"]["Author"], F.array()), lambda a: F.coalesce(F.nullif(person(a), F.lit("")), a["CollectiveName"])), lambda a: a.isNotNull())
    doi = F.get(F.filter(own, lambda i: i["_IdType"] == "doi"), F.lit(0))["_VALUE"]
    return _rows(bodies, F.from_xml(body, PUBMED)["PubmedArticle"], "pubmed", external_id=_tidy(e["MedlineCitation"]["PMID"]), title=_tidy(article["ArticleTitle"]), abstract=_tidy(F.array_join(article["Abstract"]["AbstractText"], " ")), authors=authors, published=_date(date["Year"], date["Month"], date["Day"]), venue=_tidy(article["Journal"]["Title"]), doi=_tidy(F.lower(doi)), arxiv_id=F.lit(None).cast("string"))


def parse_crossref(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The same columns of CrossRef bodies."""
    e = F.col("e")
    items = F.filter(F.from_json(body, CROSSREF)["message"]["items"], lambda i: ~F.coalesce(i["type"], F.lit("")).isin(*NO_PAPERS))
    parts = F.get(e["issued"]["date-parts"], F.lit(0))
    part = lambda k: F.get(parts, F.lit(k)).cast("string")
    authors = F.transform(F.coalesce(e["author"], F.array()), lambda a: F.coalesce(F.nullif(F.concat_ws(", ", a["family"], a["given"]), F.lit("")), a["name"]))
    return _rows(bodies, items, "crossref", external_id=_tidy(F.lower(e["DOI"])), title=_tidy(F.get(e["title"], F.lit(0))), abstract=_tidy(F.regexp_replace(e["abstract"], "<[^>]+>", " ")), authors=authors, published=_date(part(0), part(1), part(2)), venue=_tidy(F.get(e["container-title"], F.lit(0))), doi=_tidy(F.lower(e["DOI"])), arxiv_id=F.lit(None).cast("string"))


def parse_openalex(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The same columns of OpenAlex bodies; abstracts come as inverted indexes."""
    e = F.col("e")
    items = F.filter(F.from_json(body, OPENALEX)["results"], lambda i: ~F.coalesce(i["type"], F.lit("")).isin(*NO_PAPERS))
    doi = F.regexp_replace(F.lower(e["doi"]), r"^https?://(?:dx\.)?doi\.org/", "")
    arxiv = F.nullif(F.regexp_extract(doi, r"^10\.48550/arxiv\.(.+)$", 1), F.lit(""))
    authors = F.transform(F.coalesce(e["authorships"], F.array()), lambda a: family_first(a["author"]["display_name"]))
    return _rows(bodies, items, "openalex", external_id=F.nullif(F.regexp_extract(e["id"], r"([^/]*)$", 1), F.lit("")), title=_tidy(F.coalesce(e["title"], e["display_name"])), abstract=rebuilt(e["abstract_inverted_index"]), authors=authors, published=e["publication_date"], venue=F.lit(None).cast("string"), doi=F.when(arxiv.isNull(), _tidy(doi)), arxiv_id=arxiv)


def dedup_papers(papers: DataFrame, order: str, rounds: int = 64) -> DataFrame:
    """Papers (order, doi, arxiv_id) less those that share an id with an earlier paper that stays: a paper is dropped only for one that
    is itself kept. In each round, undecided papers that are first for each of their ids stay, and what shares an id with them goes;
    a chain of k alternating ids takes about k / 2 rounds, and rounds bounds them (an error beyond)."""
    may_checkpoint(papers.sparkSession)
    keys = F.filter(F.array(F.concat(F.lit("d:"), F.lower("doi")), F.concat(F.lit("a:"), F.col("arxiv_id"))), lambda k: k.isNotNull())
    free = papers.filter(F.size(keys) == 0).select(order)
    left = papers.select(order, F.explode(keys).alias("k")).checkpoint()
    kept = free
    for _ in range(rounds):
        if left.isEmpty():
            return papers.join(kept, order, "left_semi")
        first = left.groupBy("k").agg(F.min(order).alias("first"))
        won = left.join(first, "k").groupBy(order).agg(F.min((F.col(order) == F.col("first")).cast("int")).alias("won")).filter("won = 1").select(order).checkpoint()
        kept = kept.unionByName(won)
        gone = left.join(left.join(won, order, "left_semi").select("k").distinct(), "k", "left_semi").select(order).distinct()
        left = left.join(gone, order, "left_anti").checkpoint()
    raise ValueError(f"chains of shared ids are longer than {rounds} rounds decide")
