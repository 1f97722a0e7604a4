"""Drafts, tags, bibliographies, records and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import drafts as D
from tracewright.functions import records as R
from tracewright.functions import text as X
from tracewright.operators import feed as O
from tracewright.plans.feed import _tags
from tracewright.plans.library import REFS, refs
from tracewright.plans.registry import query
from tracewright.sources import literature as L
from tracewright.sources import projections as P

STOP = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in X.STOPWORDS) + "]"


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '({X.WORD.replace("'", "''")})', 1) AS ws FROM documents),
    n AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w)
    SELECT doc_id, w AS name FROM n WHERE (len(regexp_extract_all(w, '[A-Z]')) >= 2 OR regexp_matches(w, '[0-9]') OR (regexp_matches(w, '^[A-Z]') AND i > 0))
    AND NOT regexp_full_match(w, '[0-9.,]+') AND NOT list_contains({STOP}, lower(w)) GROUP BY doc_id, w""")
def text_entities(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", F.explode(D.entities(F.col("text"))).alias("name"))


@query("SELECT doc_id, regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), '^the ', '') AS venue_key FROM documents")
def venue_keys(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", D.venue_key(F.col("text")).alias("venue_key"))


@query()
def text_measured_numbers(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", F.size(D.measured_numbers(F.col("text"))).alias("n"))


# ---- tags ----
TAGS = "tags AS (SELECT DISTINCT item_id, tag FROM (SELECT doc_id AS item_id, unnest(string_split(lower(text), ' ')) AS tag FROM documents) WHERE length(tag) >= 5)"
SINGULAR = "CASE WHEN length({f}) >= 4 AND {f} LIKE '%s' AND " + " AND ".join(f"{{f}} NOT LIKE '%{e}'" for e in D.NO_PLURAL) + " THEN {f}[:-2] ELSE {f} END"
FOLD = SINGULAR.format(f="regexp_replace({t}, '[-_]', '', 'g')")
ALIASES = "aliases AS (SELECT tag AS alias, max(other) AS target FROM (SELECT a.tag, b.tag AS other FROM (SELECT DISTINCT tag FROM tags) a JOIN (SELECT DISTINCT tag FROM tags) b ON a.tag[:4] = b.tag[:4]) GROUP BY tag HAVING count(*) BETWEEN 2 AND 3)"


CANONICAL = f"""{ALIASES}, own AS (SELECT alias, min(target) AS a FROM aliases GROUP BY alias), folds AS (SELECT {FOLD.replace("{t}", "target")} AS fold, min(target) AS f FROM aliases GROUP BY 1)
    SELECT item_id, tag, coalesce(a, f, tag) AS canonical FROM tags LEFT JOIN own ON tag = alias LEFT JOIN folds ON fold = {FOLD.replace("{t}", "tag")}"""


def _canonical(tags):
    # a stand-in for a curated table: words of a small family that share their first letters go by its last
    family = tags.select("tag").distinct().withColumn("head", F.substring("tag", 1, 4))
    heads = family.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.max("tag").alias("target")).filter("n BETWEEN 2 AND 3")
    return D.canonical_tags(tags, family.join(heads, "head").select(F.col("tag").alias("alias"), "target"))


@query(f"WITH {TAGS}, {CANONICAL}")
def tag_canonical(spark, sf_dir):
    return _canonical(_tags(spark, sf_dir).select("item_id", "tag"))


SUGGESTED = """liked AS (SELECT DISTINCT user_id, tag FROM clicks JOIN tags USING (item_id) WHERE useful = 1),
    held AS (SELECT DISTINCT documents.source, tag FROM tags JOIN documents ON item_id = doc_id), has AS (SELECT DISTINCT user_id, documents.source FROM clicks JOIN documents ON item_id = doc_id),
    scored AS (SELECT user_id, source, count(*) AS score FROM liked JOIN held USING (tag) ANTI JOIN has USING (user_id, source) GROUP BY user_id, source)
    SELECT user_id, source, score FROM scored QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, source) <= 5"""


def _suggested(spark, sf_dir, tags):
    clicks, items = P.clicks(spark, sf_dir), P.items(spark, sf_dir).select("item_id", F.col("feed").alias("source"))
    return O.suggest_sources(clicks, tags.select("item_id", "tag"), items)


@query(f"WITH clicks AS ({P.CLICKS_SQL}), {TAGS}, {SUGGESTED}")
def feed_suggest_sources(spark, sf_dir):
    return _suggested(spark, sf_dir, _tags(spark, sf_dir))


# ---- bibliographies ----
ESCAPE = "{v}"
for _raw, _safe in D.ESCAPED.items():
    ESCAPE = f"replace({ESCAPE}, '{_raw}', '{_safe}')"
TEX = f"CASE WHEN contains({{v}}, '\\') OR contains({{v}}, '{{{{') THEN {{v}} ELSE {ESCAPE.replace('{}', '{{}}')} END"


def _line(name, value):
    return f"CASE WHEN coalesce({value}, '') <> '' THEN '  {name} = {{' || {TEX.format(v=value)} || '}},' || chr(10) ELSE '' END".replace("}},' ||", "},' ||")


@query(f"""WITH {REFS} SELECT ref_id, '@' || 'misc' || '{{' || 'ref' || ref_id || ',' || chr(10) || {_line("title", "title")} || {_line("year", "CAST(year AS VARCHAR)")} || {_line("doi", "doi")} || {_line("eprint", "arxiv")} || '}}' || chr(10) AS entry FROM refs""")
def bib_render(spark, sf_dir):
    entry = D.bib_entry(F.lit("misc"), F.concat(F.lit("ref"), "ref_id"), {"title": F.col("title"), "year": F.col("year").cast("string"), "doi": F.col("doi"), "eprint": F.col("arxiv")})
    return refs(spark, sf_dir).select("ref_id", entry.alias("entry"))


@query()
def papers_dedup(spark, sf_dir):
    return L.dedup_papers(refs(spark, sf_dir).select("ref_id", "doi", F.col("arxiv").alias("arxiv_id")), "ref_id").select("ref_id")


# ---- records ----
@query("SELECT event_id, replace(replace(props, ': ', ':'), ', ', ',') AS canonical, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || 'Z' AS at FROM events")
def record_canonical(spark, sf_dir):
    return P.table(spark, sf_dir, "events").select("event_id", R.canonical("props").alias("canonical"), R.utc_text(F.col("ts")).alias("at"))


# ---- questions ----
def _routes_sql(namespace):
    q = "(' ' || lower(trim(coalesce(text, ''))))"
    cue = lambda c: f"regexp_matches({q}, '\\b{c[0]}')" if isinstance(c, tuple) else f"contains({q}, '{c}')"
    return "CASE " + " ".join(f"WHEN {' OR '.join(map(cue, cues))} THEN '{tool}'" for tool, cues in D.ROUTES[namespace]) + " END"


@query(f"SELECT conv_id, turn, {', '.join(f'{_routes_sql(n)} AS {n}_tool' for n in D.ROUTES)} FROM conversations")
def question_routes(spark, sf_dir):
    return P.table(spark, sf_dir, "conversations").select("conv_id", "turn", *[D.route(F.col("text"), n).alias(f"{n}_tool") for n in D.ROUTES])
