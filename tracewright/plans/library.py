"""The reference library, the tag graph, text operators, ingest, lineage, statistics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.operators import graph as G
from tracewright.operators import library as L
from tracewright.operators import lineage
from tracewright.operators import mutation as M
from tracewright.plans.registry import query
from tracewright.sources import projections as P
from tracewright.streaming import jobs as J

# ---- library ----------------------------------------------------------------
TITLE = "trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g'))"
REFS = f"""raw AS ({P.REFERENCES_SQL}),
    ids AS (SELECT *, lower(regexp_replace(regexp_replace(raw_doi, '^https://doi.org/', ''), '^DOI:', '')) AS doi,
        regexp_replace(regexp_replace(raw_arxiv, '^arXiv:', ''), 'v[0-9]+$', '') AS arxiv, {TITLE} AS title_key FROM raw),
    refs AS (SELECT *, coalesce('doi:' || doi, 'arxiv:' || arxiv, 'title:' || nullif(title_key, '') || ':' || coalesce(CAST(year AS VARCHAR), '-')) AS identity FROM ids)"""


def refs(spark, sf_dir):
    return L.normalised(P.references(spark, sf_dir))


@query(f"WITH {REFS} SELECT ref_id, doi, arxiv FROM refs")
def ref_normalise_ids(spark, sf_dir):
    return refs(spark, sf_dir).select("ref_id", "doi", "arxiv")


@query(f"WITH {REFS} SELECT ref_id, identity FROM refs")
def ref_identity(spark, sf_dir):
    return refs(spark, sf_dir).select("ref_id", "identity")


@query(f"""WITH {REFS}, k AS (SELECT ref_id, 'doi' AS reason, doi AS key FROM refs UNION ALL SELECT ref_id, 'arxiv', arxiv FROM refs
    UNION ALL SELECT ref_id, 'title', title_key || ':' || coalesce(CAST(year AS VARCHAR), '-') FROM refs WHERE title_key <> '')
    SELECT reason, key, count(*) AS n, min(ref_id) AS first_id FROM k WHERE key IS NOT NULL GROUP BY reason, key HAVING count(*) > 1""")
def ref_duplicates(spark, sf_dir):
    return L.duplicate_groups(refs(spark, sf_dir))


@query(f"""WITH {REFS} SELECT identity, min(ref_id) AS ref_id, count(*) AS n, arg_min(title, ref_id) AS title, arg_min(year, ref_id) FILTER (WHERE year IS NOT NULL) AS year,
    arg_min(lang, ref_id) AS lang, count(DISTINCT year) > 1 AS year_conflict FROM refs GROUP BY identity""")
def ref_merge_fill(spark, sf_dir):
    return L.merge_fill(refs(spark, sf_dir))


@query(f"""WITH {REFS}, asked AS (SELECT ref_id AS ask_id, CASE WHEN ref_id % 5 = 0 THEN doi END AS doi, CASE WHEN ref_id % 2 = 0 THEN arxiv END AS arxiv,
        CASE WHEN ref_id % 11 <> 0 THEN title_key ELSE 'unknown' END AS title_key, CASE WHEN ref_id % 4 <> 0 THEN year END AS year FROM refs),
    h AS (SELECT ask_id, ref_id, 0 AS rung, 0 AS ny FROM asked a JOIN refs r ON a.doi = r.doi UNION ALL SELECT ask_id, ref_id, 1, 0 FROM asked a JOIN refs r ON a.arxiv = r.arxiv
        UNION ALL SELECT ask_id, ref_id, 2, CASE WHEN r.year IS NULL THEN 1 ELSE 0 END FROM asked a JOIN refs r ON a.title_key = r.title_key AND (a.year IS NULL OR r.year IS NULL OR a.year = r.year)),
    b AS (SELECT ask_id, ref_id, rung FROM h QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY rung, ny, ref_id) = 1)
    SELECT a.ask_id, b.ref_id, b.rung FROM asked a LEFT JOIN b ON a.ask_id = b.ask_id""")
def ref_lookup_ladder(spark, sf_dir):
    r = refs(spark, sf_dir)
    i = F.col("ref_id")
    asked = r.select(i.alias("ask_id"), F.when(i % 5 == 0, F.col("doi")).alias("doi"), F.when(i % 2 == 0, F.col("arxiv")).alias("arxiv"), F.when(i % 11 != 0, F.col("title_key")).otherwise("unknown").alias("title_key"), F.when(i % 4 != 0, F.col("year")).alias("year"))
    return L.lookup(asked, r.select("ref_id", "doi", "arxiv", "title_key", "year"))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS citing, 'supp:' || (l_suppkey * 2) AS cited FROM lineitem)
    SELECT citing, cited, s_suppkey IS NOT NULL AS in_library FROM e LEFT JOIN supplier ON cited = 'supp:' || s_suppkey""")
def ref_related(spark, sf_dir):
    e = P.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("citing"), F.concat(F.lit("supp:"), F.col("l_suppkey") * 2).alias("cited"))
    return L.related(e, P.table(spark, sf_dir, "supplier").select(F.concat(F.lit("supp:"), "s_suppkey").alias("key")))


@query("""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS path FROM pages) SELECT page_id, path, count(*) AS n FROM p GROUP BY page_id, path""")
def ref_page_links(spark, sf_dir):
    """Link stubs in raw pages."""
    p = P.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1)).alias("path"))
    return p.groupBy("page_id", "path").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REFS} SELECT ref_id, title_key FROM refs WHERE year BETWEEN 2005 AND 2015 AND lang = 'en' AND starts_with(source, 'src1') AND contains(title_key, 'the')")
def ref_fielded_search(spark, sf_dir):
    return refs(spark, sf_dir).filter(F.col("year").between(2005, 2015) & (F.col("lang") == "en") & F.col("source").startswith("src1") & F.col("title_key").contains("the")).select("ref_id", "title_key")


@query(f"WITH {REFS} SELECT ref_id, year FROM refs WHERE contains(lower(title), 'the') AND contains(lower(title), 'on') ORDER BY year DESC NULLS LAST, ref_id LIMIT 30")
def ref_substring_search(spark, sf_dir):
    return L.substring_search(refs(spark, sf_dir), ["the", "on"], 30)


@query(f"""WITH {REFS}, b AS (SELECT ref_id, coalesce(nullif(string_split(title_key, ' ')[1], ''), 'untitled') || coalesce(CAST(year AS VARCHAR), '') AS base FROM refs),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ref_id) AS n FROM b) SELECT ref_id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS bib_key FROM n""")
def ref_export_keys(spark, sf_dir):
    return L.export_keys(refs(spark, sf_dir))


@query(f"WITH {REFS} SELECT source, count(*) AS n, count(DISTINCT identity) AS papers, count(*) FILTER (WHERE doi IS NULL AND arxiv IS NULL) AS without_id, count(*) FILTER (WHERE year IS NULL) AS without_year FROM refs GROUP BY source")
def ref_status(spark, sf_dir):
    return refs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("identity").alias("papers"), F.count_if(F.col("doi").isNull() & F.col("arxiv").isNull()).alias("without_id"), F.count_if(F.col("year").isNull()).alias("without_year"))


# ---- graph ------------------------------------------------------------------
ASSIGNED = "assigned AS (SELECT DISTINCT l_orderkey AS pid, p_name AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)"
EDGES = f"""{ASSIGNED}, keep AS (SELECT tag FROM assigned GROUP BY tag HAVING count(*) >= 2), s AS (SELECT * FROM assigned WHERE tag IN (SELECT tag FROM keep)),
    w AS (SELECT a.tag AS a, b.tag AS b, count(*) AS weight FROM s a JOIN s b ON a.pid = b.pid AND a.tag < b.tag GROUP BY ALL),
    edges AS (SELECT * FROM w WHERE weight >= (SELECT 1.25 * avg(weight) FROM w)), ways AS (SELECT a AS node, b AS other, weight FROM edges UNION ALL SELECT b, a, weight FROM edges),
    deg AS (SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM ways GROUP BY node)"""


def _assigned(spark, sf_dir):
    lines, parts = P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), P.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("pid"), F.col("p_name").alias("tag"))


def _edges(spark, sf_dir):
    """Pairs at least a quarter more frequent than the average one; baskets make every pair of names meet."""
    e = G.edges(_assigned(spark, sf_dir), 2, 1)
    cut = e.agg((1.25 * F.avg("weight")).alias("cut"))
    return e.join(F.broadcast(cut), F.col("weight") >= F.col("cut")).drop("cut")


@query(f"WITH {EDGES} SELECT * FROM edges")
def kg_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {EDGES} SELECT other, weight FROM ways WHERE node = 'red widget' ORDER BY weight DESC, other LIMIT 20")
def kg_neighbors(spark, sf_dir):
    return G.both_ways(_edges(spark, sf_dir)).filter("node = 'red widget'").orderBy(F.desc("weight"), "other").select("other", "weight").limit(20)


@query(f"WITH {EDGES} SELECT * FROM deg")
def kg_degree(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir))


@query(f"""WITH {EDGES}, u AS (SELECT tag, count(*) AS n FROM assigned GROUP BY tag) SELECT (SELECT count(*) FROM u) AS distinct_tags, (SELECT round(100 * count(*) FILTER (WHERE n = 1) / count(*), 1) FROM u) AS singleton_rate,
    count(*) AS nodes, max(degree) AS max_degree, round(100 * max(degree) / sum(degree), 1) AS hub_dominance_pct, quantile_disc(degree, 0.5) AS median_degree FROM deg""")
def kg_health(spark, sf_dir):
    return G.health(_assigned(spark, sf_dir), _edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, walk AS (SELECT 'red widget' AS node, 0 AS hops, 'red widget' AS path UNION ALL
        SELECT other, min(hops) + 1, min(path || ' > ' || other) FROM walk JOIN ways USING (node) WHERE hops < 4 AND NOT contains(path, other) GROUP BY other),
    best AS (SELECT node, min(hops) AS hops FROM walk GROUP BY node) SELECT w.node, CAST(w.hops AS INTEGER) AS hops, min(path) AS path FROM walk w JOIN best b ON w.node = b.node AND w.hops = b.hops GROUP BY ALL""")
def kg_shortest_path(spark, sf_dir):
    return G.shortest_paths(_edges(spark, sf_dir), "red widget", 4)


@query(f"WITH {ASSIGNED} SELECT tag, count(*) AS n FROM assigned GROUP BY tag ORDER BY n DESC, tag LIMIT 150")
def kg_tag_vocabulary(spark, sf_dir):
    return _assigned(spark, sf_dir).distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(150)


@query()
def kg_betweenness(spark, sf_dir):
    return G.betweenness(_edges(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query()
def kg_communities(spark, sf_dir):
    return G.communities(_edges(spark, sf_dir))


# ---- text -------------------------------------------------------------------
@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS body FROM pages""")
def text_strip(spark, sf_dir):
    return P.table(spark, sf_dir, "pages").select("page_id", X.strip_markup(F.col("html")).alias("body"))


@query(f"WITH i AS ({P.ITEMS_SQL}) SELECT item_id, sha256(title || chr(10) || summary) AS content_hash FROM i")
def text_content_hash(spark, sf_dir):
    return P.items(spark, sf_dir).select("item_id", X.content_hash(F.col("title"), F.col("summary")).alias("content_hash"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOPWORDS)
_STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) > {len(s) + 3} THEN left(w, length(w) - {len(s)})" for s in X.SUFFIXES) + " ELSE w END"
_WORDS = r"unnest(regexp_extract_all({c}, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'))"


@query(f"""WITH w AS (SELECT doc_id, 'a' AS side, lower({_WORDS.format(c="substring(text, 1, 60)")}) AS w FROM documents UNION ALL SELECT doc_id, 'b', lower({_WORDS.format(c="substring(text, 61)")}) FROM documents),
    s AS (SELECT DISTINCT doc_id, side, {_STEM} AS stem FROM w WHERE w NOT IN ({_STOP})), n AS (SELECT doc_id, count(*) AS n FROM s WHERE side = 'a' GROUP BY doc_id),
    h AS (SELECT a.doc_id, count(*) AS h FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.stem = b.stem AND a.side = 'a' AND b.side = 'b' GROUP BY a.doc_id)
    SELECT d.doc_id, round(coalesce(h / n, 0), 6) AS coverage FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id)""")
def text_stems_coverage(spark, sf_dir):
    """How much of a text's beginning its rest covers."""
    return P.table(spark, sf_dir, "documents").select("doc_id", F.round(X.coverage(F.substring("text", 1, 60), F.expr("substring(text, 61)")), 6).alias("coverage"))


_NEG = ", ".join(f"'{w}'" for w in X.NEGATIONS)
_NEGSTEM = ", ".join(f"'{w}'" for w in X.NEGATION_STEMS)


@query(f"""WITH w AS (SELECT conv_id, turn, lower({_WORDS.format(c="text || ' not challenges ' || role")}) AS w FROM conversations), s AS (SELECT DISTINCT conv_id, turn, w FROM w WHERE ends_with(w, 'n''t') OR w IN ({_NEG}) OR ({_STEM}) IN ({_NEGSTEM}))
    SELECT conv_id, turn, string_agg(w, ' ' ORDER BY w) AS negations FROM s GROUP BY conv_id, turn""")
def text_negation(spark, sf_dir):
    t = F.concat("text", F.lit(" not challenges "), "role")
    return P.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(X.negations(t))))), " ").alias("negations"))


@query(r"WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+[.][0-9]+')) AS x FROM documents) SELECT doc_id, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 4) AS total FROM n GROUP BY doc_id")
def text_numbers(spark, sf_dir):
    n = P.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]+[.][0-9]+)"), 1)).alias("x"))
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x").cast("double")), 4).alias("total"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'run-' || (s_suppkey % 7) WHEN 1 THEN 'clf' WHEN 2 THEN 'base-run' ELSE NULL END AS family FROM supplier""")
def text_family_of(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("run_"), k % 7, F.lit("_step_"), k, F.lit("000"))).when(k % 4 == 1, F.concat(F.lit("clf_knn_seed"), k)).when(k % 4 == 2, F.concat(F.lit("base_run_v"), k)).otherwise("single")
    return P.table(spark, sf_dir, "supplier").select("s_suppkey", X.family_of(name).alias("family"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '://[^/\s:@]+:[^/\s@]+@') THEN 0 WHEN regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') THEN 1 WHEN regexp_matches(text, '\bgh[pousr]_[A-Za-z0-9]{30,}') THEN 2
    WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 3 WHEN regexp_matches(text, '(?i)\b(api[_-]?key|secret|password|token)\s*[=:]\s*\S{8,}') THEN 4 ELSE -1 END AS kind FROM documents""")
def text_credentials(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", X.credentials(F.col("text")).alias("kind"))


@query("SELECT doc_id, array_to_string(string_split(text, ' '), ' ') AS rebuilt FROM documents")
def inverted_index_rebuild(spark, sf_dir):
    """Texts as word -> places, and back again."""
    # Texts are dealt by their document while they are whole; words and places then stay where they are.
    words = P.table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word"))
    index = words.groupBy("doc_id", "word").agg(F.collect_list("at").alias("places"))
    back = index.select("doc_id", "word", F.explode("places").alias("at")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return back.select("doc_id", F.array_join(F.transform("w", lambda w: w["word"]), " ").alias("rebuilt"))


@query()
def text_sentences(spark, sf_dir):
    s = P.table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(X.sentences("text")).alias("n", "at"))
    return s.select("doc_id", "n", F.col("at.start").alias("start"), F.col("at.end").alias("end"))


@query()
def text_negated_scopes(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", F.explode(X.negated_scopes("text")).alias("s")).select("doc_id", "s.cue", "s.start", "s.scope", "s.end")


@query()
def text_quantities(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", F.explode(X.quantities("text")).alias("q")).select("doc_id", "q.value", "q.unit", "q.start", "q.end", "q.after")


@query()
def support_verdict(spark, sf_dir):
    """Each first sentence against the rest of its text: supported, partial or not found."""
    d = P.table(spark, sf_dir, "documents").select("doc_id", "text", X.first_sentence("text").alias("s"))
    claim, rest = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), F.substring(F.col("text"), F.col("s.end") + 1, F.length("text"))
    parts = d.select("doc_id", F.when(F.col("s").isNotNull(), claim).alias("claim"), rest.alias("source"))
    return X.support(parts).select("doc_id", F.round("coverage", 6).alias("coverage"), "verdict")


# ---- ingest, mutation, lineage ----------------------------------------------
@query("WITH h AS (SELECT doc_id, sha256(text) AS hash FROM documents), s AS (SELECT hash FROM h WHERE doc_id % 10 = 0), f AS (SELECT hash, min(doc_id) AS id FROM h WHERE doc_id % 10 <> 0 GROUP BY hash) SELECT hash, id FROM f WHERE hash NOT IN (SELECT hash FROM s)")
def ingest_dedup(spark, sf_dir):
    h = P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    return M.ingest_new(h.filter("id % 10 <> 0"), h.filter("id % 10 = 0").select("hash"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def ingest_worklist(spark, sf_dir):
    """Documents without a vector."""
    return P.table(spark, sf_dir, "documents").select("doc_id").join(P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query(f"WITH c AS ({P.CLICKS_SQL}) SELECT user_id, item_id, useful, source FROM c")
def click_upsert(spark, sf_dir):
    return P.clicks(spark, sf_dir).select("user_id", "item_id", "useful", "source")


@query(f"""WITH c AS ({P.RAW_CLICKS_SQL}), g AS (SELECT user_id, item_id, arg_max(useful, (ts, event_id)) AS last, min(CASE WHEN useful = 1 AND source IN ('ui', 'agent') THEN 0 WHEN useful = 1 THEN 1 END) AS best, sum(1 - useful) AS rejects FROM c GROUP BY user_id, item_id)
    SELECT user_id, item_id, CASE WHEN best = 0 THEN 'useful' ELSE 'read' END AS reason, last = 0 AS removed, rejects FROM g WHERE best IS NOT NULL""")
def bibliography_fold(spark, sf_dir):
    return M.fold_bibliography(P.raw_clicks(spark, sf_dir))


@query(f"""WITH c AS ({P.CLICKS_SQL}), m AS (SELECT user_id AS was, user_id % 50 AS user_id, item_id, useful FROM c)
    SELECT user_id, item_id, arg_min(useful, (was <> user_id, was)) AS useful, count(DISTINCT useful) > 1 AS conflict, count(*) AS n FROM m GROUP BY user_id, item_id""")
def id_remap_merge(spark, sf_dir):
    """Users merged into those with the same remainder by 50; the keeper's verdict stays."""
    c = P.clicks(spark, sf_dir)
    moves = c.select(F.col("user_id").alias("drop_id"), (F.col("user_id") % 50).alias("keep_id")).distinct().filter("drop_id <> keep_id")
    return M.merge_users(c.select("user_id", "item_id", "useful"), moves)


@query("""SELECT DISTINCT o_orderkey AS run, 'customer:' || c_custkey || ' > nation:' || n_nationkey || ' > region:' || r_regionkey AS chain, n_name, r_name
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def lineage_closure(spark, sf_dir):
    """Each order's chain of sources."""
    o, c, n, r = (P.table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    chain = F.concat(F.lit("customer:"), "c_custkey", F.lit(" > nation:"), "n_nationkey", F.lit(" > region:"), "r_regionkey")
    return j.select(F.col("o_orderkey").alias("run"), chain.alias("chain"), "n_name", "r_name").distinct()


@query("""WITH e AS (SELECT DISTINCT p_partkey AS parent, p_partkey * 2 + k AS child FROM part, (VALUES (1), (2)) v(k)), t AS (SELECT parent, child FROM e WHERE child IN (SELECT p_partkey FROM part)),
    w AS (WITH RECURSIVE r(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT child, depth + 1 FROM r JOIN t ON parent = node) SELECT * FROM r) SELECT node, depth FROM w""")
def include_tree(spark, sf_dir):
    """Everything below a root, level by level."""
    nodes = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("parent")).distinct()
    edges = nodes.select("parent", F.explode(F.array(F.col("parent") * 2 + 1, F.col("parent") * 2 + 2)).alias("child"))
    edges = edges.join(nodes.select(F.col("parent").alias("child")), "child", "left_semi")
    return lineage.descendants(edges, spark.range(1).select(F.col("id").alias("node")))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS whole, sha256(substring(text, 1, 60)) AS head FROM documents), b AS (SELECT whole, min(doc_id) AS id FROM d WHERE doc_id % 3 = 0 GROUP BY whole), h AS (SELECT head, min(doc_id) AS id FROM d WHERE doc_id % 3 = 0 GROUP BY head)
    SELECT d.doc_id, coalesce(b.id, h.id) AS source_id, CASE WHEN b.id IS NOT NULL THEN 'content' WHEN h.id IS NOT NULL THEN 'head' ELSE 'none' END AS tier FROM d LEFT JOIN b USING (whole) LEFT JOIN h USING (head) WHERE d.doc_id % 3 <> 0""")
def digest_join_tiers(spark, sf_dir):
    """The source of a text by its whole digest, or else by that of its beginning."""
    d = P.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("whole"), F.sha2(F.substring("text", 1, 60), 256).alias("head"))
    kept = d.filter("doc_id % 3 = 0")
    b, h = kept.groupBy("whole").agg(F.min("doc_id").alias("b")), kept.groupBy("head").agg(F.min("doc_id").alias("h"))
    j = d.filter("doc_id % 3 <> 0").join(b, "whole", "left").join(h, "head", "left")
    return j.select("doc_id", F.coalesce("b", "h").alias("source_id"), F.when(F.col("b").isNotNull(), "content").when(F.col("h").isNotNull(), "head").otherwise("none").alias("tier"))


# ---- statistics -------------------------------------------------------------
@query("""WITH w AS (SELECT date_trunc('week', ts) AS week, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1), b AS (SELECT min(week) AS a, max(week) AS z FROM w), s AS (SELECT unnest(range(a, z + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS week FROM b)
    SELECT strftime(s.week, '%Y-%m-%d') AS week, coalesce(n, 0) AS n FROM s LEFT JOIN w ON s.week = w.week""")
def weekly_ingest_zero_filled(spark, sf_dir):
    return L.weekly_counts(P.table(spark, sf_dir, "events"))


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, count(DISTINCT sha256(text)) AS texts FROM documents GROUP BY source")
def by_source_counts(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"), F.count_distinct(F.sha2("text", 256)).alias("texts"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events), m AS (SELECT user_id, median(gap) AS mid FROM g WHERE gap > 0 GROUP BY user_id)
    SELECT g.user_id, count(*) AS n, round(avg(gap) / 1e6, 3) AS seconds FROM g JOIN m ON g.user_id = m.user_id WHERE gap > 0 AND gap <= 10 * mid GROUP BY g.user_id""")
def gap_estimate(spark, sf_dir):
    """Seconds between a user's events, without the gaps of over ten medians."""
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = P.table(spark, sf_dir, "events").select("user_id", (us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap")).filter("gap > 0")
    mid = g.groupBy("user_id").agg(F.median("gap").alias("mid"))
    return g.join(mid, "user_id").filter("gap <= 10 * mid").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap") / 1e6, 3).alias("seconds"))


@query("SELECT CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END AS predicted, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def eval_confusion(spark, sf_dir):
    d = P.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 1500, 1).otherwise(0).alias("predicted"))
    return d.join(P.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").groupBy("predicted", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH j AS (SELECT n_chars, quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id))
    SELECT count(*) AS n, round((sum(CASE WHEN quality = 1 THEN r ELSE 0 END) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * sum(1 - quality)), 6) AS auc FROM j""")
def rank_auc(spark, sf_dir):
    """AUC by tie-averaged ranks; the ranks come from counts per score, not from one window."""
    from tracewright.operators.ranking import average_ranks

    j = P.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(P.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    r = average_ranks(j.withColumn("down", -F.col("score")), "down").withColumn("r", F.col("avg_rank") + 1)
    pos, neg = F.sum("quality"), F.sum(1 - F.col("quality"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.round((F.sum(F.when(F.col("quality") == 1, F.col("r")).otherwise(0.0)) - pos * (pos + 1) / 2) / (pos * neg), 6).alias("auc"))


# ---- streams ----------------------------------------------------------------
@query("SELECT DISTINCT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def stream_dedup(spark, sf_dir):
    e = P.table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), "ts")
    return J.dedup_stream(e, ["user_id", "event_type", "k"]).select("user_id", "event_type", "k")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_idle_sessions(spark, sf_dir):
    e = P.table(spark, sf_dir, "events").select("user_id", "ts")
    return J.idle_sessions(e, "user_id", "ts", "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


STATE = "CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'complete' ELSE 'failed' END"


@query(f"""WITH s AS (SELECT user_id, event_id, {STATE} AS state, lag({STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT event_id, state, before, CASE WHEN before IS NULL THEN state = 'submitted' ELSE (before, state) IN (('submitted', 'running'), ('submitted', 'cancelled'), ('submitted', 'failed'), ('running', 'complete'), ('running', 'failed'), ('running', 'cancelled')) END AS allowed FROM s""")
def stream_state_machine(spark, sf_dir):
    e = P.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr(STATE).alias("state"))
    return J.transitions(e, "user_id", ["ts", "event_id"], "state").select("event_id", "state", "before", "allowed")


@query(f"""WITH c AS ({P.CLICKS_SQL}), k AS (SELECT user_id, item_id, ts AS clicked_at FROM c WHERE source = 'ui'), v AS (SELECT user_id, item_id, useful, ts AS judged_at FROM c WHERE source <> 'ui')
    SELECT v.user_id, v.item_id, v.useful FROM v LEFT JOIN k USING (user_id, item_id) WHERE judged_at >= TIMESTAMP '2024-01-15' AND (clicked_at IS NULL OR judged_at > clicked_at)""")
def stream_late_verdicts(spark, sf_dir):
    c = P.clicks(spark, sf_dir)
    k, v = c.filter("source = 'ui'").select("user_id", "item_id", F.col("ts").alias("clicked_at")), c.filter("source <> 'ui'").select("user_id", "item_id", "useful", F.col("ts").alias("at"))
    return J.late_verdicts(v, k, F.lit("2024-01-15").cast("timestamp_ntz"))


# ---- verification -----------------------------------------------------------
FIGURES = "o_orderkey AS figure, o_orderkey % 5 <> 0 AS referenced, o_orderkey % 7 <> 0 AS \"exists\", o_orderdate AS made_at"


@query(f"""WITH f AS (SELECT {FIGURES}, max(l_shipdate) AS source_at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 GROUP BY ALL)
    SELECT figure, CASE WHEN referenced AND NOT "exists" THEN 'missing' WHEN NOT referenced THEN 'orphan' WHEN source_at > made_at THEN 'stale' ELSE 'fresh' END AS verdict FROM f""")
def figure_freshness(spark, sf_dir):
    from tracewright.operators.verification import figure_freshness as judge

    k = F.col("o_orderkey")
    sources = P.table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("source_at"))
    o = P.table(spark, sf_dir, "orders").join(sources, "o_orderkey", "left")
    return judge(o.select(k.alias("figure"), (k % 5 != 0).alias("referenced"), (k % 7 != 0).alias("exists"), F.col("o_orderdate").alias("made_at"), "source_at"))


@query("""WITH r AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'paused' END AS status, o_orderkey % 9 = 0 AS backwards, o_orderkey % 4 AS n_metrics, o_orderkey % 6 <> 0 AS has_producer, o_orderkey % 8 = 0 AS leaks FROM orders)
    SELECT run_id, 'unknown status' AS rule FROM r WHERE status = 'paused' UNION ALL SELECT run_id, 'ends before it starts' FROM r WHERE backwards UNION ALL SELECT run_id, 'terminal without an end' FROM r WHERE status = 'complete' AND NOT backwards
    UNION ALL SELECT run_id, 'complete without metrics' FROM r WHERE status = 'complete' AND n_metrics = 0 UNION ALL SELECT run_id, 'no producer' FROM r WHERE NOT has_producer UNION ALL SELECT run_id, 'credential in config' FROM r WHERE leaks""")
def run_conformance(spark, sf_dir):
    from tracewright.operators.verification import conformance

    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running").otherwise("paused")
    return conformance(P.table(spark, sf_dir, "orders").select(k.alias("run_id"), status.alias("status"), d.alias("started_at"), F.when(k % 9 == 0, d - F.expr("INTERVAL 1 DAY")).alias("finished_at"), (k % 4).alias("n_metrics"), (k % 6 != 0).alias("has_producer"), F.when(k % 8 == 0, "api_key=abcdefgh1234").otherwise("lr=0.1").alias("config")))


@query("""WITH h AS (SELECT doc_id % 50 AS model, sha256(text) AS d FROM documents), o AS (SELECT DISTINCT doc_id % 40 AS run_id, sha256(text) AS d FROM documents), s AS (SELECT model, count(*) AS n FROM h GROUP BY model),
    c AS (SELECT model, run_id, count(*) AS covered FROM h JOIN o USING (d) GROUP BY model, run_id), b AS (SELECT * FROM c QUALIFY covered = max(covered) OVER (PARTITION BY model)), r AS (SELECT *, count(*) OVER (PARTITION BY model) AS runs FROM b)
    SELECT model, run_id, covered, CASE WHEN runs > 1 THEN 'ambiguous producer' WHEN covered < n THEN 'partial output' END AS issue FROM r JOIN s USING (model)""")
def model_trace(spark, sf_dir):
    from tracewright.operators.verification import model_producers

    d = P.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return model_producers(d.select((F.col("doc_id") % 50).alias("model"), "sha256"), d.select((F.col("doc_id") % 40).alias("run_id"), "sha256"))


@query()
def classifier_rank(spark, sf_dir):
    """Items by how likely user 1 finds them useful."""
    from tracewright.operators.ranking import positions
    from tracewright.operators.verification import classified, click_classifier

    v = P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    model = click_classifier(P.clicks(spark, sf_dir).filter("user_id = 1"), v)
    if model is None:
        return v.select("item_id", F.lit(None).cast("double").alias("p"), F.lit(0).cast("long").alias("rank"))
    return positions(classified(model, v).withColumn("p", F.round("p", 6)), "p", "item_id").select("item_id", "p", F.col("rank").cast("long"))
