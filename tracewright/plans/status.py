"""Queries on runs in flight, corpora, link ids, cleaned text and library upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.operators import corpora, inflight
from tracewright.operators import library as L
from tracewright.plans.registry import query
from tracewright.sources import projections as P

STATES = """s AS (SELECT o_orderkey AS run, CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'submitted' WHEN '3-MEDIUM' THEN 'complete' WHEN '5-LOW' THEN 'failed' END AS state,
        o_orderdate AS updated_at, o_orderdate + to_minutes(CAST(o_custkey % 300 AS BIGINT)) AS seen_at, o_orderstatus = 'F' AS has_record FROM orders),
    t AS (SELECT CAST(max(o_orderdate) AS TIMESTAMP) + INTERVAL 3 HOUR AS now FROM orders),
    k AS (SELECT *, CASE WHEN state IS NULL THEN CASE WHEN has_record THEN NULL ELSE 'unreadable' END WHEN has_record THEN CASE WHEN state IN ('complete', 'failed') THEN NULL ELSE 'lagging' END
        WHEN state IN ('complete', 'failed') THEN 'unrecorded' ELSE 'in_flight' END AS kind FROM s),
    a AS (SELECT k.*, CASE WHEN state IS NOT NULL THEN epoch(now) - epoch(updated_at) END AS age_s,
        CASE WHEN state IS NOT NULL THEN epoch(now) - epoch(CASE WHEN kind = 'in_flight' AND seen_at > updated_at THEN seen_at ELSE updated_at END) END AS idle_s FROM k, t WHERE kind IS NOT NULL),
    f AS (SELECT run, kind, state, age_s, idle_s, kind = 'in_flight' AND coalesce(state = 'running' AND idle_s >= 7200, false) AS stale FROM a)"""


def _status(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders")
    names = {"1-URGENT": "running", "2-HIGH": "submitted", "3-MEDIUM": "complete", "5-LOW": "failed"}
    state = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("o_orderpriority")]
    rows = o.select(F.col("o_orderkey").alias("run"), state.alias("state"), F.col("o_orderdate").alias("updated_at"), (F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_custkey") % 300).cast("int"))).alias("seen_at"), (F.col("o_orderstatus") == "F").alias("has_record"))
    now = o.agg(F.max("o_orderdate")).first()[0]
    return inflight.status(rows, F.lit(now).cast("timestamp_ntz") + F.expr("INTERVAL 3 HOURS"))


@query(f"WITH {STATES} SELECT run, kind, state, age_s, idle_s, stale FROM f")
def inflight_status(spark, sf_dir):
    """Runs that aren't simply finished, from orders as jobs."""
    return _status(spark, sf_dir).select("run", "kind", "state", "age_s", "idle_s", "stale")


@query(f"""WITH {STATES} SELECT 'in_flight' AS name, count(*) FILTER (WHERE kind = 'in_flight') AS n FROM f UNION ALL SELECT 'unrecorded', count(*) FILTER (WHERE kind = 'unrecorded') FROM f
    UNION ALL SELECT 'lagging', count(*) FILTER (WHERE kind = 'lagging') FROM f UNION ALL SELECT 'unreadable', count(*) FILTER (WHERE kind = 'unreadable') FROM f
    UNION ALL SELECT 'submitted', count(*) FILTER (WHERE kind = 'in_flight' AND state = 'submitted') FROM f UNION ALL SELECT 'running', count(*) FILTER (WHERE kind = 'in_flight' AND state = 'running') FROM f
    UNION ALL SELECT 'stale', count(*) FILTER (WHERE stale) FROM f""")
def inflight_counts(spark, sf_dir):
    return inflight.counts(_status(spark, sf_dir))


@query(f"""WITH {STATES} SELECT run, CAST(row_number() OVER (ORDER BY CASE kind WHEN 'in_flight' THEN 1 WHEN 'unrecorded' THEN 2 WHEN 'lagging' THEN 3 ELSE 4 END, NOT stale,
    CASE state WHEN 'running' THEN 1 WHEN 'submitted' THEN 2 ELSE 3 END, coalesce(age_s, 0), run) - 1 AS BIGINT) AS place FROM f QUALIFY place < 50""")
def inflight_order(spark, sf_dir):
    """The first fifty rows of the status report."""
    top = inflight.in_order(_status(spark, sf_dir)).limit(50).select("run").toPandas()["run"]  # fifty rows
    return spark.createDataFrame([(int(r), i) for i, r in enumerate(top)], "run long, place long")


@query("""WITH d AS (SELECT c_mktsegment || c_nationkey AS name, c_custkey AS place, CASE WHEN c_custkey % 7 <> 0 THEN 'set' || (c_nationkey % 3 + CAST(c_acctbal < -900 AS INTEGER)) END AS source,
        CASE WHEN c_custkey % 5 = 0 THEN 'tok' || (c_nationkey % 2) END AS tokenizer FROM customer),
    g AS (SELECT name, arg_min(source, place) AS source, arg_min(tokenizer, place) AS tokenizer, coalesce(min(source) <> max(source), false) OR coalesce(min(tokenizer) <> max(tokenizer), false) AS contested FROM d GROUP BY name),
    o AS (SELECT g.name, min(d.source) AS other FROM g JOIN d ON d.name = g.name AND d.source <> g.source GROUP BY g.name)
    SELECT g.name, CASE WHEN contested THEN 'CONTESTED: ' || coalesce(source, 'none') || ' vs ' || coalesce(other, source, 'none') ELSE source END AS source, tokenizer, contested FROM g LEFT JOIN o ON o.name = g.name""")
def corpora_upsert(spark, sf_dir):
    """Customers as declarations of corpora named by segment and nation."""
    c = P.table(spark, sf_dir, "customer")
    source = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("set"), (F.col("c_nationkey") % 3 + (F.col("c_acctbal") < -900).cast("int")).cast("string")))
    tokenizer = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("tok"), (F.col("c_nationkey") % 2).cast("string")))
    declared = c.select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), F.col("c_custkey").alias("place"), source.alias("source"), tokenizer.alias("tokenizer"))
    return corpora.upsert(declared.drop("place").limit(0), declared, ("source", "tokenizer"))


LINKS = """CASE page_id % 5 WHEN 0 THEN 'oai:arXiv.org:' || (1000 + page_id % 9000) || '.' || (10000 + page_id) || 'v2' WHEN 1 THEN url || '?doi=https://doi.org/10.1234/AB.' || page_id || '.'
    WHEN 2 THEN 'https://www.nature.com/articles/S' || page_id || '-x' WHEN 3 THEN 'https://arxiv.org/abs/hep-th/' || (1000000 + page_id) ELSE url END"""


@query(f"""WITH l AS (SELECT page_id, {LINKS} AS link FROM pages), m AS (SELECT *, nullif(regexp_extract(link, '(10\\.\\d{{4,9}}/[^\\s#?]+)', 1), '') AS d, nullif(regexp_extract(link, 'nature\\.com/articles/([A-Za-z0-9\\-]+)', 1), '') AS j FROM l)
    SELECT page_id, coalesce(rtrim(lower(d), '.'), '10.1038/' || lower(j)) AS doi, nullif(regexp_extract(link, '(?:oai:arXiv\\.org:|arxiv\\.org/abs/)([a-z\\-]+/\\d{{7}}|\\d{{4}}\\.\\d{{4,5}})', 1), '') AS arxiv FROM m""")
def link_ids(spark, sf_dir):
    """Identifiers in links that feeds write."""
    i, s = F.col("page_id"), lambda c: c.cast("string")
    link = F.when(i % 5 == 0, F.concat(F.lit("oai:arXiv.org:"), s(1000 + i % 9000), F.lit("."), s(10000 + i), F.lit("v2"))).when(i % 5 == 1, F.concat("url", F.lit("?doi=https://doi.org/10.1234/AB."), s(i), F.lit("."))).when(i % 5 == 2, F.concat(F.lit("https://www.nature.com/articles/S"), s(i), F.lit("-x"))).when(i % 5 == 3, F.concat(F.lit("https://arxiv.org/abs/hep-th/"), s(1000000 + i))).otherwise(F.col("url"))
    doi, arxiv = X.link_ids(F.lit(None).cast("string"), link)
    return P.table(spark, sf_dir, "pages").select("page_id", doi.alias("doi"), arxiv.alias("arxiv"))


@query("SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE substring(text, 1, 119) || '…' END AS shown FROM documents")
def text_clipped(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", X.clip(F.col("text"), 120).alias("shown"))


@query("SELECT doc_id, substring(text, 201, 300) AS part, CAST(length(text) AS BIGINT) AS total FROM documents")
def text_window(spark, sf_dir):
    w = X.window(F.col("text"), 200, 300)
    return P.table(spark, sf_dir, "documents").select("doc_id", w["text"].alias("part"), w["total"].cast("long").alias("total"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS published, ts FROM events), m AS (SELECT max(ts) AS newest FROM events)
    SELECT event_id FROM e, m WHERE strptime(replace(published, 'T', ' '), '%Y-%m-%d %H:%M:%S') >= date_trunc('second', newest) - INTERVAL 5 DAY""")
def recent_items(spark, sf_dir):
    """The last five days, by times that are written in two ways."""
    e = P.table(spark, sf_dir, "events")
    stamp = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    newest = e.agg(F.max("ts")).first()[0]
    since = F.date_trunc("second", F.lit(newest)).cast("timestamp_ntz") - F.expr("INTERVAL 5 DAYS")
    return e.filter(X.published_at(stamp) >= since).select("event_id")


@query("""SELECT DISTINCT pid, tag FROM (SELECT o_custkey AS pid, o_orderpriority AS tag FROM orders UNION ALL
    SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT -c_custkey, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0) u""")
def paper_tags(spark, sf_dir):
    """Tags of items and of references, which are negative unless an item stands for them."""
    c = P.table(spark, sf_dir, "customer")
    items = P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pid"), F.col("o_orderpriority").alias("tag"))
    return L.tagged_papers(items, c.select(F.col("c_custkey").alias("ref_id"), F.col("c_mktsegment").alias("tag")), c.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("ref_id"), F.col("c_custkey").alias("item_id")))


@query("SELECT user_id FROM events WHERE event_type IN ('click', 'view') UNION SELECT o_custkey FROM orders")
def users_with_signal(spark, sf_dir):
    """Users with clicks or entries."""
    clicks = P.table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view")).select("user_id")
    return clicks.union(P.table(spark, sf_dir, "orders").select("o_custkey")).distinct()


@query("""WITH e AS (SELECT p_partkey * 3 % 50 AS ref_id, CASE WHEN p_size % 2 = 0 THEN 'title' ELSE 'note' END AS field, p_brand AS value, p_partkey AS t FROM part),
    w AS (SELECT *, lag(value) OVER (PARTITION BY ref_id, field ORDER BY t, value) AS was, row_number() OVER (PARTITION BY ref_id, field ORDER BY t, value) AS n FROM e), c AS (SELECT * FROM w WHERE n = 1 OR was IS DISTINCT FROM value)
    SELECT ref_id, field, value, t AS from_at, lead(t) OVER (PARTITION BY ref_id, field ORDER BY t, value) AS to_at FROM c""")
def edit_versions(spark, sf_dir):
    p = P.table(spark, sf_dir, "part")
    return L.edit_log(p.select((F.col("p_partkey") * 3 % 50).alias("ref_id"), F.when(F.col("p_size") % 2 == 0, "title").otherwise("note").alias("field"), F.col("p_brand").alias("value"), F.col("p_partkey").alias("at")))


@query("""WITH x AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, k, list_contains([1, 5, 9], k) AS listed FROM x""")
def json_columns(spark, sf_dir):
    """A JSON column by member, and membership in a list; what can't be read is null."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return P.table(spark, sf_dir, "events").select("event_id", k.alias("k")).select("event_id", "k", F.exists(F.array(F.lit(1), F.lit(5), F.lit(9)).cast("array<bigint>"), lambda x: x == F.col("k")).alias("listed"))


@query("""WITH d AS (SELECT l_partkey AS key, l_returnflag AS field, l_shipmode AS value FROM (SELECT l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'year' ELSE 'other' END AS l_returnflag, l_linestatus || l_linenumber AS l_shipmode FROM lineitem))
    SELECT 'K' || p_partkey AS key, min(value) FILTER (WHERE field = 'title') AS title, min(value) FILTER (WHERE field = 'year') AS year FROM part LEFT JOIN d ON d.key = p_partkey WHERE p_partkey % 10 <> 0 GROUP BY p_partkey""")
def entity_pivot(spark, sf_dir):
    """A reference manager's attribute rows as one row per item."""
    parts, lines = P.table(spark, sf_dir, "part"), P.table(spark, sf_dir, "lineitem")
    items = parts.select(F.col("p_partkey").alias("itemID"), F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("key"))
    value = F.concat("l_linestatus", F.col("l_linenumber").cast("string"))
    data = lines.select(F.col("l_partkey").alias("itemID"), (F.col("l_linenumber") % 3).alias("fieldID"), value.alias("valueID"))
    fields = spark.createDataFrame([(0, "title"), (1, "year"), (2, "other")], "fieldID int, fieldName string")
    values = lines.select(value.alias("valueID"), value.alias("value")).distinct()
    return L.pivoted(items, data, fields, values, parts.filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("itemID")), ["title", "year"])
