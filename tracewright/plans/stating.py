"""Queries on what sources and payloads state about corpora, on manifests of results before they are written, and on citations in both directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.operators import citations
from tracewright.plans.library import REFS, refs
from tracewright.plans.registry import query
from tracewright.sources import corpora, recording
from tracewright.sources import projections as P

# A payload and a source for each document, of its columns; both engines read these expressions.
PAYLOAD = """'{"run":' || doc_id || CASE doc_id % 5 WHEN 0 THEN ',"dataset":"' || source || '"' WHEN 1 THEN ',"Corpus":" ' || source || ' "' WHEN 2 THEN ',"dataset":7,"corpus":"c"'
        WHEN 3 THEN ',"hf_dataset":"' || source || '","corpus":"  "' ELSE '' END || CASE doc_id % 3 WHEN 0 THEN ',"subset":"' || lang || '"' WHEN 1 THEN ',"ENCODING":"' || lang || '"' ELSE '' END
    || CASE doc_id % 4 WHEN 0 THEN ',"vocab_size":' || n_chars WHEN 1 THEN ',"vocab_size":true,"n_vocab":' || n_chars || '.75' WHEN 2 THEN ',"n_vocab":"many","block_size":-3' ELSE '' END
    || CASE WHEN doc_id % 11 = 0 THEN '' ELSE '}' END"""
CODE = """'ds = load_dataset(' || CASE doc_id % 4 WHEN 0 THEN '"' || source || '", "' || lang || '"' WHEN 1 THEN '"' || source || '"' WHEN 2 THEN 'name, "' || lang || '"' ELSE 'name' END || ')' || chr(10)
    || CASE doc_id % 3 WHEN 0 THEN 'tok = t.get_encoding("' || lang || '")' WHEN 1 THEN 'tok = get_encoding(lang)' ELSE 'load_dataset("late", "later")' END || chr(10)
    || CASE doc_id % 5 WHEN 0 THEN 'fit(ds, seq_len=' || n_chars || ')' WHEN 1 THEN 'fit(ds, block_size=True, seq_len=n)' ELSE 'pass' END || CASE WHEN doc_id % 13 = 0 THEN chr(10) || 'def (' ELSE '' END"""
KEYS = ", ".join(f"('{field}', {pos}, '{key}')" for field, keys in corpora.PAYLOAD_KEYS.items() for pos, key in enumerate(keys))


@query(f"""WITH p AS (SELECT doc_id, {PAYLOAD} AS p FROM documents), k AS (SELECT doc_id, p, unnest(json_keys(p)) AS k FROM p WHERE json_valid(p)),
    v AS (SELECT doc_id, lower(k) AS key, json_extract(p, '$.' || k) AS v FROM k), f(field, pos, key) AS (VALUES {KEYS}),
    h AS (SELECT doc_id, field, pos, v, json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS is_number FROM v JOIN f USING (key)),
    t AS (SELECT doc_id, field, arg_min(v, pos) AS v FROM h WHERE field NOT IN ('vocab_size', 'seq_len') GROUP BY doc_id, field),
    s AS (SELECT doc_id, field, CASE WHEN json_type(v) = 'VARCHAR' THEN nullif(trim(json_extract_string(v, '$')), '') END AS v FROM t),
    n AS (SELECT doc_id, field, CAST(trunc(CAST(arg_min(v, pos) AS DOUBLE)) AS BIGINT) AS v FROM h WHERE field IN ('vocab_size', 'seq_len') AND is_number GROUP BY doc_id, field),
    ids AS (SELECT DISTINCT doc_id FROM h), w AS (SELECT doc_id, max(v) FILTER (WHERE field = 'name') AS name, max(v) FILTER (WHERE field = 'source') AS source, max(v) FILTER (WHERE field = 'config') AS config,
        max(v) FILTER (WHERE field = 'tokenizer') AS tokenizer FROM s GROUP BY doc_id), x AS (SELECT doc_id, max(v) FILTER (WHERE field = 'vocab_size') AS vocab_size, max(v) FILTER (WHERE field = 'seq_len') AS seq_len FROM n GROUP BY doc_id)
    SELECT doc_id, coalesce(name, source, config) AS name, source, config, tokenizer, vocab_size, seq_len FROM ids LEFT JOIN w USING (doc_id) LEFT JOIN x USING (doc_id) WHERE coalesce(name, source, config) IS NOT NULL""")
def corpora_in_payload(spark, sf_dir):
    """What a payload of each document states; one in eleven isn't JSON."""
    payloads = P.table(spark, sf_dir, "documents").select("doc_id", F.expr(PAYLOAD).alias("payload"))
    return payloads.select("doc_id", corpora.in_payload(F.col("payload")).alias("c")).filter("c IS NOT NULL").select("doc_id", "c.*")


@query(f"""WITH c AS (SELECT doc_id, {CODE} AS code FROM documents), s AS (SELECT doc_id, code LIKE '%def (%' AS broken, nullif(regexp_extract(code, 'load_dataset\\("([^"]*)"', 1), '') AS source,
        nullif(regexp_extract(code, 'load_dataset\\([^,()]*, "([^"]*)"\\)', 1), '') AS config, nullif(regexp_extract(code, 'get_encoding\\("([^"]*)"\\)', 1), '') AS tokenizer,
        CAST(nullif(regexp_extract(code, '(?:seq_len|block_size)=(\\d+)', 1), '') AS BIGINT) AS seq_len FROM c)
    SELECT doc_id, broken, CASE WHEN NOT broken THEN source END AS source, CASE WHEN NOT broken THEN config END AS config, CASE WHEN NOT broken THEN tokenizer END AS tokenizer, CASE WHEN NOT broken THEN seq_len END AS seq_len
    FROM s WHERE broken OR coalesce(source, config, tokenizer, CAST(seq_len AS VARCHAR)) IS NOT NULL""")
def corpora_in_source(spark, sf_dir):
    """What a source of each document states in its calls; one in thirteen doesn't parse."""
    sources = P.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.expr(CODE).alias("text"))
    return corpora.in_source(sources).select(F.col("path").cast("long").alias("doc_id"), F.col("problem").isNotNull().alias("broken"), "source", "config", "tokenizer", "seq_len")


def _rounded(x: Column, places: int) -> Column:
    """SQL's round of doubles: the scaled double itself is rounded, halves away from zero; F.round rounds how the double is spelled."""
    scaled = F.abs(x) * float(10**places)
    whole = F.rint(scaled)
    return F.signum(x) * F.when(scaled - whole == 0.5, whole + 1).otherwise(whole) / float(10**places)


@query("""WITH a AS (SELECT 'fam' || (l_suppkey % 6) AS family, 'arm' || l_suppkey AS arm, l_suppkey AS k, round(avg(l_discount), 3) AS acc, round(avg(l_quantity), 3) AS loss FROM lineitem GROUP BY l_suppkey),
    r AS (SELECT family, arm, k, 'results/' || family || '_' || arm || '.json' AS path, '{' || chr(10) || '  "acc": ' || CAST(acc AS VARCHAR) || ',' || chr(10) || '  "loss": ' || CAST(loss AS VARCHAR) || chr(10) || '}' || chr(10) AS content FROM a
        UNION ALL SELECT family, arm, k, 'configs/' || family || '_' || arm || '.yaml', 'family: ' || family || chr(10) || 'arm: ' || arm || chr(10) || CASE WHEN family <> 'fam0' THEN 'corpus: c' || right(family, 1) || chr(10) ELSE '' END
            || 'recorded_at: 2031-01-01T00:00:00Z' || chr(10) FROM a)
    SELECT path, sha256(content) AS sha256, CASE WHEN k % 5 = 0 THEN 'unchanged' WHEN k % 5 = 1 AND path LIKE 'results/%' THEN 'conflict' ELSE 'new' END AS action FROM r""")
def record_plan(spark, sf_dir):
    """Files that recording suppliers as arms would leave, against a folder that holds every fifth supplier's, and other results of the ones after them."""
    items = P.table(spark, sf_dir, "lineitem")
    family, arm = F.concat(F.lit("fam"), (F.col("l_suppkey") % 6).cast("string")), F.concat(F.lit("arm"), F.col("l_suppkey").cast("string"))
    means = items.groupBy("l_suppkey").agg(_rounded(F.avg("l_discount"), 3).alias("acc"), _rounded(F.avg("l_quantity"), 3).alias("loss"))
    values = means.select(family.alias("family"), arm.alias("arm"), F.explode(F.create_map(F.lit("loss"), "loss", F.lit("acc"), "acc")).alias("metric", "value"))
    families = values.select("family", F.when(F.col("family") != "fam0", F.concat(F.lit("c"), F.right("family", F.lit(1)))).alias("corpus")).distinct()
    files = recording.files(values, families, "2031-01-01T00:00:00Z")
    place = F.regexp_extract("path", r"arm(\d+)\.", 1).cast("long") % 5
    changed = (place == 1) & F.col("path").startswith("results/")
    stored = files.filter((place == 0) | changed).select("path", F.when(changed, F.sha2("path", 256)).otherwise(F.sha2("content", 256)).alias("sha256"))
    return recording.actions(files, stored).select("path", "sha256", "action")


# Each row is cited by the two before it, under a name that its residue chooses; every fifth row cites a paper that nobody has, and every ninth a title.
EDGES = """SELECT ref_id - 1 AS citing_id, CASE ref_id % 4 WHEN 0 THEN identity WHEN 1 THEN 'arxiv:' || arxiv WHEN 2 THEN 'doi:' || doi ELSE 'title:' || title_key || ':' || coalesce(CAST(year AS VARCHAR(9)), '-') END AS cited_identity, 'as cited' AS cited_title FROM refs
    UNION ALL SELECT ref_id - 2, 'title:' || title_key || ':2003', 'by title' FROM refs WHERE ref_id % 9 = 0 UNION ALL SELECT ref_id, 'doi:10.9/' || (ref_id % 50), 'Stub ' || (ref_id % 50) FROM refs WHERE ref_id % 5 = 0
    UNION ALL SELECT ref_id, 'old:' || (ref_id % 30), 'merged' FROM refs WHERE ref_id % 6 = 0"""


@query(f"""WITH {REFS}, e0 AS ({EDGES}), own AS (SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY identity ORDER BY ref_id) = 1), alias AS (SELECT 'old:' || (ref_id % 20) AS alias, min(ref_id) AS ref_id FROM own WHERE ref_id % 20 < 10 GROUP BY 1),
    e AS (SELECT citing_id, cited_identity, min(cited_title) AS cited_title FROM e0 WHERE cited_identity IS NOT NULL AND citing_id IN (SELECT ref_id FROM own) GROUP BY citing_id, cited_identity), asked AS (SELECT DISTINCT cited_identity AS c FROM e),
    hit AS (SELECT c, 0 AS rung, 0 AS ny, ref_id FROM asked JOIN own ON c = identity UNION ALL SELECT c, 1, 0, ref_id FROM asked JOIN own ON c = 'doi:' || doi UNION ALL SELECT c, 2, 0, ref_id FROM asked JOIN own ON c = 'arxiv:' || arxiv
        UNION ALL SELECT c, 3, CAST(o.year IS NULL AS INT), ref_id FROM (SELECT c, regexp_extract(c, '^title:(.*):[^:]*$', 1, 's') AS k, TRY_CAST(regexp_extract(c, ':([0-9]+)$', 1) AS INT) AS y FROM asked WHERE starts_with(c, 'title:')) t
            JOIN own o ON k <> '' AND k = title_key AND (o.year IS NULL OR y IS NULL OR o.year = y)
        UNION ALL SELECT c, 4, 0, ref_id FROM asked JOIN alias ON c = alias),
    best AS (SELECT c, ref_id AS other_id FROM hit QUALIFY row_number() OVER (PARTITION BY c ORDER BY rung, ny, ref_id) = 1),
    n AS (SELECT citing_id AS ref_id, 'cites' AS direction, cited_identity AS identity, CASE WHEN other_id IS NOT NULL THEN o.title ELSE cited_title END AS title, other_id IS NOT NULL AS in_library, other_id FROM e LEFT JOIN best ON c = cited_identity LEFT JOIN own o ON o.ref_id = other_id
        UNION ALL SELECT DISTINCT t.ref_id, 'cited_by', f.identity, f.title, true, f.ref_id FROM e JOIN own t ON cited_identity IN (t.identity, 'doi:' || t.doi, 'arxiv:' || t.arxiv) JOIN own f ON f.ref_id = citing_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY ref_id, direction ORDER BY NOT in_library, starts_with(identity, 'title:'), lower(coalesce(title, '')), identity, other_id) AS place, count(*) OVER (PARTITION BY ref_id, direction) AS total FROM n)
    SELECT ref_id, direction, place, identity, title, in_library, other_id, total FROM r WHERE place <= {citations.MOST}""")
def citation_neighbours(spark, sf_dir):
    """Both directions for the first row of each identity, some of which other names point at."""
    rows = refs(spark, sf_dir)
    rows.createOrReplaceTempView("refs")
    own = rows.join(rows.groupBy("identity").agg(F.min("ref_id").alias("ref_id")).select("ref_id"), "ref_id", "left_semi")
    aliases = own.filter("ref_id % 20 < 10").groupBy(F.concat(F.lit("old:"), (F.col("ref_id") % 20).cast("string")).alias("alias")).agg(F.min("ref_id").alias("ref_id"))
    return citations.neighbours(own, spark.sql(EDGES), aliases)
