"""Queries on registered hypotheses and on passages that bear on claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import ledger, passages, prereg
from tracewright.plans.library import _STEM, _STOP, _WORDS
from tracewright.plans.registry import query
from tracewright.sources import projections as P

# Orders register what they expect of the arms of a family; some name a replicate, an arm that isn't there or a metric that wasn't compared, and
# some changed after they were registered. What is in an order's content stands in its columns too.
HYPOTHESES = """SELECT o_orderkey AS hyp_id, 'fam' || (o_orderkey % 6) AS family, CASE WHEN o_orderkey % 8 = 0 THEN 'acc' ELSE 'loss' END AS metric,
    CASE WHEN o_orderkey % 97 = 0 THEN 'arm1 <' WHEN o_orderkey % 10 = 3 THEN 'arm' || (o_orderkey % 4) || ' < run' || (o_orderkey % 6 + 5)
        WHEN o_orderkey % 7 = 0 THEN 'arm' || (o_orderkey % 4) || ' < arm' || ((o_orderkey + 1) % 4) || ' > arm' || ((o_orderkey + 2) % 4)
        ELSE 'arm' || (o_orderkey % 4) || CASE WHEN o_orderkey % 2 = 1 THEN ' < ' ELSE ' > ' END || 'arm' || ((o_orderkey + 1 + o_orderkey % 3) % 4) END AS expect,
    CAST(o_orderkey % 5 AS DOUBLE) / 1000 AS margin, o_orderkey % 3 = 0 AS allow_single_run, o_orderdate AS registered_at FROM orders"""
CONTENT = "'{\"expect\":\"' || expect || '\",\"family\":\"' || family || '\",\"metric\":\"' || metric || '\"}'"
RUNS_OF = """values_of AS (SELECT l_suppkey AS run_id, avg(l_discount) AS v FROM lineitem GROUP BY l_suppkey),
    first_of AS (SELECT l_suppkey AS run_id, l_shipdate AS ts FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_shipdate) = 1)"""


@query(f"""WITH runs AS ({P.RUNS_SQL}), {RUNS_OF}, arms AS (SELECT family, arm AS name, round(avg(v), 9) AS value, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(min(v), 9) END AS lo, CASE WHEN count(*) >= 3 THEN round(max(v), 9) END AS hi
        FROM runs JOIN values_of USING (run_id) GROUP BY family, arm), members AS (SELECT DISTINCT family, name FROM runs JOIN values_of USING (run_id)),
    seen AS (SELECT family, arm, date_trunc('second', min(ts)) AS ts FROM runs JOIN first_of USING (run_id) GROUP BY family, arm), h AS ({HYPOTHESES}),
    tok AS (SELECT h.*, string_split(expect, ' ') AS t FROM h), good AS (SELECT * FROM tok WHERE expect <> 'arm1 <'),
    pairs AS (SELECT *, 0 AS pos, t[1] AS l, t[2] AS op, t[3] AS r FROM good UNION ALL SELECT *, 1, t[3], t[4], t[5] FROM good WHERE len(t) = 5),
    sided AS (SELECT *, CASE WHEN op = '<' THEN l ELSE r END AS low, CASE WHEN op = '<' THEN r ELSE l END AS high FROM pairs),
    found AS (SELECT s.*, a.value AS lv, a.lo AS ll, a.hi AS lh, b.value AS hv, b.lo AS hl, b.hi AS hh, CASE WHEN a.name IS NOT NULL THEN NULL WHEN m.name IS NOT NULL THEN 'a replicate, not an arm' ELSE 'no such arm' END AS lw,
        CASE WHEN b.name IS NOT NULL THEN NULL WHEN k.name IS NOT NULL THEN 'a replicate, not an arm' ELSE 'no such arm' END AS hw FROM sided s
        LEFT JOIN arms a ON a.family = s.family AND a.name = s.low AND s.metric = 'loss' LEFT JOIN arms b ON b.family = s.family AND b.name = s.high AND s.metric = 'loss'
        LEFT JOIN members m ON m.family = s.family AND m.name = s.low AND s.metric = 'loss' LEFT JOIN members k ON k.family = s.family AND k.name = s.high AND s.metric = 'loss'),
    judged AS (SELECT *, coalesce(lw, hw) AS p, ll IS NOT NULL AND hl IS NOT NULL AS spans FROM found),
    said AS (SELECT hyp_id, pos, CASE WHEN p = 'a replicate, not an arm' THEN 2 WHEN p IS NOT NULL THEN 3
            WHEN spans THEN CASE WHEN hl - lh >= margin - 1e-12 THEN 1 WHEN hh - ll < margin - 1e-12 THEN 4 ELSE 2 END
            WHEN NOT allow_single_run THEN 2 WHEN hv - lv >= margin - 1e-12 THEN 1 ELSE 4 END AS sev,
        coalesce(p, CASE WHEN spans THEN 'intervals' WHEN allow_single_run THEN 'values' ELSE 'no interval' END) AS why FROM judged),
    whole AS (SELECT hyp_id, max(sev) AS sev, string_agg(why, '; ' ORDER BY pos) AS why FROM said GROUP BY hyp_id),
    named AS (SELECT hyp_id, family, registered_at, unnest(list_concat([t[1], t[3]], CASE WHEN len(t) = 5 THEN [t[5]] ELSE [] END)) AS arm FROM good),
    early AS (SELECT hyp_id, string_agg(n.arm, ',' ORDER BY n.arm) AS before FROM named n JOIN seen s ON s.family = n.family AND s.arm = n.arm AND s.ts <= n.registered_at GROUP BY hyp_id)
    SELECT h.hyp_id, CASE sev WHEN 1 THEN 'confirmed' WHEN 2 THEN 'inconclusive' WHEN 3 THEN 'untested' WHEN 4 THEN 'refuted' END AS verdict, why, before IS NOT NULL AS post_hoc, coalesce(before, '') AS before,
        h.hyp_id % 13 = 0 AS altered FROM h LEFT JOIN whole USING (hyp_id) LEFT JOIN early USING (hyp_id)""")
def prereg_verdicts(spark, sf_dir):
    """Orders' hypotheses on the mean discounts of suppliers as runs. Intervals are the extremes of three runs or more; a run's evidence dates from its cheapest item."""
    items = P.table(spark, sf_dir, "lineitem")
    per_run = items.groupBy(F.col("l_suppkey").alias("run_id")).agg(F.avg("l_discount").alias("v"), F.min(F.struct("l_extendedprice", "l_shipdate"))["l_shipdate"].alias("at"))
    runs = P.runs(spark, sf_dir).join(per_run, "run_id")
    enough = F.count(F.lit(1)) >= 3
    arms = runs.groupBy("family", F.lit("loss").alias("metric"), F.col("arm").alias("name")).agg(
        F.round(F.avg("v"), 9).alias("value"), F.when(enough, F.round(F.min("v"), 9)).alias("ci_low"), F.when(enough, F.round(F.max("v"), 9)).alias("ci_high"), F.collect_set("name").alias("members"))
    P.table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    registered = spark.sql(HYPOTHESES).withColumn("content", F.expr(CONTENT))
    now = F.when(F.col("hyp_id") % 13 == 0, F.regexp_replace("content", '"family"', '"Family"')).otherwise(F.col("content"))
    return prereg.judge(registered.withColumns({"digest": F.sha2("content", 256), "content": now}), arms, runs.select("family", "arm", "at"))


# Turns of a conversation are claims about a text, and its lines are the passages.
CLAIMS = "claims AS (SELECT conv_id || ':' || turn AS claim_id, conv_id * 2 + turn AS source, text FROM conversations)"
HITS = f"""{CLAIMS}, lines AS (SELECT doc_id AS source, unnest(range(len(l))) AS n, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    cw AS (SELECT claim_id, source, lower({_WORDS.format(c="text")}) AS w FROM claims), pw AS (SELECT source, n, lower({_WORDS.format(c="text")}) AS w FROM lines WHERE source IN (SELECT source FROM claims)),
    c AS (SELECT DISTINCT claim_id, source, {_STEM} AS stem FROM cw WHERE w NOT IN ({_STOP})), p AS (SELECT DISTINCT source, n, {_STEM} AS stem FROM pw WHERE w NOT IN ({_STOP})),
    size AS (SELECT claim_id, count(*) AS size FROM c GROUP BY claim_id), hits AS (SELECT claim_id, c.source, n, count(*) AS shared FROM c JOIN p ON c.source = p.source AND c.stem = p.stem GROUP BY claim_id, c.source, n),
    top AS (SELECT claim_id, source, n, shared / size AS coverage, row_number() OVER (PARTITION BY claim_id ORDER BY shared / size DESC, n) AS rank FROM hits JOIN size USING (claim_id) QUALIFY rank <= 12)"""


def _claims(spark, sf_dir):
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return P.table(spark, sf_dir, "conversations").select(key.alias("claim_id"), (F.col("conv_id") * 2 + F.col("turn")).alias("source"), "text")


def _found(spark, sf_dir):
    lines = P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return passages.retrieve(_claims(spark, sf_dir), lines)


@query(f"WITH {HITS} SELECT claim_id, source, n, round(coverage, 6) AS coverage, rank FROM top")
def passage_retrieval(spark, sf_dir):
    """For each turn the twelve lines of its text that have most of its stems."""
    return _found(spark, sf_dir).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {HITS}, v AS (SELECT t.*, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS near FROM top t
        LEFT JOIN embeddings a ON a.vec_id = t.source + 1 LEFT JOIN embeddings b ON b.vec_id = t.source + t.n AND t.n < 40),
    m AS (SELECT *, count(*) OVER w > 1 AND bool_and(near IS NOT NULL) OVER w AS by_vector FROM v WINDOW w AS (PARTITION BY claim_id)),
    s AS (SELECT claim_id, source, n, coverage, CASE WHEN by_vector THEN 'vector' ELSE 'lexical' END AS mode, round(coverage + CASE WHEN by_vector THEN near ELSE 0 END, 6) AS score FROM m)
    SELECT claim_id, source, n, round(coverage, 6) AS coverage, mode, score, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, n) AS rank FROM s""")
def passage_rerank(spark, sf_dir):
    """The same lines by coverage and vectors; lines from the fortieth on have none here, so claims that found one keep the order of coverage."""
    v = P.table(spark, sf_dir, "embeddings")
    found = _found(spark, sf_dir)
    claim = _claims(spark, sf_dir).select("claim_id", (F.col("source") + 1).alias("vec_id")).join(v, "vec_id").select("claim_id", "embedding")
    wanted = found.filter("n < 40").select("source", "n").distinct().withColumn("vec_id", F.col("source") + F.col("n"))
    return passages.rerank(found, claim, wanted.join(v, "vec_id").select("source", "n", "embedding")).withColumn("coverage", F.round("coverage", 6))


@query("""WITH m AS (SELECT 'f' || (o_custkey % 20) AS family, 'c' || o_custkey AS arm, CASE WHEN o_orderkey % 211 = 0 THEN 'c' || (o_custkey + 20) ELSE 'o' || o_orderkey END AS name, o_orderkey % 501 AS seed,
        CASE WHEN o_custkey % 3 > 0 THEN 'test' WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS split, CASE WHEN o_orderkey % 9 <> 0 THEN CASE WHEN o_custkey % 2 = 0 THEN left(o_orderpriority, 1) ELSE 'x' END END AS lr,
        CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'none' ELSE 'd' END AS depth FROM orders),
    a AS (SELECT family, arm, count(*) AS n, count(DISTINCT seed) AS seeds, count(DISTINCT coalesce(split, '')) AS splits, count(DISTINCT lr) AS lrs, count(DISTINCT depth) AS depths FROM m GROUP BY family, arm),
    v AS (SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.family = a.family AND m.name = a.arm AND m.arm <> a.arm) THEN 'a run has this name' WHEN seeds < n THEN 'a seed twice' WHEN splits > 1 THEN 'different splits'
        WHEN lrs > 1 OR depths > 1 THEN 'different settings' END AS veto FROM a)
    SELECT family, arm, veto, CASE WHEN veto = 'different settings' THEN concat_ws(',', CASE WHEN depths > 1 THEN 'depth' END, CASE WHEN lrs > 1 THEN 'lr' END) ELSE '' END AS differing FROM v""")
def pooling_vetoes(spark, sf_dir):
    """Customers as arms and their orders as runs, some of which are named like another arm; every ninth has no config, and every seventeenth no depth in it."""
    key, arm = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    settings = F.create_map(F.lit("seed"), key.cast("string"), F.lit("lr"), F.when(arm % 2 == 0, F.left("o_orderpriority", F.lit(1))).otherwise("x"))
    config = F.when(key % 9 != 0, F.when(key % 17 == 0, settings).otherwise(F.map_concat(settings, F.create_map(F.lit("depth"), F.lit("d")))))
    members = P.table(spark, sf_dir, "orders").select(
        text("f", arm % 20).alias("family"), text("c", arm).alias("arm"), F.when(key % 211 == 0, text("c", arm + 20)).otherwise(text("o", key)).alias("name"), (key % 501).alias("seed"),
        F.when(arm % 3 > 0, "test").when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("split"), config.alias("config"))
    return ledger.pool_vetoes(members)
