"""Experiment ledger, replicates and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import claims as C
from tracewright.operators import ledger as L
from tracewright.plans.registry import query
from tracewright.sources import projections as P

RANK = "CASE WHEN split IS NULL THEN 7 " + " ".join(f"WHEN starts_with(lower(split), '{s}') THEN {i}" for i, s in enumerate(L.EVAL_SPLITS)) + " WHEN starts_with(lower(split), 'train') OR starts_with(lower(split), 'fit') THEN 8 ELSE 7 END"
BASE = f"runs AS ({P.RUNS_SQL}), metrics AS ({P.METRICS_SQL}), ranked AS (SELECT *, {RANK} AS trust FROM metrics)"
BEST = """best AS (SELECT run_id, step, split, value, trust FROM ranked WHERE metric = '{metric}'
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY trust, {sign}value, step, split) = 1),
    scored AS (SELECT r.*, step, split, value, trust FROM runs r JOIN best USING (run_id))"""
POOL = """pooled AS (SELECT family, arm, count(*) AS n_runs, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, min(value) AS lo,
    max(value) AS hi, count(DISTINCT split) AS n_splits, min(trust) AS trust FROM scored GROUP BY family, arm)"""


def _sql(metric: str, sign: str, rest: str) -> str:
    return f"WITH {BASE}, {BEST.format(metric=metric, sign=sign)}, {POOL}, {rest}"


def scored(spark, sf_dir, metric="loss", lower=True):
    best = L.best_steps(P.run_metrics(spark, sf_dir, (metric,)), lower)
    return P.runs(spark, sf_dir).join(best, "run_id")


COMPARE = """arms AS (SELECT *, row_number() OVER w AS rank, abs(lead(mean) OVER w - mean) AS gap, lead(n_runs) OVER w AS n2, lead(sd) OVER w AS sd2,
        count(*) OVER (PARTITION BY family) AS n_arms FROM pooled WINDOW w AS (PARTITION BY family ORDER BY {sign}mean, arm)),
    spread AS (SELECT family, count(DISTINCT trust) AS trusts FROM pooled GROUP BY family),
    judged AS (SELECT a.*, s.trusts, CASE WHEN n_runs >= 2 AND n2 >= 2 THEN sqrt(((n_runs - 1) * sd * sd + (n2 - 1) * sd2 * sd2) / (n_runs + n2 - 2)) END AS both_sd
        FROM arms a JOIN spread s USING (family))
    SELECT family, arm, rank, n_runs, round(mean, 6) AS mean, round(sd, 6) AS sd, lo, hi, round(gap, 6) AS gap,
        round(CASE WHEN both_sd > 0 THEN gap / both_sd END, 6) AS effect,
        concat_ws('; ', CASE WHEN n_arms = 1 THEN 'only one arm' END, CASE WHEN trusts > 1 THEN 'different splits' END, CASE WHEN trust > 7 THEN 'training split' END,
            CASE WHEN n_runs < 2 THEN 'single run' END, CASE WHEN gap < 0.05 * abs(mean) THEN 'within 5 percent' END) AS caveats FROM judged"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(_sql("loss", "", COMPARE.format(sign="")))
def ledger_compare(spark, sf_dir):
    return _rounded(L.rank_arms(L.pool_replicates(scored(spark, sf_dir)), lower=True), "mean", "sd", "gap", "effect")


@query(_sql("acc", "-", COMPARE.format(sign="-")))
def ledger_compare_higher(spark, sf_dir):
    return _rounded(L.rank_arms(L.pool_replicates(scored(spark, sf_dir, "acc", False)), lower=False), "mean", "sd", "gap", "effect")


@query(_sql("loss", "", "x AS (SELECT 1) SELECT family, arm, n_runs, round(mean, 6) AS mean, round(sd, 6) AS sd, lo, hi, n_splits FROM pooled"))
def replicates_pool(spark, sf_dir):
    return _rounded(L.pool_replicates(scored(spark, sf_dir)), "mean", "sd").drop("trust")


@query(f"WITH runs AS ({P.RUNS_SQL}) SELECT project, family, count(*) AS n FROM runs GROUP BY project, family")
def ledger_families(spark, sf_dir):
    return P.runs(spark, sf_dir).groupBy("project", "family").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH runs AS ({P.RUNS_SQL}) SELECT run_id, name, project, family, arm FROM runs WHERE family = 'fam1' ORDER BY project, name LIMIT 20")
def ledger_list(spark, sf_dir):
    return P.runs(spark, sf_dir).filter(F.col("family") == "fam1").orderBy("project", "name").select("run_id", "name", "project", "family", "arm").limit(20)


@query(f"WITH runs AS ({P.RUNS_SQL}) SELECT count(*) AS n, count(DISTINCT project) AS projects FROM runs WHERE family = 'fam1'")
def ledger_count(spark, sf_dir):
    return P.runs(spark, sf_dir).filter(F.col("family") == "fam1").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("project").alias("projects"))


@query(f"""WITH runs AS ({P.RUNS_SQL}), t AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY family, name) AS turn FROM runs)
    SELECT run_id, project, family, name, turn FROM t ORDER BY turn, project LIMIT 10""")
def ledger_sample_interleaved(spark, sf_dir):
    return L.interleaved(P.runs(spark, sf_dir), "project", ["family", "name"], 10).select("run_id", "project", "family", "name", "turn")


@query(f"WITH m AS ({P.METRICS_SQL}) SELECT run_id, metric, value, step, split FROM m QUALIFY row_number() OVER (PARTITION BY run_id, metric ORDER BY step DESC, split DESC) = 1")
def ledger_last_value(spark, sf_dir):
    return L.last_values(P.run_metrics(spark, sf_dir))


@query(f"WITH m AS ({P.METRICS_SQL}) SELECT metric, count(DISTINCT run_id) AS arms, count(*) AS n FROM m GROUP BY metric")
def ledger_metric_coverage(spark, sf_dir):
    return P.run_metrics(spark, sf_dir).groupBy("metric").agg(F.count_distinct("run_id").alias("arms"), F.count(F.lit(1)).alias("n"))


@query(f"WITH m AS ({P.METRICS_SQL}) SELECT metric, count(DISTINCT run_id) AS arms FROM m WHERE metric IN ('loss', 'acc') GROUP BY metric ORDER BY arms DESC, metric LIMIT 1")
def ledger_pick_metric(spark, sf_dir):
    """The directed metric that most arms report."""
    counts = P.run_metrics(spark, sf_dir).groupBy("metric").agg(F.count_distinct("run_id").alias("arms"))
    return counts.filter(L.direction_of(F.col("metric")).isNotNull()).orderBy(F.desc("arms"), "metric").limit(1)


@query("""SELECT DISTINCT metric, CASE WHEN metric LIKE '%loss%' THEN 'lower_is_better' WHEN metric LIKE '%size%' THEN NULL ELSE 'higher_is_better' END AS direction,
    regexp_replace(regexp_replace(metric, '_at_[0-9]+$', ''), '^(best_|val_)+', '') AS stem
    FROM (SELECT p || m || s AS metric FROM (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN '' WHEN 'N' THEN 'val_' ELSE 'best_val_' END AS p FROM lineitem) a,
        (VALUES ('loss'), ('acc'), ('size')) b(m), (VALUES (''), ('_at_10')) c(s)) x""")
def ledger_direction_resolve(spark, sf_dir):
    prefix = F.expr("CASE l_returnflag WHEN 'A' THEN '' WHEN 'N' THEN 'val_' ELSE 'best_val_' END")
    names = P.table(spark, sf_dir, "lineitem").select(prefix.alias("p")).distinct()
    named = names.select("p", F.explode(F.array(*[F.lit(m + s) for m in P.METRICS for s in ("", "_at_10")])).alias("m")).select(F.concat("p", "m").alias("metric"))
    return named.distinct().select("metric", L.direction_of(F.col("metric")).alias("direction"), L.metric_stem(F.col("metric")).alias("stem"))


NESTED = "CASE WHEN l_suppkey % 2 = 0 THEN 'arms.' || l_linestatus WHEN l_suppkey % 3 = 0 THEN 'test.' || l_linestatus ELSE l_linestatus END"


@query(f"""WITH g AS (SELECT l_suppkey AS run_id, 'loss' AS metric, {NESTED} AS split, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT run_id, metric, split, n FROM g WHERE starts_with(split, 'arms.') QUALIFY count(*) OVER (PARTITION BY run_id) > 1""")
def ledger_nested_arms(spark, sf_dir):
    rows = P.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.lit("loss").alias("metric"), F.expr(NESTED).alias("split"))
    return L.nested_arms(rows)


@query(_sql("loss", "", """f AS (SELECT family, count(DISTINCT split) AS n_splits, count(DISTINCT trust) AS n_trusts, min(trust) > 7 AS all_training FROM scored GROUP BY family) SELECT * FROM f"""))
def ledger_split_caveats(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("trust", L.split_rank(F.col("split")))
    return rows.groupBy("family").agg(F.count_distinct("split").alias("n_splits"), F.count_distinct("trust").alias("n_trusts"), (F.min("trust") > L.UNLABELLED).alias("all_training"))


@query(_sql("loss", "", """t AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY mean, arm) AS rank FROM pooled),
    p AS (SELECT a.family, a.arm AS top, b.arm AS second, sqrt(((a.n_runs - 1) * a.sd * a.sd + (b.n_runs - 1) * b.sd * b.sd) / (a.n_runs + b.n_runs - 2)) AS both_sd, abs(a.mean - b.mean) AS gap
        FROM t a JOIN t b ON a.family = b.family AND a.rank = 1 AND b.rank = 2 WHERE a.n_runs >= 2 AND b.n_runs >= 2)
    SELECT family, top, second, round(CASE WHEN both_sd > 0 THEN gap / both_sd END, 3) AS d FROM p"""))
def replicates_effect_size(spark, sf_dir):
    arms = L.rank_arms(L.pool_replicates(scored(spark, sf_dir)), lower=True)
    top, second = arms.filter("rank = 1 AND n_runs >= 2"), arms.filter("rank = 2 AND n_runs >= 2").select("family", F.col("arm").alias("second"))
    return top.join(second, "family").select("family", F.col("arm").alias("top"), "second", F.round("effect", 3).alias("d"))


@query(_sql("loss", "", """v AS (SELECT family, arm, CASE WHEN count(DISTINCT seed % 40) < count(*) THEN 'duplicate seeds' WHEN count(DISTINCT split) > 1 THEN 'split mismatch'
    WHEN count(DISTINCT project) > 3 THEN 'config conflict' ELSE 'pooled' END AS veto FROM scored GROUP BY family, arm) SELECT * FROM v"""))
def replicates_veto(spark, sf_dir):
    """Why the runs of an arm must not be pooled, seeds being taken modulo 40 and the project as configuration."""
    g = scored(spark, sf_dir).groupBy("family", "arm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("seed") % 40).alias("seeds"), F.count_distinct("split").alias("splits"), F.count_distinct("project").alias("configs"))
    veto = F.when(F.col("seeds") < F.col("n"), "duplicate seeds").when(F.col("splits") > 1, "split mismatch").when(F.col("configs") > 3, "config conflict").otherwise("pooled")
    return g.select("family", "arm", veto.alias("veto"))


@query()
def replicates_bootstrap_ci(spark, sf_dir):
    return _rounded(L.bootstrap_arms(scored(spark, sf_dir)), "ci_low", "ci_high")


@query(f"""WITH runs AS ({P.RUNS_SQL}), w AS (SELECT l_suppkey AS run_id, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS wall, max(l_quantity) AS runtime FROM lineitem GROUP BY l_suppkey),
    a AS (SELECT family, arm, CASE WHEN count(coalesce(wall, runtime)) = count(*) THEN sum(coalesce(wall, runtime)) END AS wall_s FROM runs LEFT JOIN w USING (run_id) GROUP BY family, arm),
    r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY arm) AS k FROM a)
    SELECT x.family, x.wall_s, y.wall_s AS other_s, round(greatest(x.wall_s, y.wall_s) / nullif(least(x.wall_s, y.wall_s), 0), 6) AS ratio FROM r x JOIN r y ON x.family = y.family AND x.k = 1 AND y.k = 2""")
def wall_time_ratio(spark, sf_dir):
    """How unequal the compute of a family's first two arms was; an arm has a time only if all its runs have."""
    own = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run_id")).agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("wall"), F.max("l_quantity").alias("runtime"))
    time = F.coalesce("wall", "runtime")
    arms = P.runs(spark, sf_dir).join(own, "run_id", "left").groupBy("family", "arm").agg(F.when(F.count(time) == F.count(F.lit(1)), F.sum(time)).alias("wall_s"))
    first = arms.groupBy("family").agg(F.slice(F.array_sort(F.collect_list(F.struct("arm", "wall_s"))), 1, 2).alias("two")).filter(F.size("two") == 2)
    a, b = F.col("two")[0]["wall_s"], F.col("two")[1]["wall_s"]
    return first.select("family", a.alias("wall_s"), b.alias("other_s"), F.round(F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0.0)), 6).alias("ratio"))


@query(f"""WITH runs AS ({P.RUNS_SQL}), c AS (SELECT l_suppkey AS run_id, min(p_brand) AS corpus FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 AND l_suppkey % 11 <> 0 GROUP BY l_suppkey),
    g AS (SELECT family, count(DISTINCT corpus) AS n_corpora, count(*) FILTER (WHERE corpus IS NULL) AS unknown, count(*) AS n FROM runs LEFT JOIN c USING (run_id) GROUP BY family)
    SELECT *, CASE WHEN unknown = n THEN 'unknown' WHEN n_corpora > 1 THEN 'differing' WHEN unknown > 0 THEN 'partial' ELSE 'shared' END AS agreement FROM g""")
def corpus_agreement(spark, sf_dir):
    lines = P.table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 AND l_suppkey % 11 <> 0").select("l_suppkey", "l_partkey")
    corpus = lines.join(P.table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("run_id")).agg(F.min("p_brand").alias("corpus"))
    return C.corpus_agreement(P.runs(spark, sf_dir).join(corpus, "run_id", "left"))


@query(P.METRICS_SQL)
def first_write_wins(spark, sf_dir):
    return P.run_metrics(spark, sf_dir)


@query("SELECT l_suppkey AS run_id, count(*) AS n, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS sd FROM lineitem GROUP BY l_suppkey")
def eval_dump_aggregate(spark, sf_dir):
    """A dump of values per item becomes mean, population sd and count."""
    return P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.stddev_pop("l_discount"), 6).alias("sd"))


PREREG = """pairs AS (SELECT a.family, a.arm AS low, b.arm AS high, a.mean - 2 * a.sd AS a0, a.mean + 2 * a.sd AS a1, b.mean - 2 * b.sd AS b0, b.mean + 2 * b.sd AS b1, a.n_runs < 3 OR b.n_runs < 3 AS bare
        FROM pooled a JOIN pooled b ON a.family = b.family AND a.arm = 'arm0' AND b.arm = 'arm1')
    SELECT family, low, high, CASE WHEN bare THEN 'inconclusive' WHEN b0 - a1 >= 0.01 - 1e-9 THEN 'confirmed' WHEN b1 - a0 < 0.01 - 1e-9 THEN 'refuted' ELSE 'inconclusive' END AS verdict FROM pairs"""


@query(_sql("size", "", PREREG))
def prereg_verdict(spark, sf_dir):
    """Whether arm0 is below arm1 by 0.01, judged by intervals of two sd around the pooled means."""
    return C.judge_pairs(L.pool_replicates(scored(spark, sf_dir, "size", True)), "arm0", "arm1", 0.01)


CLAIMS = f"""runs AS ({P.RUNS_SQL}), metrics AS ({P.METRICS_SQL}),
    claims AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 13 = 0 THEN 'run99999' WHEN o_orderkey % 17 = 0 THEN 'run1*' ELSE 'run' || (o_custkey % 100) END AS run,
        CASE WHEN o_orderkey % 19 = 0 THEN 'missing' ELSE 'loss' END AS metric, CAST(0.01 * (o_orderkey % 11) AS DOUBLE) AS value, 0.005 AS tol,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'test' END AS split, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1 + o_orderkey % 4 END AS step,
        o_orderkey % 23 = 0 AS evidence_moved FROM orders),
    found AS (SELECT claim_id, count(*) AS n_runs, min(run_id) AS run_id FROM claims c JOIN runs r
        ON CASE WHEN ends_with(c.run, '*') THEN starts_with(r.name, left(c.run, length(c.run) - 1)) ELSE r.name = c.run END GROUP BY claim_id),
    hits AS (SELECT c.claim_id, count(*) AS n_rows, min(m.value) AS actual FROM claims c JOIN found f ON f.claim_id = c.claim_id AND f.n_runs = 1
        JOIN metrics m ON m.run_id = f.run_id AND m.metric = c.metric AND (c.split IS NULL OR m.split = c.split) AND (c.step IS NULL OR m.step = c.step) GROUP BY c.claim_id),
    verdicts AS (SELECT c.claim_id, CASE WHEN f.n_runs IS NULL THEN 'unsupported' WHEN f.n_runs > 1 THEN 'ambiguous' WHEN h.n_rows IS NULL THEN 'unsupported'
        WHEN h.n_rows > 1 THEN 'ambiguous' WHEN abs(h.actual - c.value) > c.tol THEN 'contradicted' WHEN c.evidence_moved THEN 'stale' ELSE 'supported' END AS verdict,
        CASE WHEN h.n_rows = 1 THEN h.actual END AS actual FROM claims c LEFT JOIN found f ON f.claim_id = c.claim_id LEFT JOIN hits h ON h.claim_id = c.claim_id)"""


def _claims(spark, sf_dir):
    key = F.col("o_orderkey")
    return P.table(spark, sf_dir, "orders").select(
        key.alias("claim_id"), F.when(key % 13 == 0, "run99999").when(key % 17 == 0, "run1*").otherwise(F.concat(F.lit("run"), F.col("o_custkey") % 100)).alias("run"),
        F.when(key % 19 == 0, "missing").otherwise("loss").alias("metric"), (F.lit(0.01) * (key % 11)).alias("value"), F.lit(0.005).alias("tol"),
        F.when(key % 5 != 0, "test").alias("split"), F.when(key % 7 != 0, 1 + key % 4).alias("step"), (key % 23 == 0).alias("evidence_moved"))


@query(f"WITH {CLAIMS} SELECT * FROM verdicts")
def claims_verdict(spark, sf_dir):
    return C.verdicts(_claims(spark, sf_dir), P.runs(spark, sf_dir), P.run_metrics(spark, sf_dir, ("loss",)))


@query(f"WITH {CLAIMS} SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict")
def claims_tally(spark, sf_dir):
    return claims_verdict(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CLAIMS} SELECT claim_id, n_runs FROM found WHERE claim_id % 17 = 0 AND claim_id % 13 <> 0")
def claims_wildcard(spark, sf_dir):
    own = _claims(spark, sf_dir).filter(F.col("run").endswith("*"))
    return C.matching_runs(own, P.runs(spark, sf_dir)).select("claim_id", "n_runs")


@query(r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, 'https?://\S*', ' ', 'g'), '-?\d+\.\d+')) AS number FROM documents),
    v AS (SELECT doc_id, CAST(number AS DOUBLE) AS value FROM n), t AS (SELECT CAST(0.1 * range AS DOUBLE) AS claimed, 0.02 AS tol FROM range(0, 500))
    SELECT doc_id, count(*) AS numbers, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM t WHERE abs(v.value - t.claimed) <= greatest(t.tol, 1e-9))) AS uncovered FROM v GROUP BY doc_id""")
def claims_coverage(spark, sf_dir):
    """Numbers of each text that no claim covers within its tolerance."""
    masked = F.regexp_replace("text", r"https?://[^\t\n\f\r ]*", " ")
    numbers = P.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(masked, F.lit(r"(-?\d+\.\d+)"), 1)).alias("number")).select("doc_id", F.col("number").cast("double").alias("value"))
    claimed = spark.range(500).select((F.col("id").cast("double") / 10).alias("claimed"), F.lit(0.02).alias("tol"))
    return C.uncovered(numbers, claimed)


@query("""SELECT doc_id AS claim_id, 'supp:' || (doc_id % 150) AS cite FROM documents WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = doc_id % 150)""")
def citation_lint(spark, sf_dir):
    """Cited keys that the bibliography lacks."""
    cited = P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.concat(F.lit("supp:"), F.col("doc_id") % 150).alias("cite"))
    known = P.table(spark, sf_dir, "supplier").select(F.concat(F.lit("supp:"), F.col("s_suppkey")).alias("cite"))
    return cited.join(known, "cite", "left_anti").select("claim_id", "cite")
