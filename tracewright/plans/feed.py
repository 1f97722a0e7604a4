"""The reading feed and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.vectors import dot, truncate_normalise
from tracewright.operators import feed as O
from tracewright.operators import ranking
from tracewright.plans.registry import query
from tracewright.sources import projections as P

C, I = f"clicks AS ({P.CLICKS_SQL})", f"items AS ({P.ITEMS_SQL})"
KEYS = "keys AS (SELECT item_id, 'feed:' || feed AS key FROM items UNION ALL SELECT item_id, 'type:' || content_type FROM items)"
STATS = "stats AS (SELECT user_id, key, sum(useful) AS useful, sum(1 - useful) AS other FROM clicks JOIN keys USING (item_id) GROUP BY user_id, key)"
VEC = "vec AS (SELECT vec_id AS item_id, embedding FROM embeddings)"
DOT = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _keys(spark, sf_dir):
    i = P.items(spark, sf_dir)
    return i.select("item_id", F.concat(F.lit("feed:"), "feed").alias("key")).unionAll(i.select("item_id", F.concat(F.lit("type:"), "content_type").alias("key")))


def _vectors(spark, sf_dir):
    return P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


@query(f"WITH {C}, {I} SELECT item_id, feed FROM items WHERE published >= DATE '2024-06-01' AND item_id NOT IN (SELECT item_id FROM clicks WHERE user_id = 1)")
def feed_candidates(spark, sf_dir):
    return O.candidates(P.items(spark, sf_dir), P.clicks(spark, sf_dir).filter("user_id = 1").select("item_id"), F.lit("2024-06-01").cast("date")).select("item_id", "feed")


ENGAGED = "engaged AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events WHERE event_type = 'view' UNION SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events WHERE event_type = 'signup')"
JUDGED = "judged AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events WHERE event_type IN ('click', 'error'))"


@query(f"WITH {ENGAGED}, {JUDGED} SELECT user_id, item_id FROM engaged EXCEPT SELECT user_id, item_id FROM judged")
def feed_unrated_harvest(spark, sf_dir):
    e = P.table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), "event_type")
    engaged = e.filter("event_type = 'view'").union(e.filter("event_type = 'signup'"))
    return O.unrated(engaged, e.filter("event_type IN ('click', 'error')"))


@query(f"WITH {C}, {I}, {KEYS}, {STATS} SELECT * FROM stats")
def feed_key_stats(spark, sf_dir):
    return O.key_stats(P.clicks(spark, sf_dir), _keys(spark, sf_dir))


@query(f"""WITH {C}, {I}, {KEYS}, {STATS} SELECT k.item_id, round(avg(coalesce((useful + 1) / (useful + other + 2), 0.5)), 9) AS pref
    FROM keys k LEFT JOIN stats s ON s.key = k.key AND s.user_id = 1 GROUP BY k.item_id""")
def feed_pref_scores(spark, sf_dir):
    stats = feed_key_stats(spark, sf_dir).filter("user_id = 1")
    return O.item_preferences(_keys(spark, sf_dir), stats).withColumn("pref", F.round("pref", 9))


@query(f"""WITH {C}, {I}, {KEYS}, {STATS}, p AS (SELECT *, (useful + 1) / (useful + other + 2) AS pref FROM stats), r AS (
    SELECT user_id, 'top' AS side, row_number() OVER (PARTITION BY user_id ORDER BY pref DESC, key) AS place, key, pref FROM p WHERE pref > 0.5 UNION ALL
    SELECT user_id, 'bottom', row_number() OVER (PARTITION BY user_id ORDER BY pref, key), key, pref FROM p WHERE pref < 0.5) SELECT * REPLACE (round(pref, 9) AS pref) FROM r WHERE place <= 5""")
def feed_top_bottom_keys(spark, sf_dir):
    return O.top_and_bottom(feed_key_stats(spark, sf_dir), 5).withColumn("pref", F.round("pref", 9))


@query(f"""WITH {C}, g AS (SELECT user_id, count(*) AS clicks, sum(useful) AS useful, sum(1 - useful) AS not_useful, count(*) FILTER (WHERE source IN ('ui', 'agent')) AS "real" FROM clicks GROUP BY user_id)
    SELECT *, useful > 0 AND not_useful > 0 AS classifier_active, round(clicks / (clicks + 5), 9) AS blend_weight, round("real" / ("real" + 5), 9) AS real_weight,
    CASE WHEN useful = 0 OR not_useful = 0 THEN 'classifier off' WHEN clicks < 20 THEN 'weakly trained' WHEN least(useful, not_useful) < 5 THEN 'one-sided' ELSE '' END AS caveat FROM g""")
def feed_quality(spark, sf_dir):
    return O.quality(P.clicks(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("blend_weight", "real_weight")})


@query(f"WITH {I} SELECT item_id, feed, row_number() OVER (PARTITION BY feed ORDER BY published DESC, item_id) AS turn FROM items QUALIFY turn <= 3")
def feed_round_robin(spark, sf_dir):
    return O.round_robin(P.items(spark, sf_dir), 3)


@query("SELECT doc_id AS item_id, rank() OVER (ORDER BY n_chars DESC) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 - 1 AS avg_rank FROM documents")
def feed_avg_ranks(spark, sf_dir):
    return ranking.average_ranks(P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("n_chars").cast("double").alias("n")), "n").select("item_id", "avg_rank")


@query("SELECT doc_id AS item_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents")
def feed_ranks(spark, sf_dir):
    return ranking.positions(P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("n_chars").cast("double").alias("n")), "n", "item_id").select("item_id", "rank")


PROFILE = f"""liked AS (SELECT DISTINCT item_id FROM clicks WHERE user_id = 1 AND useful = 1),
    parts AS (SELECT unnest(range(1, len(embedding) + 1)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM vec WHERE item_id IN (SELECT item_id FROM liked)),
    prof AS (SELECT list(m ORDER BY i) AS pv FROM (SELECT i, avg(x) AS m FROM parts GROUP BY i)),
    psim AS (SELECT item_id, round({DOT.format(a='embedding', b='pv')}, 9) AS profile_similarity FROM vec, prof)"""


@query(f"""WITH {C}, {I}, {KEYS}, {STATS}, {VEC}, {PROFILE},
    prefs AS (SELECT k.item_id, round(avg(coalesce((useful + 1) / (useful + other + 2), 0.5)), 9) AS pref FROM keys k LEFT JOIN stats s ON s.key = k.key AND s.user_id = 1 GROUP BY k.item_id),
    n AS (SELECT count(*) / (count(*) + 5) AS w FROM clicks WHERE user_id = 1),
    s AS (SELECT item_id, profile_similarity AS similarity, coalesce(pref, 0.5) AS pref FROM psim LEFT JOIN prefs USING (item_id)),
    r AS (SELECT item_id, similarity, row_number() OVER (ORDER BY similarity DESC, item_id) - 1 AS a, rank() OVER (ORDER BY pref DESC) + (count(*) OVER (PARTITION BY pref) - 1) / 2 - 1 AS b FROM s)
    SELECT item_id, round(similarity, 6) AS similarity, round(w * b + (1 - w) * a, 6) AS final FROM r, n""")
def feed_rank_blend(spark, sf_dir):
    own = P.clicks(spark, sf_dir).filter("user_id = 1")
    vectors = _vectors(spark, sf_dir)
    out = O.blend(vectors, O.profile(vectors, own), feed_pref_scores(spark, sf_dir), own.count())
    return out.withColumns({c: F.round(c, 6) for c in ("similarity", "final")})


@query(f"WITH {I} SELECT item_id FROM items WHERE contains(lower(title), 'the') OR contains(lower(summary), 'the') ORDER BY published DESC, item_id DESC LIMIT 50")
def feed_literal_candidates(spark, sf_dir):
    return O.literal(P.items(spark, sf_dir), "the", 50)


TAGS = """tags AS (SELECT DISTINCT doc_id AS item_id, unnest(string_split(lower(text), ' ')) AS tag FROM documents),
    tagged AS (SELECT * FROM tags WHERE length(tag) >= 5), uses AS (SELECT lang AS label, tag, count(*) AS n FROM tagged JOIN documents ON doc_id = item_id GROUP BY lang, tag),
    members AS (SELECT label, tag FROM uses WHERE n >= 3),
    overlap AS (SELECT item_id, label, count(*) AS overlap FROM tagged JOIN members USING (tag) GROUP BY item_id, label),
    best AS (SELECT item_id, label, overlap FROM overlap QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, label) = 1)"""


def _tags(spark, sf_dir):
    """The distinct words of five or more characters of whole texts."""
    d = P.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"), "lang", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("tag")).filter(F.length("tag") >= 5)


def _clusters(tags):
    members = tags.groupBy(F.col("lang").alias("label"), "tag").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("label", "tag")
    return O.best_clusters(tags.select("item_id", "tag"), members)


@query(f"WITH {TAGS} SELECT t.item_id, label, coalesce(overlap, 0) AS overlap FROM (SELECT DISTINCT item_id FROM tagged) t LEFT JOIN best USING (item_id)")
def feed_digest_clusters(spark, sf_dir):
    return _clusters(_tags(spark, sf_dir))


BUDGET = """sizes AS (SELECT tag AS label, count(*) AS n FROM tagged GROUP BY tag),
    s AS (SELECT label, n, least(n, 3, 16 - coalesce(sum(least(n, 3)) OVER (ORDER BY n DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS shown FROM sizes)
    SELECT label, n, CAST(shown AS BIGINT) AS shown FROM s WHERE shown > 0"""


def _budget(tags):
    return O.digest_budget(tags.groupBy(F.col("tag").alias("label")).agg(F.count(F.lit(1)).alias("n")), 3, 16)


@query(f"WITH {TAGS}, {BUDGET}")
def feed_digest_budget(spark, sf_dir):
    return _budget(_tags(spark, sf_dir))


@query(f"""WITH {C} SELECT c_custkey AS user_id, count(user_id) AS total, count(*) FILTER (WHERE useful = 1) AS positives,
    count(DISTINCT useful) > 1 AS trainable FROM customer LEFT JOIN clicks ON user_id = c_custkey GROUP BY c_custkey""")
def persona_survey(spark, sf_dir):
    users = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    per = P.clicks(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.sum("useful").alias("positives"), (F.count_distinct("useful") > 1).alias("trainable"))
    return users.join(per, "user_id", "left").select("user_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce("trainable", F.lit(False)).alias("trainable"))


@query(f"""WITH {C}, w AS (SELECT DISTINCT user_id, item_id AS word FROM clicks WHERE useful = 1), n AS (SELECT user_id, count(*) AS n FROM w GROUP BY user_id),
    b AS (SELECT a.user_id, b.user_id AS other, count(*) AS shared FROM w a JOIN w b ON a.word = b.word AND a.user_id <> b.user_id GROUP BY a.user_id, b.user_id),
    s AS (SELECT b.user_id, other, shared / (x.n + y.n - shared) AS similarity FROM b JOIN n x ON x.user_id = b.user_id JOIN n y ON y.user_id = other)
    SELECT user_id, other, round(similarity, 9) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, other) = 1""")
def persona_jaccard(spark, sf_dir):
    words = P.clicks(spark, sf_dir).filter("useful = 1").select("user_id", F.col("item_id").alias("word"))
    return O.jaccard_nearest(words).withColumn("similarity", F.round("similarity", 9))


@query(f"WITH c AS ({P.RAW_CLICKS_SQL}) SELECT user_id, count(*) AS days FROM (SELECT user_id, CAST(ts AS DATE) AS d FROM c GROUP BY ALL HAVING count(*) >= 2 AND sum(useful) = sum(1 - useful)) x GROUP BY user_id")
def seeded_click_detector(spark, sf_dir):
    """Days on which a user's verdicts split evenly, as generated ones do."""
    g = P.raw_clicks(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum("useful").alias("u"))
    return g.filter("n >= 2 AND u = n - u").groupBy("user_id").agg(F.count(F.lit(1)).alias("days"))


@query(f"""WITH {C}, {I}, g AS (SELECT user_id, feed, count(*) AS n FROM clicks JOIN items USING (item_id) WHERE useful = 1 AND clicks.source <> 'bootstrap' GROUP BY user_id, feed)
    SELECT user_id, max(n) AS largest, sum(n) AS positives, sum(n) >= 5 AND max(n) >= 0.8 * sum(n) AS skewed FROM g GROUP BY user_id""")
def feed_source_skew(spark, sf_dir):
    return O.source_skew(P.clicks(spark, sf_dir), P.items(spark, sf_dir))


@query("""WITH s AS (SELECT vec_id, list_slice(CAST(embedding AS DOUBLE[]), 1, 16) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM s)
    SELECT vec_id, round(v[1] / norm, 6) AS first, round(v[16] / norm, 6) AS last, len(v) AS dims FROM n""")
def truncate_and_normalise(spark, sf_dir):
    v = truncate_normalise(F.col("embedding"), 16)
    return P.table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[15], 6).alias("last"), F.size("v").cast("long").alias("dims"))


# ---- searches for every hundredth row --------------------------------------
KNN = f"q AS (SELECT item_id AS query_id, embedding AS qv FROM vec WHERE item_id % 100 = 0), sims AS (SELECT query_id, item_id, round({DOT.format(a='embedding', b='qv')}, 6) AS similarity FROM vec, q)"
BEST = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) <= {k}"


def _queries(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")


def _scaled_round(c):
    """To 6 places on the scaled double, as DuckDB rounds; F.round goes by the decimal text, which differs on ties."""
    return F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6


@query(f"WITH {VEC}, {KNN} SELECT * FROM sims {BEST.format(k=10)}")
def knn_topk(spark, sf_dir):
    return O.nearest_each(_vectors(spark, sf_dir), _queries(spark, sf_dir), 10)


@query(f"WITH {VEC}, {KNN} SELECT s.* FROM sims s JOIN embeddings e ON e.vec_id = s.item_id WHERE label = 1 {BEST.format(k=10)}")
def knn_prefiltered(spark, sf_dir):
    own = P.table(spark, sf_dir, "embeddings").filter("label = 1").select(F.col("vec_id").alias("item_id"), "embedding")
    return O.nearest_each(own, _queries(spark, sf_dir), 10)


@query(f"""WITH {VEC}, {KNN}, top AS (SELECT * FROM sims {BEST.format(k=50)}), b AS (SELECT query_id, avg(similarity) AS best FROM (SELECT * FROM top {BEST.format(k=3)}) GROUP BY query_id)
    SELECT query_id, item_id, similarity FROM top JOIN b USING (query_id) WHERE similarity >= best * 0.9""")
def relevance_floor(spark, sf_dir):
    return O.relevance_floor_each(O.nearest_each(_vectors(spark, sf_dir), _queries(spark, sf_dir), 50))


@query(f"""WITH {C}, {I}, {VEC}, {KNN}, {PROFILE}, hits AS (SELECT * FROM sims {BEST.format(k=50)}),
    r AS (SELECT q.query_id, i.item_id, contains(lower(title), 'reth') AS t, contains(lower(title), 'reth') OR contains(lower(summary), 'reth') AS b, similarity, profile_similarity
        FROM items i CROSS JOIN q LEFT JOIN hits h ON h.query_id = q.query_id AND h.item_id = i.item_id LEFT JOIN psim p ON p.item_id = i.item_id)
    SELECT query_id, item_id, round(0.75 * least(coalesce(similarity, 0) + CASE WHEN t THEN 0.35 WHEN b THEN 0.15 ELSE 0 END, 1) + 0.25 * greatest(0, coalesce(profile_similarity, 0)), 6) AS score,
    CASE WHEN b AND similarity IS NOT NULL THEN 'both' WHEN b THEN 'literal' ELSE 'semantic' END AS how FROM r WHERE b OR similarity IS NOT NULL""")
def search_blend(spark, sf_dir):
    vectors, queries = _vectors(spark, sf_dir), _queries(spark, sf_dir)
    liked = F.array(*[F.lit(x) for x in O.profile(vectors, P.clicks(spark, sf_dir).filter("user_id = 1"))])
    own = vectors.select("item_id", F.round(dot(F.col("embedding"), liked), 9).alias("profile_similarity"))
    return O.search_each(P.items(spark, sf_dir), O.nearest_each(vectors, queries, 50), queries, own, "reth").withColumn("score", _scaled_round("score"))


@query(f"""WITH {VEC}, {KNN}, {I}, w AS (SELECT item_id, len(list_intersect(string_split(lower(title), ' '), ['the', 'of', 'and'])) AS hits FROM items),
    s AS (SELECT query_id, item_id, round(similarity + 0.02 * hits, 6) AS score FROM sims JOIN w USING (item_id))
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 20""")
def library_literal_boost(spark, sf_dir):
    words = F.size(F.array_intersect(F.split(F.lower("title"), " "), F.array(F.lit("the"), F.lit("of"), F.lit("and"))))
    rows = P.items(spark, sf_dir).select("item_id", (O.WORD_BOOST * words).alias("bonus")).join(_vectors(spark, sf_dir), "item_id")
    return O.nearest_each(rows, _queries(spark, sf_dir), 20).withColumnRenamed("similarity", "score")
