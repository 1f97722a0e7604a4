"""The reading feed: candidates, preferences, search and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.shared import settled
from tracewright.functions.vectors import dot
from tracewright.operators.ranking import average_ranks, positions

# Blend of query and profile, boosts for literal matches, floor and anchor of semantic hits, weight of a shared word in the library.
QUERY_WEIGHT, TITLE_BOOST, BODY_BOOST = 0.75, 0.35, 0.15
FLOOR, ANCHOR = 0.9, 3
WORD_BOOST = 0.02
HUMAN = ("ui", "agent")


def candidates(items: DataFrame, clicks: DataFrame, since) -> DataFrame:
    """Items published since a date that the clicks don't cover."""
    return items.filter(F.col("published") >= since).join(clicks, "item_id", "left_anti")


def unrated(engagement: DataFrame, clicks: DataFrame) -> DataFrame:
    """(user_id, item_id) engaged with and never judged."""
    return engagement.select("user_id", "item_id").distinct().join(clicks, ["user_id", "item_id"], "left_anti")


def key_stats(clicks: DataFrame, item_keys: DataFrame) -> DataFrame:
    """user_id, key, useful, other: verdicts by the keys (item_id, key) of the items."""
    return clicks.join(item_keys, "item_id").groupBy("user_id", "key").agg(F.sum("useful").alias("useful"), F.sum(1 - F.col("useful")).alias("other"))


def with_preference(stats: DataFrame) -> DataFrame:
    """Laplace-smoothed share of useful verdicts."""
    return stats.withColumn("pref", (F.col("useful") + 1) / (F.col("useful") + F.col("other") + 2))


def item_preferences(item_keys: DataFrame, stats: DataFrame) -> DataFrame:
    """item_id, pref: mean over the item's keys, 0.5 for keys without verdicts."""
    known = with_preference(stats).select("key", "pref")
    return item_keys.join(known, "key", "left").groupBy("item_id").agg(F.avg(F.coalesce("pref", F.lit(0.5))).alias("pref"))


def top_and_bottom(stats: DataFrame, n: int) -> DataFrame:
    """The n keys of each user that are liked most (over 0.5) and least (under)."""
    p = with_preference(stats)
    best = Window.partitionBy("user_id").orderBy(F.desc("pref"), "key")
    worst = Window.partitionBy("user_id").orderBy("pref", "key")
    top = p.filter("pref > 0.5").withColumns({"place": F.row_number().over(best), "side": F.lit("top")})
    bottom = p.filter("pref < 0.5").withColumns({"place": F.row_number().over(worst), "side": F.lit("bottom")})
    return top.unionByName(bottom).filter(F.col("place") <= n).select("user_id", "side", "place", "key", "pref")


def quality(clicks: DataFrame, min_minority: int = 5) -> DataFrame:
    """What a user's verdicts can train, and how much of the blend they win."""
    g = clicks.groupBy("user_id").agg(F.count(F.lit(1)).alias("clicks"), F.sum("useful").alias("useful"), F.sum(1 - F.col("useful")).alias("not_useful"), F.count_if(F.col("source").isin(*HUMAN)).alias("real"))
    active, fewer = (F.col("useful") > 0) & (F.col("not_useful") > 0), F.least("useful", "not_useful")
    caveat = F.when(~active, "classifier off").when(F.col("clicks") < 20, "weakly trained").when(fewer < min_minority, "one-sided").otherwise("")
    return g.select("*", active.alias("classifier_active"), (F.col("clicks") / (F.col("clicks") + 5)).alias("blend_weight"), (F.col("real") / (F.col("real") + 5)).alias("real_weight"), caveat.alias("caveat"))


def source_skew(clicks: DataFrame, items: DataFrame, share: float = 0.8, least: int = 5) -> DataFrame:
    """user_id, largest, positives, skewed: whether so large a share of a user's useful items, of which there are at least so many, is from one feed. Generated verdicts don't count."""
    own = clicks.filter((F.col("useful") == 1) & (F.col("source") != "bootstrap")).join(items.select("item_id", "feed"), "item_id")
    per = own.groupBy("user_id", "feed").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("user_id").agg(F.max("n").alias("largest"), F.sum("n").alias("positives")).withColumn("skewed", (F.col("positives") >= least) & (F.col("largest") >= share * F.col("positives")))


def round_robin(items: DataFrame, per_feed: int) -> DataFrame:
    """The newest items of every feed."""
    w = Window.partitionBy("feed").orderBy(F.desc("published"), "item_id")
    return items.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= per_feed).select("item_id", "feed", "turn")


def profile(vectors: DataFrame, clicks: DataFrame) -> list[float]:
    """Mean vector of the useful items; one row reaches the driver."""
    own = vectors.join(clicks.filter("useful = 1").select("item_id").distinct(), "item_id", "left_semi")
    parts = own.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return [r["m"] for r in parts.orderBy("i").collect()]


def blend(vectors: DataFrame, profile_vector: list[float], prefs: DataFrame, n_clicks: int) -> DataFrame:
    """item_id, similarity, final: profile rank and tie-averaged preference rank, mixed by n / (n + 5). Lower is better."""
    v = F.array(*[F.lit(x) for x in profile_vector])
    scored = vectors.select("item_id", F.round(dot(F.col("embedding"), v), 9).alias("similarity")).join(prefs, "item_id", "left").withColumn("pref", F.coalesce("pref", F.lit(0.5)))
    ranked = average_ranks(positions(scored, "similarity", "item_id", "profile_rank"), "pref", "pref_rank")
    w = n_clicks / (n_clicks + 5)
    return ranked.select("item_id", "similarity", (F.lit(w) * F.col("pref_rank") + F.lit(1 - w) * F.col("profile_rank")).alias("final"))


def literal(items: DataFrame, needle: str, limit: int) -> DataFrame:
    """The newest items whose title or text holds the needle."""
    low = needle.lower()
    hit = F.lower("title").contains(low) | F.lower("summary").contains(low)
    return items.filter(hit).orderBy(F.desc("published"), F.desc("item_id")).limit(limit).select("item_id")


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k most similar of all unit vectors: item_id, similarity."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("item_id", F.round(dot(F.col("embedding"), q), 6).alias("similarity")).orderBy(F.desc("similarity"), "item_id").limit(k)


# Queries of a block that are scored at once.
SLICE = 64


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, rows: int = 8192, block: int = 1024) -> DataFrame:
    """query_id, item_id, similarity: of each of queries (query_id, embedding) the k best of all unit vectors (item_id, embedding, and
    bonus, which counts on top, where there is one). Blocks of vectors meet blocks of queries and yield k each."""
    bonus = F.col("bonus").cast("double") if "bonus" in vectors.columns else F.lit(0.0)
    n_rows, n_queries = max(1, -(-vectors.count() // rows)), max(1, -(-queries.count() // block))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.filter("embedding IS NOT NULL").select("item_id", F.col("embedding").cast("array<double>").alias("embedding"), bonus.alias("bonus"), place("item_id", n_rows).alias("i"), every(n_queries).alias("j"))
    right = queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), place("query_id", n_queries).alias("j"), every(n_rows).alias("i"))

    def best(_, a, b):
        import numpy as np
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "item_id": [], "similarity": []}).astype({"query_id": "int64", "item_id": "int64"})
        a = a.sort_values("item_id")
        ids, bonuses, vectors = a["item_id"].to_numpy(), a["bonus"].to_numpy(), np.stack(a["embedding"].to_list()).T
        asked, points, out = b["query_id"].to_numpy(), np.stack(b["embedding"].to_list()), []
        for at in range(0, len(asked), SLICE):  # a few queries at a time, as each has a score for every vector of the block
            near = np.round(np.round(points[at : at + SLICE] @ vectors, 6) + bonuses, 6)
            top = np.argsort(-near, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(asked[at : at + SLICE], top.shape[1]), "item_id": ids[top.ravel()], "similarity": np.take_along_axis(near, top, 1).ravel()}))
        return pd.concat(out)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, "query_id long, item_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("place")


def relevance_floor_each(hits: DataFrame, floor: float = FLOOR, anchor: int = ANCHOR) -> DataFrame:
    """Each query's hits within the floor of the mean of its best few."""
    best = hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))).filter(F.col("place") <= anchor).groupBy("query_id").agg(F.avg("similarity").alias("best"))
    return hits.join(best, "query_id").filter(F.col("similarity") >= F.col("best") * floor).drop("best")


def relevance_floor(hits: DataFrame, floor: float = FLOOR, anchor: int = ANCHOR) -> DataFrame:
    """Hits within the floor of the mean of the best few."""
    best = hits.orderBy(F.desc("similarity")).limit(anchor).agg(F.avg("similarity").alias("best"))
    return hits.join(F.broadcast(best), F.col("similarity") >= F.col("best") * floor).drop("best")


def search(items: DataFrame, semantic: DataFrame, profile_similarity: DataFrame, needle: str) -> DataFrame:
    """item_id, score, how: relevance with literal boosts, three quarters, and the profile."""
    rows = _literal_hits(items, needle).join(semantic, "item_id", "left").filter("b OR similarity IS NOT NULL").join(profile_similarity, "item_id", "left")
    return rows.select("item_id", *_blended())


def search_each(items: DataFrame, semantic: DataFrame, queries: DataFrame, profile_similarity: DataFrame, needle: str) -> DataFrame:
    """query_id, item_id, score, how: the same for each query_id of queries; literal hits belong to all of them, and items that are no hit of any aren't paired."""
    rows = _literal_hits(items, needle).filter("item_id IS NOT NULL").join(profile_similarity, "item_id", "left")
    near = rows.join(semantic.select("query_id", "item_id", "similarity"), "item_id")
    # Literal hits meet the ids of the queries where they are: pairs are written, and not shuffled.
    met = semantic.groupBy("item_id").agg(F.collect_set("query_id").alias("met"))
    literal = rows.filter("b").join(met, "item_id", "left").withColumn("met", F.coalesce("met", F.array().cast("array<long>")))
    far = literal.crossJoin(F.broadcast(queries.select("query_id").distinct())).filter(~F.array_contains("met", F.col("query_id"))).withColumn("similarity", F.lit(None).cast("double"))
    return near.select("query_id", "item_id", *_blended()).unionByName(far.select("query_id", "item_id", *_blended()))


def _literal_hits(items: DataFrame, needle: str) -> DataFrame:
    low = needle.lower()
    in_title, in_body = F.lower("title").contains(low), F.lower("summary").contains(low)
    return items.select("item_id", in_title.alias("t"), (in_title | in_body).alias("b"))


def _blended() -> list:
    relevance = F.coalesce("similarity", F.lit(0.0)) + F.when(F.col("t"), TITLE_BOOST).when(F.col("b"), BODY_BOOST).otherwise(0.0)
    score = QUERY_WEIGHT * F.least(relevance, F.lit(1.0)) + (1 - QUERY_WEIGHT) * F.greatest(F.lit(0.0), F.coalesce("profile_similarity", F.lit(0.0)))
    how = F.when(F.col("b") & F.col("similarity").isNotNull(), "both").when(F.col("b"), "literal").otherwise("semantic")
    return [score.alias("score"), how.alias("how")]


def best_clusters(item_tags: DataFrame, members: DataFrame) -> DataFrame:
    """item_id, label, overlap: the cluster (label, tag) that shares most tags with an item, ties by label; null without any."""
    n = item_tags.join(members, "tag").groupBy("item_id", "label").agg(F.count(F.lit(1)).alias("overlap"))
    best = n.groupBy("item_id").agg(F.min_by(F.struct("label", "overlap"), F.struct(-F.col("overlap"), "label")).alias("best"))
    return item_tags.select("item_id").distinct().join(best, "item_id", "left").select("item_id", "best.label", F.coalesce("best.overlap", F.lit(0)).alias("overlap"))


def digest_budget(sizes: DataFrame, per_topic: int, budget: int) -> DataFrame:
    """label, n, shown: the budget spent on the largest topics first, per_topic each. At most budget topics get any, so these alone are ordered."""
    w = Window.orderBy(F.desc("n"), "label").rowsBetween(Window.unboundedPreceding, -1)
    top = sizes.orderBy(F.desc("n"), "label").limit(budget)
    spent = F.coalesce(F.sum(F.least("n", F.lit(per_topic))).over(w), F.lit(0))
    return top.withColumn("shown", F.least("n", F.lit(per_topic), F.lit(budget) - spent)).filter("shown > 0")


def jaccard_nearest(words: DataFrame, rows: int = 8192, step: int = 1024, wide: int = 4096) -> DataFrame:
    """user_id, other, similarity: the user that shares most of their words (user_id, word), ties by the least id; none for users that share no word with anyone.

    Users with the same words are one class: in one of several the nearest is its least other member. The others, and all classes, are dealt into blocks of
    about ``rows``; every two blocks count what they share by products of ``step`` users and ``wide`` words at a time, and yield a row for each user. So no pair
    of users is ever a row, however common a word is.
    """
    own = words.filter("user_id IS NOT NULL AND word IS NOT NULL").groupBy("user_id").agg(F.array_sort(F.collect_set("word")).alias("words"))
    first = F.min("user_id")
    classes = settled(own.groupBy("words").agg(first.alias("user_id"), F.count(F.lit(1)).alias("n")), "jaccard-classes")
    several = classes.filter("n > 1")
    members = own.join(several.select("words", F.col("user_id").alias("least")), "words").select("user_id", "least")
    second = members.filter("user_id <> least").groupBy("least").agg(F.min("user_id").alias("second"))
    alike = members.join(second, "least").select("user_id", F.when(F.col("user_id") == F.col("least"), F.col("second")).otherwise(F.col("least")).alias("other"), F.lit(1.0).alias("similarity"))

    alone = classes.filter("n = 1")
    n_left, n_right = max(1, -(-alone.count() // rows)), max(1, -(-classes.count() // rows))
    place = lambda n: F.pmod(F.xxhash64("user_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = alone.select("user_id", "words", place(n_left).alias("i"), every(n_right).alias("j"))
    right = classes.select(F.col("user_id").alias("other"), F.col("words").alias("theirs"), place(n_right).alias("j"), every(n_left).alias("i"))
    schema = T.StructType([T.StructField("user_id", own.schema["user_id"].dataType), T.StructField("other", own.schema["user_id"].dataType), T.StructField("similarity", T.DoubleType())])

    def best(_, a, b):
        import numpy as np
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"user_id": [], "other": [], "similarity": []})
        b = b.rename(columns={"other": "user_id", "theirs": "words"}).sort_values("user_id")
        sizes = [t["words"].map(len).to_numpy() for t in (a, b)]
        flat = [np.concatenate(t["words"].to_list()) for t in (a, b)]
        common = np.intersect1d(*flat)
        coded = []
        for n, values in zip(sizes, flat, strict=True):
            at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
            there = common[at] == values if len(common) else np.zeros(len(values), dtype=bool)
            coded.append((np.repeat(np.arange(len(n)), n)[there], at[there]))

        def marks(which, low, high, start):
            r, c = coded[which]
            pick = (r >= low) & (r < high) & (c >= start) & (c < start + wide)
            m = np.zeros((high - low, min(wide, len(common) - start)), dtype=np.float32)
            m[r[pick] - low, c[pick] - start] = 1
            return m

        keys = [t["user_id"].to_numpy() for t in (a, b)]
        out = []
        for u in range(0, len(a), step):
            rows_a = slice(u, min(u + step, len(a)))
            near, other = np.zeros(rows_a.stop - u), np.zeros(rows_a.stop - u, dtype=np.int64)
            for v in range(0, len(b), step):
                rows_b = slice(v, min(v + step, len(b)))
                shared = np.zeros((rows_a.stop - u, rows_b.stop - v), dtype=np.float32)
                for start in range(0, len(common), wide):
                    shared += marks(0, u, rows_a.stop, start) @ marks(1, v, rows_b.stop, start).T
                x, y = np.nonzero(keys[0][rows_a, None] == keys[1][None, rows_b])
                shared[x, y] = 0
                likeness = shared.astype(np.float64)
                likeness /= sizes[0][rows_a, None] + sizes[1][None, rows_b] - likeness
                top = likeness.argmax(1)  # the first of equal ones, which has the least id
                value = likeness[np.arange(len(top)), top]
                more = value > near
                near[more], other[more] = value[more], v + top[more]
            hit = near > 0
            out.append(pd.DataFrame({"user_id": keys[0][rows_a][hit], "other": keys[1][other[hit]], "similarity": near[hit]}))
        return pd.concat(out, ignore_index=True)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, schema)
    nearest = F.min_by(F.struct("other", "similarity"), F.struct(-F.col("similarity"), "other"))
    return alike.unionByName(found.groupBy("user_id").agg(nearest.alias("b")).select("user_id", "b.other", "b.similarity"))


def suggest_sources(clicks: DataFrame, tags: DataFrame, sources: DataFrame, limit: int = 5) -> DataFrame:
    """user_id, source, score: sources (item_id, source) that a user never judged an item of, by how many of the tags of useful items
    they hold; ties by name. Tags of the same useful items and the same sources count as one class with its size, and those of one useful item are summed
    before users meet them; of the others a user meets each class once."""
    useful = clicks.filter("useful = 1").select("user_id", "item_id").distinct()
    known = sources.select("item_id", F.struct("source").alias("s"))
    rows = tags.filter("tag IS NOT NULL").join(useful.select("item_id").distinct().withColumn("u", F.lit(True)), "item_id", "left").join(known, "item_id", "left")
    sets = rows.groupBy("tag").agg(F.array_sort(F.collect_set(F.when(F.col("u"), F.col("item_id")))).alias("items"), F.array_sort(F.collect_set("s")).alias("held"))
    classes = sets.filter("size(items) > 0 AND size(held) > 0").groupBy("items", "held").agg(F.min("tag").alias("class"), F.count(F.lit(1)).alias("n"))
    per_user = useful.repartition("user_id")  # what follows stays with its user where the classes are broadcast
    single = classes.filter("size(items) = 1").select(F.col("items")[0].alias("item_id"), F.explode("held").alias("s"), "n").groupBy("item_id", "s").agg(F.sum("n").alias("n"))
    shared = classes.filter("size(items) > 1").select(F.explode("items").alias("item_id"), "class", "held", "n")
    met = per_user.join(shared, "item_id").select("user_id", "class", "held", "n").distinct().groupBy("user_id", "held").agg(F.sum("n").alias("n"))
    found = per_user.join(single, "item_id").select("user_id", "s.source", "n").unionByName(met.select("user_id", F.explode("held").alias("s"), "n").select("user_id", "s.source", "n"))
    has = clicks.select("user_id", "item_id").join(sources, "item_id").select("user_id", "source").distinct()
    scored = found.groupBy("user_id", "source").agg(F.sum("n").alias("score")).join(has, ["user_id", "source"], "left_anti")
    best = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "source"))
    return scored.withColumn("place", best).filter(F.col("place") <= limit).select("user_id", "source", "score")
