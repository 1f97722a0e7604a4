"""The tag graph: co-occurrence, paths, centrality and communities."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(assignments: DataFrame, min_uses: int = 2, min_weight: int = 2) -> DataFrame:
    """a < b, weight: items (pid) that hold both tags. Tags are filtered by use first, so rare ones never meet."""
    rows = assignments.select("pid", "tag").distinct()
    keep = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_uses).select("tag")
    sets = rows.join(keep, "tag")
    pairs = sets.select("pid", F.col("tag").alias("a")).join(sets.select("pid", F.col("tag").alias("b")), "pid").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= min_weight)


def both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))


def degrees(e: DataFrame) -> DataFrame:
    return both_ways(e).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def shortest_paths(e: DataFrame, source: str, max_hops: int = 8) -> DataFrame:
    """node, hops, path from source: the first in order of names among the shortest. A level is a join and a grouped minimum."""
    links = both_ways(e).select("node", "other").cache()
    done = links.sparkSession.createDataFrame([(source, 0, source)], "node string, hops int, path string")
    front = done
    for hop in range(1, max_hops + 1):
        step = front.join(links, "node").select(F.col("other").alias("node"), F.concat_ws(" > ", "path", "other").alias("path"))
        front = step.groupBy("node").agg(F.min("path").alias("path")).join(done.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops"), "path").cache()
        if front.isEmpty():
            break
        done = done.unionByName(front)
    return done


def health(assignments: DataFrame, e: DataFrame) -> DataFrame:
    """One row: size, singleton rate, degrees (the median is the lower one) and the hub's share."""
    uses = assignments.select("pid", "tag").distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    tags = uses.agg(F.count(F.lit(1)).alias("distinct_tags"), F.round(100 * F.count_if(F.col("n") == 1) / F.count(F.lit(1)), 1).alias("singleton_rate"))
    d = degrees(e)
    sizes = d.agg(F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("max_degree"), F.round(100 * F.max("degree") / F.sum("degree"), 1).alias("hub_dominance_pct"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY degree)").alias("median_degree"))
    return tags.crossJoin(sizes)  # a row each


def _adjacency(rows) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for a, b, w in rows:
        out[a][b] = out[b][a] = w
    return out


def betweenness(e: DataFrame, max_edges: int = 2_000_000) -> DataFrame:
    """node, score: unweighted, undirected. Sources are dealt over the tasks, each with the edge list, whose size is checked first."""
    n = e.count()
    if n > max_edges:
        raise ValueError(f"{n} edges; raise the thresholds of the graph to at most {max_edges}")
    shared = e.sparkSession.sparkContext.broadcast([tuple(r) for r in e.select("a", "b", "weight").collect()])

    def run(batches):
        import pandas as pd

        near = _adjacency(shared.value)
        for pdf in batches:
            total: dict[str, float] = defaultdict(float)
            for source in pdf["node"]:
                ways, level, before, order = {source: 1}, {source: 0}, defaultdict(list), [source]
                for v in order:
                    for w in near[v]:
                        if w not in level:
                            level[w] = level[v] + 1
                            ways[w] = 0
                            order.append(w)
                        if level[w] == level[v] + 1:
                            ways[w] += ways[v]
                            before[w].append(v)
                share: dict[str, float] = defaultdict(float)
                for w in reversed(order[1:]):
                    for v in before[w]:
                        share[v] += ways[v] / ways[w] * (1 + share[w])
                    total[w] += share[w]
            yield pd.DataFrame({"node": list(total), "part": list(total.values())})

    nodes = both_ways(e).select("node").distinct().repartition(8)
    parts = nodes.mapInPandas(run, "node string, part double")
    return parts.groupBy("node").agg((F.sum("part") / 2).alias("score"))


def communities(e: DataFrame, passes: int = 20, max_edges: int = 2_000_000) -> DataFrame:
    """node, community by modularity: nodes in order of names move to the neighbouring community that gains most, ties to the first name. Sequential by nature, so one task works on the thresholded edge table, whose rows are pairs of tags and not documents; more than max_edges are an error."""

    def run(pdf):
        import pandas as pd

        near = _adjacency(pdf[["a", "b", "weight"]].itertuples(index=False))
        twice = 2.0 * float(pdf["weight"].sum())
        strength = {v: sum(w.values()) for v, w in near.items()}
        home = {v: v for v in near}
        total = dict(strength)
        for _ in range(passes):
            moved = False
            for v in sorted(near):
                own, k = home[v], strength[v]
                total[own] -= k
                links: dict[str, float] = defaultdict(float)
                for u, w in near[v].items():
                    links[home[u]] += w
                gain = lambda c: links.get(c, 0.0) - total[c] * k / twice  # noqa: B023, E731
                best, top = own, gain(own)
                for c in sorted(links):
                    g = gain(c)
                    if g > top + 1e-12 or abs(g - top) < 1e-12 and c < best:
                        best, top = c, g
                total[best] += k
                moved |= best != own
                home[v] = best
            if not moved:
                break
        return pd.DataFrame({"node": list(home), "community": list(home.values())})

    if (n := e.count()) > max_edges:
        raise ValueError(f"{n} edges are over max_edges={max_edges}: raise the edge threshold, or the bound with the memory of a task")
    return e.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(run, "node string, community string")
