"""Connected components of a graph that is too large for one place.

Every node points to the least node it knows of. In each round a node takes the
least of its pointer's pointer and its neighbours' pointers, and hooks what it
pointed to onto that too; rounds go on until no pointer moves (about the
logarithm of the longest path). Each round is joins and grouped minima, which
combine within tasks first, and is written to the shared folder; only the sum of
the pointers reaches the driver. Edges are read twice, so they should be a stored
table. No edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.shared import settle


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b): component is the least node that can be reached. Self-links and repeats do no harm; rows with nulls are left out."""
    one = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    most = 2 * one.count()
    both = settle(spark, one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-links", most)
    now = settle(spark, both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "cc-pointers", most)
    total = F.sum(F.col("p").cast("decimal(38,0)"))
    was, is_ = None, now.agg(total).first()[0]
    while was != is_:
        up = now.select(F.col("u").alias("p"), F.col("p").alias("g"))
        jumped = now.join(up, "p").select("u", "p", "g")
        near = both.join(jumped.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        found = jumped.join(near, "u").select("u", F.explode(F.array(F.col("u"), F.col("p"))).alias("to"), F.least("g", "m").alias("p"))
        now = settle(spark, found.groupBy(F.col("to").alias("u")).agg(F.min("p").alias("p")), "cc-pointers", most)
        was, is_ = is_, now.agg(total).first()[0]
    return now.select(F.col("u").alias("node"), F.col("p").alias("component"))
