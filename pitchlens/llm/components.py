"""Connected components by contraction: every node hooks on its smallest neighbour, edges shrink to their roots.

Nodes are compared by a hash of their value, so a path in the order of the values is no slow case: a
constant share of the nodes goes in each round. All state is in tables; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitchlens.llm._common import cut


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """node, root for every node of the edges (longs); nodes of one component share one root."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    live = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    roots = live.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not live.isEmpty():
        both = live.union(live.select("v", "u"))
        hook = cut(both.groupBy("u").agg(F.min(rank("v")).alias("m"))
                   .select(F.col("u").alias("child"),
                           F.when(F.col("m") < rank("u"), F.col("m.n")).otherwise(F.col("u")).alias("parent")))
        # Two hops per round: the parent of the parent is in the same component.
        up = hook.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
        hop = cut(hook.join(up, "parent").select("child", F.col("grand").alias("top")))
        roots = cut(roots.join(hop, roots["root"] == hop["child"], "left")
                    .select("node", F.coalesce("top", "root").alias("root")))
        left = live.join(hop, live["u"] == hop["child"]).select(F.col("top").alias("u"), "v")
        right = left.join(hop, left["v"] == hop["child"]).select("u", F.col("top").alias("v"))
        live = cut(right.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    return roots
