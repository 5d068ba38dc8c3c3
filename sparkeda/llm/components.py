"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has an edge.

    Alternating large-star and small-star steps. A step is a map-side combined minimum
    per node and one equi-join that AQE splits where a node has very many neighbours; no
    neighbourhood is ever collected. Every round is checkpointed; it ends when an
    edge list no longer changes (compared by count and an order-free hash)."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v") \
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut_lineage(e)

    def mark(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        return r["n"], r["h"]

    last = mark(e)
    for _ in range(max_rounds):
        if last[0] == 0:
            break
        # large star: every larger neighbour is linked to the smallest node around
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: smaller neighbours and the node itself are linked to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut_lineage(e)
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
