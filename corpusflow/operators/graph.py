"""Connected components of large graphs, by alternating stars.

In a large-star round each node tells its larger neighbours of the smallest node that it knows; in a small-star round its
smaller ones. Both are a combined minimum by node and a join, so a node with most of all edges costs no task more than
its share. Rounds end when the edges stay the same, which takes about the logarithm of the longest chain. Each round's
edges are a written table, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import scratch_path


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable over edges (a, b), taken both ways; a node without edges is
    its own. Nodes that only edges name count, too. Null ends are no edges."""
    spark = edges.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = kept(edges.where("a is not null and b is not null and a <> b").select(a, b).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = kept(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # every edge now goes from a node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(least, "a")
        small = stars.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")
        now = kept(small.distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return nodes.select("node").unionByName(edges.select(F.explode(F.array("a", "b")).alias("node"))).where("node is not null").distinct().join(now.select(F.col("a").alias("node"), F.col("b").alias("found")), "node", "left").select("node", F.coalesce("found", "node").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """The number of edges and a checksum of them."""
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mark).first())


def stars(memberships: DataFrame, item: str, key: str) -> DataFrame:
    """Edges (a, b) that connect all items with the same key: each with the smallest, so as many as items. Null keys
    connect nothing."""
    known = memberships.where(F.col(key).isNotNull()).select(F.col(item).alias("a"), F.col(key).alias("key"))
    least = known.groupBy("key").agg(F.min("a").alias("b"))
    return known.join(least, "key").where("a <> b").select("a", "b")
