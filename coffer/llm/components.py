"""Connected components of links between keys, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every key in a link; root is the least key of its component.

    Each round hangs the neighbours of a node under the least of them: first the
    larger neighbours, then the smaller ones. Paths shrink by half in a round, which
    is a grouped minimum and a join. Minima are combined before they are dealt, and
    both sides of the joins are dealt anew, so that Spark can split a
    hub's neighbours among tasks. Rounds end when the links no longer change.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = written(edges, "links")
    seen = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(under.hint("rebalance"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(under.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        seen = now
