"""Connected components by alternating large-star and small-star rounds, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """(node, near) -> the same rows with low, the least of node and its near ones. The minimum is pre-aggregated; the join may split hot nodes."""
    low = pairs.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("low"))
    return pairs.join(low, "node")


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, root): root is the smallest node reachable. Nodes without edges aren't listed.

    Self links and nulls are ignored, repeated links count once; an empty table gives an empty one. Each round is written
    to the shared folder; rounds grow with the logarithm of the longest path."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    e = materialize(e)
    mark = None
    while True:
        both = e.select(F.col("lo").alias("node"), F.col("hi").alias("near")).union(e.select(F.col("hi").alias("node"), F.col("lo").alias("near")))
        large = _to_minimum(both).where("near > node").select(F.col("near").alias("hi"), F.col("low").alias("lo")).where("hi <> lo").distinct()
        down = _to_minimum(large.select(F.col("hi").alias("node"), F.col("lo").alias("near")))
        small = down.select(F.explode(F.array(F.struct(F.col("near").alias("hi"), F.col("low").alias("lo")), F.struct(F.col("node").alias("hi"), F.col("low").alias("lo")))).alias("x")).select("x.lo", "x.hi")
        e = materialize(small.where("hi <> lo").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = now
