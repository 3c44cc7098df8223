"""Connected components of an undirected graph, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.operators.storage import discard, materialize, rows_and_sum


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _step(edges: DataFrame) -> DataFrame:
    """One large-star then one small-star pass; only aggregates and equi-joins of ids. The edges of a hub meet in one task of a sorted join, which spills."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least(both).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    low = _least(large)
    small = large.join(low, "u")
    return small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Return ``node, component`` for every node of an edge; the component is its smallest node.

    Null ends and self loops are ignored. The state between passes is a table in the
    shared folder; only a row count and a checksum come to the driver.
    """
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & F.col("u").isNotNull()).filter("u <> v").distinct()
    now, seen = materialize(now, "edges"), None
    while True:
        mark = rows_and_sum(now)
        if mark == seen or not mark[0]:
            break
        old, now, seen = now, materialize(_step(now), "edges"), mark
        discard(old)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
