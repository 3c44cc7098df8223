"""Link networks: roots of chains, the giant component, top nodes, pruning, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings.operators.components import connected_components
from tidings.operators.storage import materialize, rows_and_sum


def roots(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """``key, root``: follow ``parent`` to its end by doubling steps; members of a cycle have no root."""
    now = materialize(nodes.select(F.col(key).alias("n"), F.coalesce(parent, key).alias("up")), "roots")
    seen = None
    for _ in range(64):
        if rows_and_sum(now) == seen:
            break
        seen = rows_and_sum(now)
        now = materialize(now.join(now.select(F.col("n").alias("up"), F.col("up").alias("top")), "up", "left").select("n", F.coalesce("top", "up").alias("up")), "roots")
    ends = nodes.filter(F.col(parent).isNull()).select(F.col(key).alias("root"))
    return now.select(F.col("n").alias(key), F.col("up").alias("root")).join(ends, "root", "left_semi").select(key, "root")


def giant_component(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges of the component with most nodes, ties to the smaller component."""
    parts = materialize(connected_components(edges, src, dst), "components")
    largest = F.broadcast(parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component"))
    return edges.join(parts.join(largest, "component").select(F.col("node").alias(src)), src, "left_semi")


def top_nodes(nodes: DataFrame, by: str, n: int = 1000, key: str = "media_id") -> DataFrame:
    return nodes.orderBy(F.desc_nulls_last(by), key).limit(n)


def near_centre(nodes: DataFrame, times: float = 2.0) -> DataFrame:
    """Nodes with ``x, y`` within ``times`` the median distance from the mean position."""
    centre = F.broadcast(nodes.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))
    far = materialize(nodes.crossJoin(centre).withColumn("far", F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)), "distances")
    middle = F.broadcast(element_at(far, "far").select(F.col("far").alias("middle")))
    return far.crossJoin(middle).filter(F.col("far") <= F.lit(times) * F.col("middle")).select(*nodes.columns)


def element_at(rows: DataFrame, column: str, bins: int = 10_000, place: int | None = None) -> DataFrame:
    """One row: the element at ``place`` (from 0) of the sorted values, by default at n / 2.

    Values are counted in bins between the least and the most; the bin that holds the element is binned
    again until it is of one value, so no task sees more than the counts of the bins.
    """
    now, skip = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null"), None
    while True:
        ends = now.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).first()
        skip = (ends.n // 2 if place is None else place) if skip is None else skip
        if ends.lo is None or ends.lo == ends.hi:
            return rows.sparkSession.createDataFrame([(ends.lo,)], f"`{column}` double")
        place = F.least(F.floor((F.col("v") - ends.lo) / (ends.hi - ends.lo) * bins), F.lit(bins - 1))
        counts = sorted((r.b, r.n) for r in now.groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect())
        for b, n in counts:
            if skip < n:
                break
            skip -= n
        now = now.filter(place == b)


def scaled(nodes: DataFrame, by: str, least: float, most: float) -> DataFrame:
    """Node sizes by the share of the largest value."""
    top = F.broadcast(nodes.agg(F.max(by).alias("top")))
    return nodes.crossJoin(top).withColumn("size", F.lit(least) + F.lit(most - least) * F.coalesce(F.col(by) / F.col("top"), F.lit(0.0))).drop("top")


def communities(edges: DataFrame, src: str, dst: str, weight: str, rounds: int = 5) -> DataFrame:
    """``node, community`` by weighted label propagation, ties to the smaller label.

    The links are made once, as a table in the shared folder that each round reads.
    """
    once = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.col(weight).alias("w")), "graph")
    both = once.union(once.select("b", "a", "w"))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a", "community").agg(F.sum("w").alias("w"))
        labels = materialize(votes.groupBy("a").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("community")).withColumnRenamed("a", "node"), "labels")
    return labels


def ranked_edges(edges: DataFrame, counts: DataFrame, src: str, dst: str, keep: int) -> DataFrame:
    """The ``keep`` strongest links of each source, by link count, then the target's inlinks, then its id."""
    w = Window.partitionBy(src).orderBy(F.desc("link_count"), F.desc("inlinks"), dst)
    return edges.join(counts.select(F.col("media_id").alias(dst), "inlinks"), dst).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= keep).drop("k")
