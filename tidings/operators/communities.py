"""Communities of a weighted graph by modularity: local moves of nodes, then the communities become nodes, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.operators.storage import discard, materialize

#: Fixed value: weight of the expected links in the modularity; the more, the smaller the communities.
RESOLUTION = 1.5
#: Rounds of moves on a level at most, and how many may pass without a better modularity.
ROUNDS, PATIENCE = 30, 4


def both_ways(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """``a, b, w`` of an undirected graph, each link in both directions; a loop counts twice for its node."""
    rows = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.col(weight).cast("double").alias("w")).filter("a is not null and b is not null and w > 0")
    return rows.union(rows.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity(both: DataFrame, labels: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """``community, inside, total, part``: of each community the weight inside, that of its nodes' links, and its part of the modularity.

    ``both`` as by ``both_ways``; ``labels``: node, community. The parts add up to the modularity.
    """
    a = labels.select(F.col("node").alias("a"), F.col("community").alias("community"))
    b = labels.select(F.col("node").alias("b"), F.col("community").alias("other"))
    rows = both.join(a, "a").join(b, "b").groupBy("community").agg(F.sum(F.when(F.col("community") == F.col("other"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("total"))
    whole = F.broadcast(both.agg(F.sum("w").alias("whole")))
    share = F.col("total") / F.col("whole")
    return rows.crossJoin(whole).select("community", "inside", "total", (F.col("inside") / F.col("whole") - F.lit(resolution) * share * share).alias("part"))


def _moved(both: DataFrame, labels: DataFrame, whole: float, turn: int, resolution: float) -> DataFrame:
    """``node, community, k, wants``: each node's best community by gain; half of the nodes, by a hash of the turn, go there.

    If all went at once, neighbours would swap places for ever. Joins are by node and by community; a community
    of very many nodes is one row there, and the rows that meet it are split by AQE.
    """
    to = labels.select(F.col("node").alias("b"), F.col("community"))
    votes = both.filter("a <> b").join(to, "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("w"))
    stay = labels.select("node", "community", F.lit(0.0).alias("w"))
    votes = votes.union(stay).groupBy("node", "community").agg(F.sum("w").alias("w"))
    totals = labels.groupBy("community").agg(F.sum("k").alias("total"))
    own = labels.select("node", "k", F.col("community").alias("own"))
    here = F.col("community") == F.col("own")
    others = F.col("total") - F.when(here, F.col("k")).otherwise(0.0)
    # equal gains: stay, else the smaller community
    gain = F.round(F.col("w") - F.lit(resolution) * F.col("k") * others / F.lit(whole), 9)
    rows = votes.join(own, "node").join(totals, "community").withColumn("gain", gain)
    best = rows.groupBy("node").agg(F.first("k").alias("k"), F.first("own").alias("own"), F.min_by("community", F.struct(-F.col("gain"), ~here, F.col("community"))).alias("best"))
    wants = F.col("best") != F.col("own")
    goes = wants & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)
    return best.select("node", F.when(goes, F.col("best")).otherwise(F.col("own")).alias("community"), "k", wants.alias("wants"))


def _level(both: DataFrame, resolution: float) -> tuple[DataFrame, float, bool]:
    """Labels of the best modularity found on this level, that modularity, and whether any node has moved."""
    degrees = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    labels = materialize(degrees.select("node", F.col("node").alias("community"), "k", F.lit(True).alias("wants")), "labels")
    whole = labels.agg(F.sum("k")).first()[0]
    value = lambda x: modularity(both, x, resolution).agg(F.sum("part")).first()[0]
    best, best_value, changed, waited = labels, value(labels), False, 0
    for turn in range(ROUNDS):
        labels = materialize(_moved(both, labels, whole, turn, resolution), "labels")
        if labels.filter("wants").isEmpty():
            break
        now = value(labels)
        waited += 1
        if now > best_value + 1e-12:
            discard(best)
            best, best_value, changed, waited = labels, now, True, 0
        if waited > PATIENCE:
            break
    return best, best_value, changed


def louvain(edges: DataFrame, src: str, dst: str, weight: str, resolution: float = RESOLUTION) -> DataFrame:
    """``node, community``: communities of high modularity, each named by its least node.

    Links count in both directions together; null ends and links without a weight take no part. Each level is a
    graph of the communities before, so it only shrinks; the driver sees sums. The result does not depend on how
    rows are dealt, but for the order in which weights are added.
    """
    both = materialize(both_ways(edges, src, dst, weight), "graph")
    if both.isEmpty():
        node = edges.select(F.col(src).alias("node"))
        return node.limit(0).select("node", F.col("node").alias("community"))
    members, value = None, None
    while True:
        labels, now, changed = _level(both, resolution)
        if not changed or value is not None and now <= value + 1e-12:
            break
        value = now
        step = labels.select("node", "community")
        members = step if members is None else members.withColumnRenamed("community", "up").join(step.withColumnRenamed("node", "up"), "up").select("node", "community")
        members = materialize(members, "members")
        a, b = (step.select(F.col("node").alias(c), F.col("community").alias(f"c{c}")) for c in "ab")
        coarse = both.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w"))
        coarse = materialize(coarse, "graph")
        discard(both)
        both = coarse
    if members is None:
        return both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    least = members.groupBy("community").agg(F.min("node").alias("least"))
    return members.join(least, "community").select("node", F.col("least").alias("community"))
