"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a balanced clustering of a bounded sample and are searched through
an in-memory neighbour graph. Every vector goes to the list of its nearest centroid; one
near a border is copied to several lists. A query reads the nearest lists until they are
known to hold k other ids, and those whose centroids are within a distance ratio of the
last of these. Where a table is so large that a list has more than CELL rows, the list is
cut into cells by centroids of its own, and a query reads the cells near it by the same
rule; so the number of rows that a query meets does not grow with the table. Cells and
their queries are dealt into parts of bounded size, so one that holds a third of all
vectors is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.common import add_columns
from tidings.operators.storage import materialize

#: The clustering is fitted on some so many different vectors, those whose hash is under a threshold that follows from the number of rows.
SAMPLE = 20_000
#: Vectors of the sample in a cluster at most; so there are some SAMPLE / LIST lists whatever the table's size.
LIST = 24
#: Copies of a vector at most, and how much farther than the nearest a centroid of a copy may be.
COPIES, COPY_RATIO = 6, 1.15
#: Lists that a query reads at most, once they hold enough ids, and how much farther a centroid may be than the last that is needed.
PROBES, PROBE_RATIO = 128, 1.6
#: Neighbours of a centroid in the graph; candidates kept in its search at least.
DEGREE, BEAM = 24, 16
#: Rows of a cell, as far as its list's sample tells; vectors of a list that its cells are fitted on, about.
CELL, CELL_SAMPLE = 4096, 8192
#: Cells of a list that a query reads at most, once they hold enough ids.
CELLS = 16
#: Vectors and queries that one task call compares.
PART, BLOCK = 4096, 1024


def _split(x: np.ndarray, rng: np.random.Generator, ways: int = 8) -> np.ndarray:
    """Labels of a few rounds of k-means; no cluster gets more than twice its even share."""
    centre = x[rng.choice(len(x), ways, replace=False)]
    most = -(-2 * len(x) // ways)
    for _ in range(8):
        far = ((x[:, None, :] - centre[None]) ** 2).sum(-1)
        order, label, room = np.argsort(far.min(axis=1), kind="stable"), np.empty(len(x), np.int64), np.full(ways, most)
        for i in order:
            for c in np.argsort(far[i], kind="stable"):
                if room[c]:
                    label[i], room[c] = c, room[c] - 1
                    break
        for c in range(ways):
            if (label == c).any():
                centre[c] = x[label == c].mean(axis=0)
    return label


def fit_centroids(x: np.ndarray, size: int = LIST) -> np.ndarray:
    """Centroids of clusters of at most ``size`` vectors; equal vectors count once."""
    x, rng, out = np.unique(x, axis=0), np.random.default_rng(3), []
    todo = [x]
    while todo:
        part = todo.pop()
        if len(part) <= size:
            out.append(part.mean(axis=0))
            continue
        label = _split(part, rng, int(min(8, max(2, -(-len(part) // size)))))
        todo += [part[label == c] for c in np.unique(label)]
    return np.array(out)


class Graph:
    """Each centroid with its nearest ones and a few far ones; a beam search walks it."""

    def __init__(self, centroids: np.ndarray):
        self.x = centroids
        n, rng = len(centroids), np.random.default_rng(7)
        near = min(DEGREE, n - 1)
        links = np.empty((n, near + min(4, n)), np.int64)
        norm = (centroids**2).sum(1)
        for at in range(0, n, 512):
            far = norm[at : at + 512, None] + norm[None] - 2 * centroids[at : at + 512] @ centroids.T
            far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
            if near:
                links[at : at + 512, :near] = np.argpartition(far, near - 1, axis=1)[:, :near]
        links[:, near:] = rng.integers(0, n, (n, links.shape[1] - near))
        self.links, self.entries = links, np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def nearest(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each query the centroids found, nearest first, and their distances (inf pads)."""
        rows, width = len(q), min(beam, len(self.x))

        def measure(ids: np.ndarray) -> np.ndarray:
            return ((self.x[ids] - q[:, None, :]) ** 2).sum(-1)

        ids = np.broadcast_to(self.entries, (rows, len(self.entries)))
        far = measure(ids)
        done = np.zeros(ids.shape, bool)
        while True:
            open_far = np.where(done, np.inf, far)
            take = np.argsort(open_far, axis=1, kind="stable")[:, :4]
            best = np.take_along_axis(open_far, take, 1)
            if not np.isfinite(best).any():
                break
            done = done.copy()
            np.put_along_axis(done, take, True, 1)
            fresh = self.links[np.take_along_axis(ids, take, 1)].reshape(rows, -1)
            fresh_far = np.where(np.repeat(np.isfinite(best), self.links.shape[1], axis=1), measure(fresh), np.inf)
            all_ids, all_far = np.concatenate([ids, fresh], 1), np.concatenate([far, fresh_far], 1)
            all_done = np.concatenate([done, np.zeros(fresh.shape, bool)], 1)
            order = np.lexsort((~all_done, all_ids), axis=1)
            all_ids, all_far, all_done = (np.take_along_axis(a, order, 1) for a in (all_ids, all_far, all_done))
            twice = np.zeros(all_ids.shape, bool)
            twice[:, 1:] = all_ids[:, 1:] == all_ids[:, :-1]
            all_far = np.where(twice, np.inf, all_far)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            ids, far, done = (np.take_along_axis(a, order, 1) for a in (all_ids, all_far, all_done))
            done = done | ~np.isfinite(far)
        return ids, np.sqrt(far)


def _lists(graph: Graph, x: np.ndarray) -> list[list[int]]:
    """Lists that hold each vector: centroids within the ratio, none of them nearer to one chosen before than to the vector."""
    out = []
    ids, far = graph.nearest(x, max(BEAM, COPIES))
    for own, d in zip(ids, far):
        keep: list[int] = []
        for c, dist in zip(own.tolist(), d.tolist()):
            if len(keep) == COPIES or dist > COPY_RATIO * d[0] + 1e-12:
                break
            if keep and ((graph.x[keep] - graph.x[c]) ** 2).sum(-1).min() < (dist * 0.5) ** 2:
                continue
            keep.append(c)
        out.append(keep)
    return out


def _probes(graph: Graph, held: np.ndarray, x: np.ndarray, k: int) -> list[list[int]]:
    """Lists that each query reads. ``held``: ids that a list is known to hold, each counted in one list only."""
    out = []
    ids, far = graph.nearest(x, max(BEAM, PROBES))
    for q, own, d in zip(x, ids, far):
        own, d = own[np.isfinite(d)], d[np.isfinite(d)]
        if held[own].sum() <= k:  # what the search has found holds too few
            far_all = np.sqrt(((graph.x - q) ** 2).sum(-1))
            own = np.argsort(far_all, kind="stable")
            d = far_all[own]
        out.append(own[: _enough(held[own], d, k, PROBES)].tolist())
    return out


def _enough(held: np.ndarray, far: np.ndarray, k: int, most: int) -> int:
    """How many of the places at distances ``far``, nearest first, a query reads: until they hold k + 1 ids, then by ratio."""
    # one more than k, as the query's own id may be among them
    last = min(int(np.searchsorted(np.cumsum(held), k + 1)), len(far) - 1)
    return int(np.searchsorted(far[: max(most, last + 1)], PROBE_RATIO * far[last] + 1e-12, side="right"))


def _far_cells(x: np.ndarray, centres: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each vector the cells, nearest first, and their distances."""
    norm = (centres**2).sum(1)
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        far = np.sqrt(np.maximum(0, norm - 2 * part @ centres.T + (part**2).sum(1)[:, None]))
        yield from ((o := np.argsort(f, kind="stable"), f[o]) for f in far)


def _fit_cells(index: DataFrame, wide: DataFrame, cell: int) -> DataFrame:
    """``list, cell, centre``: centroids of the lists in ``wide`` (``list, rows``), from a sample of each by hash; equal vectors count once."""
    share = F.least(F.lit(1.0), F.lit(CELL_SAMPLE) / F.col("rows"))
    sample = index.join(F.broadcast(wide), "list").filter(F.pmod(F.xxhash64(F.lit(11), "v"), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        size = max(4, int(cell * min(1.0, CELL_SAMPLE / rows["rows"].iloc[0])))
        centres = fit_centroids(np.stack(rows.v.to_numpy()), size)
        return pd.DataFrame({"list": rows["list"].iloc[0], "cell": np.arange(len(centres), dtype=np.int32), "centre": list(centres)})

    return sample.select("list", "rows", "v").distinct().groupBy("list").applyInPandas(fit, "list int, cell int, centre array<double>")


def _deal(rows: DataFrame, cells: DataFrame, slices: DataFrame, id_col: str, vector: str, choose: Callable) -> DataFrame:
    """Rows of lists that have cells, with each ``cell`` that ``choose(cells, distances, held)`` takes and its place ``near`` in that order."""
    schema = f"list int, {id_col} long, {vector} array<double>, cell int, near int"
    left = rows.join(slices, "list").withColumn("slice", F.pmod(F.xxhash64(id_col, vector), F.col("slices"))).select("list", "slice", id_col, vector)
    right = cells.join(slices, "list").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).select("list", "slice", "cell", "centre", "held")

    def per_slice(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"list": [], id_col: [], vector: [], "cell": [], "near": []}).astype({"list": "int32", id_col: "int64", "cell": "int32", "near": "int32"})
        held = b.held.to_numpy()
        taken = [o[: choose(held[o], far)] for o, far in _far_cells(np.stack(a[vector].to_numpy()), np.stack(b.centre.to_numpy()))]
        many = [len(t) for t in taken]
        out = a.iloc[np.repeat(np.arange(len(a)), many)][["list", id_col, vector]].reset_index(drop=True)
        return out.assign(cell=b.cell.to_numpy()[np.concatenate(taken)], near=np.concatenate([np.arange(n, dtype=np.int32) for n in many]))

    keys = ["list", "slice"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(per_slice, schema)


def _in_cells(index: DataFrame, probes: DataFrame, k: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with a ``cell``: of lists of at most ``cell`` rows it is 0, of others one or two for a vector and some for a query."""
    # one row for each list: as many as there are centroids
    sizes = materialize(index.groupBy("list").agg(F.count("*").alias("rows")).join(probes.groupBy("list").agg(F.count("*").alias("asked")), "list"), "sizes")
    wide, whole = sizes.filter(F.col("rows") > cell), F.lit(0).alias("cell")
    rows, asked = index.select("list", "vec_id", "v"), probes.select("list", "query_id", "q")
    if wide.isEmpty():
        return rows.select("*", whole), asked.select("*", whole)
    cells = materialize(_fit_cells(index, wide.select("list", "rows"), cell), "cells")
    # a list without any vector in its sample stays whole
    cut = F.broadcast(materialize(wide.join(cells.select("list").distinct(), "list"), "cut"))
    slices = lambda n: cut.select("list", F.ceil(F.col(n) / PART).cast("long").alias("slices"))
    inner = materialize(_deal(rows, cells.withColumn("held", F.lit(0).cast("long")), slices("rows"), "vec_id", "v", lambda held, far: 1 + int(len(far) > 1 and far[1] <= COPY_RATIO * far[0])), "cell_rows")
    held = inner.filter("near = 0").groupBy("list", "vec_id").agg(F.min("cell").alias("cell")).groupBy("list", "cell").agg(F.count("*").alias("held"))
    held = cells.join(held, ["list", "cell"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    read = materialize(_deal(asked, held, slices("asked"), "query_id", "q", lambda held, far: _enough(held, far, k, CELLS)), "cell_probes")
    outer = lambda df: df.join(cut.select("list"), "list", "left_anti").select("*", whole)
    return outer(rows).unionByName(inner.drop("near")), outer(asked).unionByName(read.drop("near"))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: rows with an id and a vector of finite numbers that are not all zero."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists(v, lambda a: a != 0)
    return vectors.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _sample(rows: DataFrame, total: int, size: int) -> list[np.ndarray]:
    """Some ``size`` different vectors by a hash threshold, in the order of their hashes; no task gathers more than its part of them."""
    place, share = F.pmod(F.xxhash64("v"), F.lit(1 << 40)), min(1.0, size / total)
    while True:
        found = rows.select(place.alias("place"), "v").filter(F.col("place") < F.lit(int(share * (1 << 40)))).distinct().toLocalIterator()
        if out := [np.array(r.v) for r in sorted(found, key=lambda r: (r.place, r.v))]:
            return out
        share = min(1.0, 16 * share)  # few different vectors, none of them under the threshold


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL, sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors found for each query, its own id excepted.

    The score is the Euclidean distance in double precision; ties go to the smaller id. Vectors that are
    null, empty, all zero, or hold a null or non-finite component take no part, nor do those of another
    length than most of the sample have. Rows that repeat an id count as one candidate, the nearest. With
    fewer candidates all are returned; an empty table gives an empty one. Other columns are not read.
    ``cell``: rows of a list beyond which it is cut into cells. ``sample``: vectors that the index is fitted on,
    about. ``exact``: every query reads every list, whole, so nothing is missed.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    fitted = _sample(rows, total, sample)
    lengths = [len(v) for v in fitted]
    size = max(sorted(set(lengths)), key=lengths.count)
    graph = Graph(fit_centroids(np.array([v for v in fitted if len(v) == size])))
    shared = spark.sparkContext.broadcast(graph)
    rows, asked = rows.filter(F.size("v") == size), asked.filter(F.size("v") == size)

    def placed(batch: list) -> dict:
        return {"lists": _lists(shared.value, np.array(batch))}

    index = materialize(add_columns(rows, ["v"], placed, "lists array<int>", 256).select("vec_id", "v", F.posexplode("lists").alias("place", "list")), "postings")
    held = np.zeros(len(graph.x), np.int64)
    for r in index.filter("place = 0").groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().collect():
        held[r["list"]] = r["count"]

    def probed(batch: list) -> dict:
        return {"lists": [list(range(len(held)))] * len(batch) if exact else _probes(shared.value, held, np.array(batch), k)}

    probes = materialize(add_columns(asked, ["v"], probed, "lists array<int>", 256).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode("lists").alias("list")), "probes")
    rows, asked = _in_cells(index, probes, k, 1 << 62 if exact else cell)
    sizes = rows.groupBy("list", "cell").count().join(asked.groupBy("list", "cell").agg(F.count("*").alias("asked")), ["list", "cell"])
    sizes = materialize(sizes.select("list", "cell", F.ceil(F.col("count") / PART).cast("long").alias("parts"), F.ceil(F.col("asked") / BLOCK).cast("long").alias("blocks")), "sizes")
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.join(sizes, ["list", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).withColumn("block", up_to("blocks"))
    right = asked.join(sizes, ["list", "cell"]).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).withColumn("part", up_to("parts"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        x, ids, q = np.stack(a.v.to_numpy()), a.vec_id.to_numpy(), np.stack(b.q.to_numpy())
        norm, out = (x**2).sum(1), []
        names, of = np.unique(ids, return_inverse=True)
        for query, vector in zip(b.query_id.to_numpy(), q):
            rough = norm - 2 * (x @ vector)
            rough[ids == query] = np.inf
            if len(names) > k:
                # rounding may not part what ties, so all within it of the k-th id are measured exactly
                each = rough
                if len(names) < len(ids):
                    each = np.full(len(names), np.inf)
                    np.minimum.at(each, of, rough)
                bar = np.partition(each, k - 1)[k - 1]
                near = np.flatnonzero(rough <= bar + 1e-9 * (1 + norm.max() + vector @ vector))
            else:
                near = np.arange(len(rough))
            near = near[ids[near] != query]
            score = np.sqrt(((x[near] - vector) ** 2).sum(1))
            best = np.lexsort((ids[near], score))
            best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])[:k]]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near][best], "score": score[best]}))
        return pd.concat(out)

    keys = ["list", "cell", "part", "block"]
    found = left.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(right.select(*keys, "query_id", "q").groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
