"""Centroid clustering in whole numbers by annulus search.

Centroids are sorted by norm. A vector's distance to those next to it by norm bounds its distance to
the nearest one from above; by the triangle inequality only centroids whose norm differs from the
vector's by no more than that bound can be as near. These are a stretch of the sorted norms, found by
binary search, and only they are compared, exactly. Each round reads the vectors once; a task sums its
own vectors for each centroid, so what is shuffled does not grow with a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import add_columns
from tidings.operators.storage import materialize

#: A component becomes floor(SCALE * x).
SCALE = 256
#: Components beyond this would not leave the squared distance in 64 bits.
LARGEST = 1 << 27
#: Rows of a batch that are compared at once.
ROWS = 2048


def kept_vectors(vectors: DataFrame, size: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v array<int>``: the vectors of ``size`` finite components, scaled and floored."""
    v = F.col(vector_col).cast("array<double>")
    fits = F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) <= F.lit(LARGEST / SCALE)))
    good = v.isNotNull() & (F.size(v) == size) & fits
    return vectors.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda a: F.floor(a * SCALE).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, total: int, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes of ``seed:id``, in that order.

    Only those below a hash threshold are sorted, some ten times ``k`` at any size of the table; the
    threshold is raised until enough are found, so no vector is overlooked.
    """
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    named = rows.filter("vec_id IS NOT NULL").withColumn("name", name)
    share = min(1.0, 10 * k / max(1, total))
    while True:
        below = F.conv(F.substring("name", 1, 12), 16, 10).cast("long") < F.lit(int(share * (1 << 48)))
        found = named.filter(below).orderBy("name", "v").limit(k).collect()
        if len(found) == k or share >= 1:
            return np.array([r.v for r in found], dtype=np.int64)
        share = min(1.0, 4 * share)


class Annulus:
    """Exact nearest centroids; ``compared`` counts the distances computed so far."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids**2).sum(1).astype(float))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.x, self.compared = norms[self.number], centroids[self.number], 0

    def _distance(self, rows: np.ndarray, places: np.ndarray | int) -> np.ndarray:
        self.compared += len(rows)
        return ((rows - self.x[places]) ** 2).sum(1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each row's nearest centroid (the smaller of ties) and its squared distance."""
        norm = np.sqrt((rows**2).sum(1).astype(float))
        at = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        bound = np.minimum(self._distance(rows, at), self._distance(rows, np.maximum(at - 1, 0)))
        # a little wider than the annulus, so that rounding leaves out none on its border
        reach = np.sqrt(bound.astype(float)) * (1 + 1e-9) + 1e-9 * (norm + 1)
        low, high = np.searchsorted(self.norms, norm - reach, side="left"), np.searchsorted(self.norms, norm + reach, side="right")
        best, label = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), len(self.norms), dtype=np.int64)
        for place, number in enumerate(self.number):
            inside = np.flatnonzero((low <= place) & (place < high))
            if len(inside):
                far = self._distance(rows[inside], place)
                nearer = (far < best[inside]) | ((far == best[inside]) & (number < label[inside]))
                best[inside[nearer]], label[inside[nearer]] = far[nearer], number
        return label, best


def _sums(rows: DataFrame, search: Annulus, size: int) -> DataFrame:
    """``cluster, n, sums array<long>`` of each task's vectors."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    shared = rows.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shared.value.number)
        total, many = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = batch.column(0).slice(at, ROWS).flatten().to_numpy().reshape(-1, size).astype(np.int64)
                label, _ = shared.value.nearest(x)
                np.add.at(total, label, x)
                many += np.bincount(label, minlength=k)
        held = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(many[held]), pa.array(list(total[held]), pa.list_(pa.int64()))], schema=schema)

    return rows.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")


def fit(rows: DataFrame, total: int, k: int, rounds: int, size: int, seed: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds; what comes to the driver is one number for each component of a centroid."""
    centroids = first_centroids(rows, total, k, seed)
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    for _ in range(rounds if len(centroids) else 0):
        parts = _sums(rows, Annulus(centroids), size).select("cluster", "n", F.posexplode("sums").alias("dim", "total"))
        for r in parts.groupBy("cluster", "dim").agg(exact("n"), exact("total")).collect():
            centroids[r.cluster, r.dim] = int(r.total) // int(r.n)
    return centroids


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256`` for each kept vector.

    Kept are vectors of ``size`` components, none of them null, not finite, or so large (beyond 2**27 when
    scaled) that a squared distance might leave 64 bits. All else is exact in whole numbers; ties go to the
    smaller number. Rows are vectors one by one: repeated rows and ids count each, and a row without an id is
    assigned and counted but is no first centroid; of rows that repeat an id the lesser vector comes first.
    With fewer than ``k`` rows with ids there are so many centroids; without any (an empty table) no rows
    are returned. A sum of distances beyond 64 bits is null. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = materialize(kept_vectors(vectors, size, id_col, vector_col), "vectors")
    centroids = fit(rows, rows._tidings_seen.get["rows"], k, rounds, size, seed)
    schema = "cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id long, {schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    shared = spark.sparkContext.broadcast(Annulus(centroids))

    def assigned(batch: list) -> dict:
        label, far = shared.value.nearest(np.array(batch, dtype=np.int64))
        return {"cluster": label, "distance": far}

    done = materialize(add_columns(rows, ["v"], assigned, schema, ROWS, drop=["v"]), "assigned")
    sums = {r.cluster: int(r.total) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = sum(sums.values())
    fits = lambda n: n if n < 1 << 63 else None
    # one row for each centroid
    facts = [(c, fits(n), fits(whole), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in sums.items()]
    return done.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
