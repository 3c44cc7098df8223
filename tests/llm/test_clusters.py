import hashlib
import math

import numpy as np

from tidings.llm.clusters import Annulus, cluster_vectors


def brute(rows, k, rounds, size, seed=2):
    kept = [(i, tuple(math.floor(256 * float(a)) for a in v)) for i, v in rows if v is not None and len(v) == size and all(a is not None and math.isfinite(a) for a in v)]
    names = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in names[:k]]
    if not centres:
        return []
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [(nearest(v)[1], v) for _, v in kept]
        for n in range(len(centres)):
            if mine := [v for c, v in own if c == n]:
                centres[n] = tuple(sum(x) // len(mine) for x in zip(*mine))
    done = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in done)
    return sorted((str(i), c, d, sum(e for _, e, f in done if f == c), total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in done)


def run(spark, rows, k, rounds, size):
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<double>, cluster string, v double")
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in cluster_vectors(df.repartition(3), k, rounds, size).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(300)]
    rows += [(400 + i, [0.5, 0.25, 0.0, 0.0]) for i in range(150)]  # a third is one vector
    rows += [(7, rows[7][1]), (7, [9.0, 9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0, -1.0]), (900, None), (901, [1.0]), (902, [1.0, None, 1.0, 1.0]), (903, [math.nan] * 4), (904, [math.inf] * 4), (905, [-0.001] * 4), (906, [300_000.0, -300_000.0, 0.0, 0.0])]
    for k, rounds in ((1, 2), (5, 3), (40, 5)):
        assert run(spark, rows, k, rounds, 4) == brute(rows, k, rounds, 4)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(12)]
    assert run(spark, rows, 12, 3, 2) == brute(rows, 12, 3, 2)


def test_few_and_no_vectors(spark):
    assert run(spark, [], 5, 2, 2) == []
    assert run(spark, [(None, [1.0, 2.0])], 5, 2, 2) == []
    assert run(spark, [(1, [1.0, 2.0])], 5, 2, 2) == brute([(1, [1.0, 2.0])], 5, 2, 2)


def test_annulus_is_exact_and_leaves_out_most():
    rng = np.random.default_rng(8)
    spread = rng.integers(1, 60, 2000)[:, None]
    x = rng.integers(-20, 20, (2000, 8)) + 100 * spread * np.array([1, 0, 0, 0, 0, 0, 0, 0])
    centres = x[rng.choice(2000, 40, replace=False)]
    search = Annulus(centres)
    label, far = search.nearest(x)
    every = ((x[:, None] - centres[None]) ** 2).sum(-1)
    assert (label == every.argmin(1)).all() and (far == every.min(1)).all()
    assert search.compared < 0.25 * every.size


def test_whole_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in cluster_vectors(vectors).collect())
    assert got == brute(rows, 40, 5, 64)
