import numpy as np

from tidings.llm.ann import _sample, nearest_neighbours, usable
from tidings.llm.queries import op2_ann


def brute(ids, x, asked, k=10):
    out = {}
    for i in asked:
        score = np.sqrt(((x - x[ids == i][0]) ** 2).sum(1))
        rest = np.flatnonzero(ids != i)
        best = rest[np.lexsort((ids[rest], score[rest]))[:k]]
        out[i] = [(int(ids[j]), float(score[j])) for j in best]
    return out


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x, ids[ids % 100 == 0])
    got = {}
    for r in op2_ann(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len({a for a, _ in got[i]} & {a for a, _ in want[i]}) / 10 for i in want]) >= 0.9
    for i, found in got.items():
        assert found == sorted(found, key=lambda f: (f[1], f[0]))
        for v, s in found:
            assert abs(s - np.sqrt(((x[ids == v][0] - x[ids == i][0]) ** 2).sum())) < 1e-12


def test_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    same = [float(a) for a in rng.normal(size=8)]
    rows = [(i, same) for i in range(300)] + [(300 + i, [float(a) for a in rng.normal(size=8)]) for i in range(300)]
    bad = [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] + same[1:]), (1300, [None] + same[1:]), (1400, [float("inf")] + same[1:]), (1500, [1.0]), (None, same), (1600, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad + [rows[5]]], "vec_id long, embedding array<double>, score int")
    got = nearest_neighbours(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0, 100, 200, 300, 400, 500}
    for q in (0, 100, 200):
        assert [(r.rank, r.vec_id, r.score) for r in got if r.query_id == q] == [(k + 1, i, 0.0) for k, i in enumerate([i for i in range(11) if i != q][:10])]
    few = df.filter("vec_id in (0, 300, 301)")
    assert [r.vec_id for r in nearest_neighbours(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [r[0] for r in brute(np.array([0, 300, 301]), np.array([same, rows[300][1], rows[301][1]]), [0])[0]]
    assert nearest_neighbours(df.limit(0), df).count() == 0


def test_small_groups_and_outliers(spark):
    rng = np.random.default_rng(2)
    parts = [rng.normal(size=(1500, 16))]
    for size in range(2, 10):
        for _ in range(3):
            parts.append(rng.normal(size=16) * 3 + rng.normal(size=(size, 16)) * 1e-4)
    parts.append(rng.normal(size=(12, 16)) * 40)
    x = np.concatenate(parts)
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest_neighbours(df, df.filter("vec_id >= 1500")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(ids, x, ids[1500:])
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & {a for a, _ in want[i]}) / 10 for i in want]) >= 0.9


def test_lists_cut_into_cells(spark):
    """As on tables so large that lists are cut: cells of 64 rows; a third of all rows are one vector, and a few lie apart."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 16)) * 2
    x = np.concatenate([middles[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)), np.tile(middles[0], (3000, 1)), rng.normal(size=(5, 16)) * 40])
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest_neighbours(df, df.filter("vec_id % 50 = 0 or vec_id >= 9000"), cell=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(ids, x, [i for i in ids if i % 50 == 0 or i >= 9000])
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert all(abs(a[1] - b[1]) < 1e-9 for i in want if 6000 <= i < 9000 for a, b in zip(got[i], want[i]))
    assert np.mean([len({a for a, _ in got[i]} & {a for a, _ in want[i]}) / 10 for i in want if i < 6000 or i >= 9000]) >= 0.9


def test_exact_and_sample(spark):
    """With ``exact`` nothing is missed, whatever the index; the sample of a table with a third of equal rows is of different vectors."""
    rng = np.random.default_rng(6)
    x = np.concatenate([np.zeros((400, 8)) + 0.5, rng.normal(size=(900, 8))])
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    asked = [int(i) for i in ids[::50]]
    got = {}
    for r in nearest_neighbours(df, df.filter("vec_id % 50 = 0"), sample=300, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [a for a, _ in best] for q, best in brute(ids, x, asked).items()}
    rows = usable(df, "vec_id", "embedding")
    sample = _sample(rows, 1300, 300)
    assert 150 <= len(sample) <= 400 and len({tuple(v) for v in sample}) == len(sample)
    assert len(_sample(rows.filter("vec_id < 400"), 400_000_000, 300)) == 1
