import math
import random
import zlib

import numpy as np

from tidings.llm.toxicity import FEATURES, held_out, score, train


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = train(docs, labels)
    scored = score(docs, model)
    assert scored.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "text"] or set(docs.columns) < set(scored.columns)
    rows = scored.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    rows = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (None, "x", 1.0), (2, "", 2.0), (2, "word " * 30_000, 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = score(docs, train(docs, none)).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5}
    labels = spark.createDataFrame([(2, 1), (2, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    assert score(docs, train(docs, labels)).count() == 4
    assert score(docs.limit(0), train(docs.limit(0), labels)).count() == 0
    assert docs.select(held_out("doc_id").alias("h")).filter("h is null").count() == 0


def bucket(gram):
    h = 0
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) % 2**64
    return ((h ^ len(gram)) * 0x9E3779B97F4A7C15 % 2**64) >> 44


def plain_scores(train_rows, texts):
    """The same classifier with sets and loops: presence of 5- and 7-grams, log-count ratios, a ridge regression by Newton steps."""

    def grams(text):
        t = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        return {bucket(t[i : i + n]) for n in (5, 7) for i in range(len(t) - n + 1)}

    sets, y = [grams(t) for t, _ in train_rows], np.array([c for _, c in train_rows], float)
    n1 = y.sum()
    n0 = len(y) - n1
    seen = {}
    for own, c in zip(sets, y):
        for g in own:
            seen.setdefault(g, [0, 0])[int(c)] += 1
    share = lambda g, c: (seen[g][c] + 1) / ((n0, n1)[c] + 2)

    def distance(g):
        if sum(seen[g]) < 3:
            return 0.0
        p = (sum(seen[g]) + 1) / (len(y) + 2)
        return abs(share(g, 1) - share(g, 0)) / math.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))

    best = sorted((g for g in seen if distance(g) > 0), key=lambda g: (-distance(g), g))
    assert len(best) < FEATURES
    scale = np.array([math.log(share(g, 1) / share(g, 0)) for g in best])
    matrix = lambda rows: np.array([[g in own for g in best] for own in rows], float) * scale
    x = matrix(sets)
    norm = math.sqrt((x**2).sum(1).max() + 1)
    x1, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(len(best) + 1)
    ridge = np.append(np.full(len(best), 0.01 / norm), 1e-12)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x1 @ w)))
        w = w - np.linalg.solve((x1 * (p * (1 - p) / len(y))[:, None]).T @ x1 + np.diag(ridge), x1.T @ (p - y) / len(y) + ridge * w)
    return 1 / (1 + np.exp(-(np.hstack([matrix([grams(t) for t in texts]), np.ones((len(texts), 1))]) @ w)))


def test_against_plain_version(spark):
    rng = random.Random(3)
    good, bad = "bread milk table window".split(), "grokk snarl vexxo".split()
    rows = []
    for i in range(120):
        toxic = i % 3 == 0
        own = [rng.choice(good) for _ in range(rng.randint(1, 4))] + [rng.choice(bad) for _ in range(2 * toxic + (rng.random() < 0.1))]
        rng.shuffle(own)
        rows.append((i, " ".join(own).title() if i % 2 else ", ".join(own), int(toxic)))
    rows += [(200, "", 0), (201, None, 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, c) for i, _, c in rows if i < 200], "doc_id long, toxic int")
    out = {r.doc_id: r for r in score(docs, train(docs, labels)).collect()}
    known = [(t, c) for i, t, c in rows if i < 200 and zlib.crc32(str(i).encode()) % 5]
    for (i, _, _), want in zip(rows, plain_scores(known, [t for _, t, _ in rows])):
        assert abs(out[i].score - want) < 0.05 and (abs(want - 0.5) < 0.05 or out[i].predicted == (want >= 0.5))
