"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of lower-cased letters and spaces, present or absent. Each is
scaled by r = log of the ratio of its smoothed document shares in the two classes
(Wang and Manning 2012), and a logistic regression is fitted on the scaled features.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import _forget_others, add_columns, texts
from tidings.operators.storage import materialize

#: The classifier is fitted on some so many labelled rows, those whose ids have a hash under a threshold; on all, if there are fewer.
SAMPLE = 16_000
#: Lengths of the n-grams, hash buckets of all n-grams, and how many of them become features.
SIZES, BUCKETS, FEATURES = (5, 7), 1 << 20, 1536
#: Tasks that count the sample: each sends one pair of count arrays.
COUNTERS = 6
#: Every HELD_OUT-th id by crc32 is never learnt from.
HELD_OUT = 5


#: What every code point below 0x250 becomes in an n-gram: letters stay, all else is a space.
_LETTERS = np.array([c if chr(c).isalpha() else 32 for c in range(0x250)], np.uint64)


def _grams(batch: list[str], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``document, bucket`` pairs; with a ``table`` from buckets to features, ``document, feature`` of those it has."""
    raw = [f" {t.lower()} ".encode("utf-32-le") for t in batch]
    ends = np.cumsum([len(r) // 4 for r in raw])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64)
    small = data < len(_LETTERS)
    data[small] = _LETTERS[data[small]]
    found: list[list[np.ndarray]] = [[] for _ in batch]
    h = np.zeros(len(data), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :]
        if n not in SIZES:
            continue
        bucket = ((h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int32)
        if table is not None:
            bucket = table[bucket]
        for own, a, b in zip(found, starts, ends - n + 1):
            if a < b:
                own.append(bucket[a:b] if table is None else (part := bucket[a:b])[part >= 0])
    found = [np.unique(np.concatenate(own)) if own else np.empty(0, np.int32) for own in found]
    return np.repeat(np.arange(len(batch)), [len(x) for x in found]), np.concatenate(found) if found else np.empty(0, np.int32)


def held_out(doc_id) -> F.Column:
    """Whether an id is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % HELD_OUT == 0, F.lit(False))


class Model:
    """``table`` from buckets to features (-1: none), a weight for each feature, and a bias."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: float):
        self.table, self.weights, self.bias = table, weights, bias
        #: False where there was no example of one of the classes.
        self.learnt = bool((table >= 0).any())

    def scores(self, batch: list[str]) -> np.ndarray:
        doc, feature = _grams(batch, self.table)
        total = self.bias + np.bincount(doc, weights=self.weights[feature], minlength=len(batch))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _regression(row: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 120) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps."""
    n, value = len(y), scale[col]
    weights, bias = np.zeros(len(scale)), np.log((y.sum() + 1) / (n - y.sum() + 1))
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=n).max() + 1)
    rate, ahead, t = 1.0, (weights, bias), 1.0

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        z = b + np.bincount(row, weights=w[col] * value, minlength=n)
        return float(np.logaddexp(0, np.where(y > 0, -z, z)).mean() + ridge / 2 * (w @ w) / norm), z

    for _ in range(steps):
        at, z = loss(*ahead)
        error = (1 / (1 + np.exp(-z)) - y) / n
        grad, grad_b = np.bincount(col, weights=error[row] * value, minlength=len(scale)) + ridge / norm * ahead[0], error.sum()
        while True:
            w, b = ahead[0] - rate * grad, ahead[1] - rate * grad_b
            if rate < 1e-8 or loss(w, b)[0] <= at - rate / 2 * (grad @ grad + grad_b**2):
                break
            rate /= 2
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / t_next
        ahead = w + pull * (w - weights), b + pull * (b - bias)
        weights, bias, t = w, b, t_next
        rate *= 1.3
    return weights * scale, float(bias)


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled documents that are not held out.

    Rows with a null id or label are no examples; an id labelled twice counts by its larger label. An id
    that names several texts gives several examples. With no example of one of the classes every score is
    that of the class shares; so it is with empty tables. Other columns are not read.
    """
    spark = df.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    chosen = known.filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = chosen.count()
    if total > sample:  # the threshold follows from their number, so no task has to rank them
        chosen = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(sample / total * (1 << 40)))
    # some ``sample`` rows of twelve bytes: small enough to broadcast at any size of the corpus
    examples = texts(df, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    examples = materialize(examples.repartition(COUNTERS), "examples")

    def count(batches):
        import pyarrow as pa

        _forget_others(None)
        seen, n = np.zeros((2, BUCKETS), np.uint32), [0, 0]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                toxic = np.array(part.column(1).to_pylist())
                doc, bucket = _grams(part.column(0).to_pylist())
                for c in (0, 1):
                    seen[c] += np.bincount(bucket[toxic[doc] == c], minlength=BUCKETS).astype(np.uint32)
                    n[c] += int((toxic == c).sum())
        yield pa.RecordBatch.from_pydict({"n0": [n[0]], "n1": [n[1]], "seen": [np.minimum(seen, 65535).astype("<u2").tobytes()]})

    total, sizes = np.zeros((2, BUCKETS)), np.zeros(2)
    for r in examples.mapInArrow(count, "n0 long, n1 long, seen binary").toLocalIterator():
        total += np.frombuffer(bytes(r.seen), "<u2").reshape(2, BUCKETS)
        sizes += r.n0, r.n1
    if not sizes.all():
        return Model(np.full(BUCKETS, -1, np.int32), np.zeros(FEATURES), float(np.log((sizes[1] + 1) / (sizes[0] + 1))))
    share = (total + 1) / (sizes[:, None] + 2)
    ratio = np.log(share[1] / share[0])
    pooled = (total.sum(axis=0) + 1) / (sizes.sum() + 2)
    distance = np.abs(share[1] - share[0]) / np.sqrt(pooled * (1 - pooled) * (1 / sizes).sum())
    distance[total.sum(axis=0) < 3] = 0
    best = np.argsort(-distance, kind="stable")[:FEATURES]
    table = np.full(BUCKETS, -1, np.int32)
    table[best] = np.arange(len(best), dtype=np.int32)
    shared = spark.sparkContext.broadcast(table)

    def featured(batch: list) -> dict:
        doc, feature = _grams(batch, shared.value)
        cuts = np.searchsorted(doc, np.arange(len(batch) + 1))
        return {"features": [feature[a:b].astype("<u2").tobytes() for a, b in zip(cuts, cuts[1:])]}

    rows = add_columns(examples, ["text"], featured, "features binary").select("features", "toxic")
    y, cols = [], []
    for r in rows.toLocalIterator():
        y.append(r.toxic)
        cols.append(np.frombuffer(bytes(r.features), "<u2"))
    row = np.repeat(np.arange(len(y)), [len(c) for c in cols])
    weights, bias = _regression(row, np.concatenate(cols).astype(np.int64), ratio[best], np.array(y, float))
    return Model(table, weights, bias)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns and ``held_out, score, predicted`` (columns of these names are replaced).

    Whole texts of any length are scored, a slice of bounded bytes at a time; only the text goes into a
    score. A null text counts as empty and gets the score of the bias. Null and repeated ids are kept as they are; an empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.table, model.weights, model.bias))

    def per_batch(batch: list) -> dict:
        scores = Model(*shared.value).scores([t or "" for t in batch])
        return {"score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

    return add_columns(df, [text_col], per_batch, "score double, predicted int", 256).withColumn("held_out", held_out(id_col))
