"""Words of texts in scripts without spaces: a lattice of dictionary words, and its likeliest path.

The dictionary is learnt from the corpus: strings whose characters stand together more often than chance
and whose neighbours vary. A text's likeliest words are found by Viterbi; a few rounds of cutting the corpus
and counting its words again settle the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import LOGOGRAMS
from tidings.operators.storage import materialize

#: Characters of a run that is cut.
RUN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー々]"
#: Longest word; words of a dictionary at most, the commonest first; times that a word occurs at least.
LONGEST, MOST, LEAST = 4, 200_000, 5
#: How much likelier than by chance the parts of a word stand together, and share of its places that one neighbour may have.
COHESION, NEIGHBOUR = 20.0, 0.9
#: Rounds of cutting and counting.
ROUNDS = 2
_OTHER = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'’-]*[\p{L}\p{N}_])?"


class Dictionary(NamedTuple):
    scores: dict[str, float]  #: log probabilities
    longest: int
    unknown: float  #: of a character that the dictionary lacks


def dictionary(counts: dict[str, int]) -> Dictionary:
    total = sum(counts.values()) or 1
    return Dictionary({w: log(n / total) for w, n in counts.items()}, max(map(len, counts), default=1), log(0.1 / total))


def best_path(run: str, d: Dictionary) -> list[str]:
    """The words of the likeliest path through the lattice of a run; of equal ones that with the longer last words."""
    best, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        ways = [(best[start] + score, start) for start in range(max(0, end - d.longest), end) if (score := d.scores.get(run[start:end], d.unknown if end - start == 1 else None)) is not None]
        top = max(ways, key=lambda x: (x[0], -x[1]))
        best.append(top[0])
        back.append(top[1])
    out, at = [], len(run)
    while at:
        out.append(run[back[at] : at])
        at = back[at]
    return out[::-1]


def _cut(tokens: Column, d: Dictionary, rows: DataFrame) -> Column:
    """Arrays of tokens with those that are runs cut into words."""
    shared = rows.sparkSession.sparkContext.broadcast(d)

    @F.pandas_udf("array<string>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in parts:
            yield pd.Series([None if own is None else [w for t in own for w in (best_path(t[1:], shared.value) if t.startswith(" ") else [t])] for own in series])

    return cut(tokens)


def learn_words(texts: DataFrame, text_col: str = "text", run: str = RUN, longest: int = LONGEST, least: int = LEAST, most: int = MOST) -> Dictionary:
    """A dictionary of at most ``most`` words from the runs of the texts.

    Equal runs are counted first and cut into strings once; strings are counted and compared with their parts by
    aggregates and joins. Only the words kept come to the driver.
    """
    runs = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit(f"{run}+"), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    runs = materialize(runs, "runs")
    size = F.length("run")
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr("run", i, F.lit(n))))
    grams = runs.select("n", F.explode(F.flatten(F.array_compact(F.array(*(of(n) for n in range(1, longest + 2)))))).alias("g")).groupBy("g").agg(F.sum("n").alias("n"))
    grams = materialize(grams.filter((F.col("n") >= least) | (F.length("g") == 1)), "grams")
    total = grams.filter("length(g) = 1").agg(F.sum("n")).first()[0] or 1
    # what stands before or behind a string most often
    wider = grams.filter("length(g) > 1")
    beside = wider.select(F.explode(F.array(F.struct(F.expr("left(g, length(g) - 1)").alias("g"), F.lit(1).alias("side"), "n"), F.struct(F.expr("substr(g, 2)").alias("g"), F.lit(0).alias("side"), "n"))).alias("x")).select("x.*")
    beside = beside.groupBy("g", "side").agg(F.max("n").alias("top")).groupBy("g").agg(F.max("top").alias("top"))
    words = wider.filter(F.length("g") <= longest)
    parts = words.select("g", "n", F.explode(F.sequence(F.lit(1), F.length("g") - 1)).alias("at")).select("g", "n", F.expr("left(g, at)").alias("a"), F.expr("substr(g, at + 1)").alias("b"))
    parts = parts.join(grams.select(F.col("g").alias("a"), F.col("n").alias("na")), "a").join(grams.select(F.col("g").alias("b"), F.col("n").alias("nb")), "b")
    firm = parts.groupBy("g").agg(F.first("n").alias("n"), F.min(F.col("n") * F.lit(float(total)) / (F.col("na") * F.col("nb"))).alias("cohesion")).filter(F.col("cohesion") >= COHESION)
    free = firm.join(beside, "g", "left").filter(F.col("top").isNull() | (F.col("top") <= NEIGHBOUR * F.col("n")))
    kept = free.select("g", "n").union(grams.filter("length(g) = 1"))
    counts = {r.g: r.n for r in kept.orderBy(F.desc("n"), "g").limit(most).collect()}
    for _ in range(ROUNDS if counts else 0):
        each = runs.select("n", F.explode(_cut(F.array(F.concat(F.lit(" "), "run")), dictionary(counts), runs)).alias("g"))
        again = {r.g: r.n for r in each.groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(most).collect()}
        counts = {w: again.get(w, 0) for w in counts if again.get(w) or len(w) == 1}
        counts = {w: max(n, 1) for w, n in counts.items()}
    return dictionary(counts)


def known_words(words: DataFrame, most: int = MOST) -> Dictionary:
    """A dictionary of words that are known with their counts (``word, n``): the ``most`` commonest."""
    rows = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return dictionary({r.word: r.n for r in rows.collect()})


def segmented(rows: DataFrame, d: Dictionary, text_col: str = "text", run: str = RUN, name: str = "words") -> DataFrame:
    """``rows`` with the lower-case words of each whole text as ``name``: runs by the dictionary, the rest as it is written; null stays null."""
    tokens = F.regexp_extract_all(F.lower(text_col), F.lit(f"{run}+|(?:(?!{run}){_OTHER})"), F.lit(0))
    marked = F.transform(tokens, lambda t: F.when(t.rlike(f"^{run}"), F.concat(F.lit(" "), t)).otherwise(t))
    return rows.withColumn(name, _cut(marked, d, rows))


def without_spaces(language: Column) -> Column:
    """Whether a language's texts need a dictionary."""
    return F.coalesce(language.isin(*LOGOGRAMS), F.lit(False))
