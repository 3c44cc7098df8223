"""Languages of texts by character n-grams: naive Bayes over profiles learnt from labelled texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions.text import words
from tidings.operators.storage import discard, materialize

#: Longest n-gram, and n-grams kept of a language, the commonest first: so a model's size is bounded by its languages.
LONGEST, KEPT = 4, 4000
#: Fixed value: a text of fewer letters has no language.
LEAST_LETTERS = 10
#: A guess must be this much likelier than the next language for each n-gram, else the text has none.
LEAST_MARGIN = 0.02
#: Words whose scores a task remembers.
MEMO = 200_000


class Profiles(NamedTuple):
    languages: list[str]
    scores: dict[str, np.ndarray]  #: log probabilities of an n-gram, one for each language


def _grams(word: str) -> list[str]:
    """N-grams of a word with a mark at both ends, each length from 1 on."""
    marked = f" {word} "
    return [marked[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(marked) - n + 1)]


def _grams_of(word: Column) -> Column:
    """The same as a column."""
    marked = F.concat(F.lit(" "), word, F.lit(" "))
    none = F.array().cast("array<string>")  # a marked word has three characters at least, so only its longest n-gram may be missing
    of = lambda n: F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substr(marked, i, F.lit(n)))).otherwise(none)
    return F.concat(*(of(n) for n in range(1, LONGEST + 1)))


def _letters(text: Column) -> Column:
    """Lower-case words of letters; digits, marks and addresses say little about a language."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def gram_counts(labelled: DataFrame, text_col: str = "text", language_col: str = "language") -> DataFrame:
    """``language, gram, n`` of all labelled texts, each from its beginning to its end.

    Counts are made word by word: each distinct word of a language is cut into n-grams once. Rows without a
    label or text say nothing.
    """
    rows = labelled.filter(F.col(language_col).isNotNull() & (F.col(language_col) != "") & F.col(text_col).isNotNull())
    # the outer generator: before the inner one Spark puts a filter that looks for the words once more
    tokens = rows.select(F.col(language_col).alias("language"), F.explode_outer(_letters(F.col(text_col))).alias("word")).filter("word is not null")
    counts = tokens.groupBy("language", "word").agg(F.count("*").alias("n"))
    return counts.select("language", "n", F.explode(_grams_of(F.col("word"))).alias("gram")).groupBy("language", "gram").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, text_col: str = "text", language_col: str = "language") -> Profiles:
    """Profiles of the languages that label some text, from all of these texts.

    What comes to the driver is KEPT n-grams for each language.
    """
    grams = materialize(gram_counts(labelled, text_col, language_col), "grams")  # read twice below
    totals = {r.language: r.total for r in grams.groupBy("language").agg(F.sum("n").alias("total")).collect()}
    # the limit goes before the shuffle too, so no task gathers all n-grams of a language
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    found: dict[str, dict[str, int]] = {x: {} for x in totals}
    for r in grams.withColumn("place", place).filter(F.col("place") <= KEPT).collect():
        found[r.language][r.gram] = r.n
    discard(grams)
    languages = sorted(found)
    known = sorted({g for own in found.values() for g in own})
    sizes = [totals[x] + len(known) for x in languages]
    scores = {g: np.array([log(found[x].get(g, 0) + 1) - log(t) for x, t in zip(languages, sizes)]) for g in known}
    return Profiles(languages, scores)


def identify(rows: DataFrame, profiles: Profiles, text_col: str = "text", name: str = "guess") -> DataFrame:
    """``rows`` with the language of each whole text as ``name``; empty where it is unsure, too short, or null.

    The words of a text are counted, so one that repeats is scored once; scores of words are remembered.
    """
    shared = rows.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("string")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, memo, parts_of = shared.value, {}, np.zeros((MEMO, len(shared.value.languages) + 2))

        grams_at = {g: k for k, g in enumerate(own.scores, 1)}
        grams_of = np.vstack([np.zeros((1, len(own.languages))), *own.scores.values()])

        def learn_words(words: list[str]) -> None:
            """Summed scores of each word's n-grams that some profile has, how many these are, and its letters."""
            if not words:
                return
            flat, starts = [], []
            for word in words:
                starts.append(len(flat))
                flat.append(0)  # a row of zeros, so that no word is empty
                flat += [k for g in _grams(word) if (k := grams_at.get(g)) is not None]
            here = slice(len(memo), len(memo) + len(words))
            parts_of[here, :-2] = np.add.reduceat(grams_of[flat], starts)
            parts_of[here, -2] = np.diff([*starts, len(flat)]) - 1
            parts_of[here, -1] = [len(w) for w in words]
            memo.update(zip(words, range(here.start, here.stop)))

        for texts in parts:
            out = []
            for tokens in texts:
                counts = list(Counter(tokens.split(" ") if tokens else []).items())
                sums = np.zeros(parts_of.shape[1])
                for k in range(0, len(counts), MEMO // 2):  # a text of very many words goes in stretches
                    some = counts[k : k + MEMO // 2]
                    if len(memo) + len(some) > MEMO:
                        memo.clear()
                    learn_words([w for w, _ in some if w not in memo])
                    sums += np.array([n for _, n in some], dtype=float) @ parts_of[[memo[w] for w, _ in some]]
                total, grams, letters = sums[:-2], sums[-2], sums[-1]
                if letters < LEAST_LETTERS or not grams:
                    out.append("")
                    continue
                order = np.argsort(-total, kind="stable")
                sure = len(order) == 1 or (total[order[0]] - total[order[1]]) / grams >= LEAST_MARGIN
                out.append(own.languages[order[0]] if sure else "")
            yield pd.Series(out)

    # one text of words, not a list: the way to Python and back costs far less
    return rows.withColumn(name, guess(F.array_join(_letters(F.col(text_col)), " ")))


def distinct_words(texts: DataFrame, text_col: str = "text", language_col: str = "language") -> DataFrame:
    """``language, word, n`` of all texts."""
    return texts.select(F.coalesce(F.col(language_col), F.lit("")).alias("language"), F.explode(words(F.col(text_col))).alias("word")).groupBy("language", "word").agg(F.count("*").alias("n"))
