"""Sentences by what the corpus tells of its abbreviations.

A word that stands before a full stop far more often than by chance is an abbreviation: its counts with and
without the stop are compared by their likelihoods, short words and words with stops inside being likelier. A
stop behind one, behind an initial or between words that are often joined by it ends no sentence, unless a word
follows that often begins one. The statistics are counts of each language's words, made by aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import junk_sentence
from tidings.operators.storage import materialize

# Least scores of an abbreviation, of words joined by a stop, and of a word that begins sentences.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Stops that a task remembers of a language: the words on both sides, and whether a sentence goes on there.
MEMO = 200_000
#: A token with a letter or digit, so that its type is not empty.
_TOKEN = r"[^\s\p{L}\p{N}]*[\p{L}\p{N}]\S*"
_SPLIT = r"(?<=[.!?])[ \t\r\f]+(?=[\p{Lu}\p{N}])|\n+"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value made once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    return k * F.log(p) + (n - k) * F.log1p(-p)


def _bound(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))


def _dunning(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """How much likelier the joint count is than by chance: twice the ratio of the logarithms of both likelihoods."""
    p, with_a, without = _bound(b / n), _bound(ab / a), _bound((b - ab) / F.greatest(n - a, F.lit(1)))
    chance = _log_likelihood(ab, a, p) + _log_likelihood(b - ab, n - a, p)
    return -2 * (chance - _log_likelihood(ab, a, with_a) - _log_likelihood(b - ab, n - a, without))


def _kind(token: Column) -> Column:
    """A token's lower-case type; numbers are one type."""
    bare = F.regexp_replace(F.lower(token), r"""^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$""", "")
    return F.regexp_replace(bare, r"^[\p{N}.,]*\p{N}(\.?)$", "##$1")


def _tokens(texts: DataFrame, text_col: str, language_col: str) -> DataFrame:
    """``language, kind, after, n``: each token's type, and the type of its successor in the same line where a stop stands between.

    Tokens are counted as they are written first, so types are made of the different ones only. Generators are
    the outer ones: before others Spark puts a filter that makes the whole list once more.
    """
    lines = texts.select(F.coalesce(F.col(language_col), F.lit("")).alias("language"), F.explode_outer(F.split(text_col, r"\n+")).alias("line"))
    words = lines.select("language", F.regexp_extract_all("line", F.lit(_TOKEN), F.lit(0)).alias("t"))
    each = words.select("language", F.inline_outer(F.arrays_zip(F.col("t").alias("token"), F.slice("t", 2, F.size("t")).alias("next")))).filter("token is not null")
    each = each.groupBy("language", "token", F.when(F.col("token").contains("."), F.col("next")).alias("next")).agg(F.count("*").alias("n"))
    kinds = each.select("language", _kind(F.col("token")).alias("kind"), _kind(F.col("next")).alias("after"), "n")
    return kinds.groupBy("language", "kind", F.when(F.col("kind").endswith("."), F.col("after")).alias("after")).agg(F.sum("n").alias("n"))


def learn_abbreviations(texts: DataFrame, text_col: str = "text", language_col: str = "language") -> DataFrame:
    """``language, abbreviations, joined, starters``: one row for each language, with all words and pairs that reach the least score.

    ``joined`` are pairs ``a b`` of words that a stop parts but no sentence ends between. A null language
    counts as empty; null texts say nothing.
    """
    pairs = materialize(_tokens(texts, text_col, language_col), "tokens")
    stop = F.col("kind").endswith(".")
    bare = F.when(stop, F.expr("left(kind, length(kind) - 1)")).otherwise(F.col("kind"))
    counts = pairs.groupBy("language", bare.alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(stop, F.col("n")).otherwise(0)).alias("stopped")).filter("word <> ''")
    whole = F.broadcast(counts.groupBy("language").agg(F.sum("n").alias("all"), F.sum("stopped").alias("stops")))  # one row for each language
    size, inner = F.length(F.replace("word", F.lit("."), F.lit(""))), F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    # the chance that a stop is there at all against near certainty, as every abbreviation has it
    p, high = _bound(F.col("stops") / F.col("all")), F.lit(0.99)
    likely = -2 * (_log_likelihood(F.col("stopped"), F.col("n"), p) - _log_likelihood(F.col("stopped"), F.col("n"), high))
    score = likely * F.exp(-size) * (inner + 1) * F.pow(size, -(F.col("n") - F.col("stopped")))
    scored = counts.join(whole, "language").filter("stopped > 0").withColumn("score", F.when(size > 0, score).otherwise(0.0))
    short = materialize(scored.filter((F.col("score") >= ABBREVIATION) & F.col("word").rlike(r"\p{L}|^##$")), "abbreviations")
    # words behind a stop that ends a sentence, as far as is known by now
    ended = pairs.filter(stop & F.col("after").isNotNull()).select("language", bare.alias("word"), F.regexp_replace("after", r"\.$", "").alias("next"), "n")
    ends = ended.join(short.select("language", "word"), ["language", "word"], "left_anti").filter(F.length("word") > 1)
    breaks = F.broadcast(ends.groupBy("language").agg(F.sum("n").alias("breaks")))
    plain = counts.select("language", F.col("word").alias("next"), F.col("n").alias("of_next"))
    starters = ends.groupBy("language", "next").agg(F.sum("n").alias("ab")).join(plain, ["language", "next"]).join(breaks, "language").join(whole, "language")
    starters = starters.withColumn("score", _dunning(F.col("breaks"), F.col("of_next"), F.col("ab"), F.col("all")))
    starters = starters.filter((F.col("score") >= STARTER) & (F.col("all") / F.col("breaks") > F.col("of_next") / F.col("ab")) & F.col("next").rlike(r"\p{L}"))
    # an initial or a number before a stop and a word: joined more often than by chance
    firm = ended.filter((F.length("word") == 1) | (F.col("word") == "##")).groupBy("language", "word", "next").agg(F.sum("n").alias("ab"))
    firm = firm.join(counts.select("language", "word", F.col("n").alias("of_word")), ["language", "word"]).join(plain, ["language", "next"]).join(whole, "language")
    firm = firm.withColumn("score", _dunning(F.col("of_word"), F.col("of_next"), F.col("ab"), F.col("all"))).filter((F.col("score") >= COLLOCATION) & (F.col("ab") > 1))

    def listed(df: DataFrame, what: str, name: str) -> DataFrame:
        return df.groupBy("language").agg(F.sort_array(F.collect_list(F.expr(what))).alias(name))

    out = whole.select("language").join(listed(short, "word", "abbreviations"), "language", "left").join(listed(firm, "concat(word, ' ', next)", "joined"), "language", "left").join(listed(starters, "next", "starters"), "language", "left")
    return out.select("language", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("abbreviations", "joined", "starters")))


def _goes_on(asked: str, abbreviations: set[str], joined: set[str], starters: set[str]) -> bool:
    """Whether a stop ends no sentence: ``asked`` is the word before it, marked if it is one letter, and the word behind."""
    word, _, first = asked.removeprefix("*").partition(" ")
    return (asked.startswith("*") or word in abbreviations) and first not in starters or f"{word} {first}" in joined


def split_sentences(texts: DataFrame, learnt: DataFrame, text_col: str = "text", language_col: str = "language", name: str = "sentences") -> DataFrame:
    """``texts`` with the sentences of each whole text as ``name``, by what ``learn_abbreviations`` has found in each language.

    Line ends always part sentences. Sentences without letters or of few ASCII characters go. A null text has none.
    The lists are as long as the vocabulary makes them, so tasks look words up in sets of one broadcast; only the
    words beside stops go to Python.
    """
    shared = texts.sparkSession.sparkContext.broadcast({r.language: tuple(map(set, (r.abbreviations, r.joined, r.starters))) for r in learnt.collect()})

    @F.pandas_udf("array<int>")
    def begins(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """Numbers of the parts that begin a sentence."""
        memos: dict[str, dict[str, bool]] = {}
        for languages, texts_asked in columns:
            out = []
            for language, text in zip(languages, texts_asked):
                lists, memo, found = shared.value.get(language) or (set(), set(), set()), memos.setdefault(language, {"": False}), []
                for k, asked in enumerate(text.split("\n")):
                    on = memo.get(asked)
                    if on is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        on = memo[asked] = _goes_on(asked, *lists)
                    if not on:
                        found.append(k)
                out.append(found)
            yield pd.Series(out)

    def asked(part: Column, following: Column) -> Column:
        """What is asked about the place between two parts of a line; nothing where no stop stands."""
        first = F.regexp_replace(_kind(F.substring_index(following, " ", 1)), r"\.$", "")
        beside = lambda word: F.concat(F.when(word.rlike(r"^\p{L}$"), "*").otherwise(""), word, F.lit(" "), first)
        behind = lambda last: F.when(last.endswith("."), _once(F.left(last, F.length(last) - 1), beside)).otherwise("")
        return _once(_kind(F.substring_index(part, " ", -1)), behind)

    clean = F.regexp_replace(F.coalesce(text_col, F.lit("")), r"[ \t\r\f]+", " ")
    pairs = lambda parts: F.transform(parts, lambda p, i: F.struct(p.alias("part"), F.when(i > 0, asked(F.get(parts, i - 1), p)).otherwise("").alias("asked")))
    rows = texts.withColumn("_parts", F.flatten(F.transform(F.split(clean, r"\n+"), lambda line: _once(F.split(line, _SPLIT), pairs))))
    # not to be made again for a filter that is pushed below it
    rows = rows.withColumn("_begins", begins.asNondeterministic()(F.coalesce(F.col(language_col), F.lit("")), F.array_join(F.col("_parts.asked"), "\n")))

    of = lambda parts, at: F.transform(at, lambda a, k: F.array_join(F.slice(parts, a + 1, F.coalesce(F.get(at, k + 1), F.size(parts)) - a), " "))
    found = _once(F.col("_parts.part"), lambda parts: _once(F.col("_begins"), lambda at: of(parts, at)))
    good = F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: ~junk_sentence(s) & s.rlike(r"[\p{L}\p{N}]"))
    return rows.withColumn(name, good).drop("_parts", "_begins")
