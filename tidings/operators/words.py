"""Word counts of sentences: distinct sentences, stop words out, a word at most three times a sentence."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.stems import stemmer
from tidings.functions.text import drop_stop_words, words
from tidings.operators.segments import Dictionary, segmented, without_spaces

# Characters of a sentence that some queries count by their SQL, and how often a word counts in one sentence.
SENTENCE_CHARS, MOST_IN_SENTENCE = 1024, 3
#: Different words or terms that a task keeps.
TERMS = 300_000


def _ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _counted(sentence: str, chars: int | None) -> Column:
    """What counts of a sentence: its first ``chars`` characters, or all of it."""
    return F.col(sentence) if chars is None else F.substr(sentence, F.lit(1), F.lit(chars))


def _clean_words(sentence: str, chars: int | None) -> Column:
    """Words of what counts of a sentence, without addresses and numbers."""
    clean = F.regexp_replace(_counted(sentence, chars), r"https?://\S+", " ")
    return F.filter(words(clean), lambda w: ~w.rlike("^[0-9]+$"))


class _Stems(dict):
    """Stems of a language's words, each made when it is first asked for."""

    def __init__(self, language: str):
        super().__init__()
        self.stem = stemmer(language)

    def __missing__(self, word: str) -> str:
        self[word] = found = self.stem(word)
        return found


def _capped(terms: list[tuple[str, str]]) -> Counter:
    """How often each (stem, word) of a sentence's many is over the cap: in their order a stem counts MOST_IN_SENTENCE times."""
    terms = sorted(terms)
    return Counter(t for t, back in zip(terms[MOST_IN_SENTENCE:], terms) if t[0] == back[0])


def _stemmed_counts(rows: DataFrame, n: int) -> DataFrame:
    """``stem, word, c, n`` of rows ``at, language, text``: how often a term stands, and how often it counts, in sums of a part of the rows.

    A sentence is the rows from one with ``at`` 0 to the next: one for each of its languages, with its words
    joined by spaces. A task stems each word once, forgets what it knows at TERMS words, and hands
    on its counts at as many terms.
    """
    schema = pa.schema([("stem", pa.string()), ("word", pa.string()), ("c", pa.int64()), ("n", pa.int64())])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, _Stems] = {}
        totals: dict[str, Counter] = {}
        over: Counter = Counter()
        sentence: list[tuple[list[str], list[str]]] = []

        def close() -> None:
            """Look for stems over the cap in the sentence at hand: four equal ones take three repeats at least."""
            if sum(len(found) for found, _ in sentence) - len(set().union(*(found for found, _ in sentence))) >= MOST_IN_SENTENCE:
                over.update(_capped([t for found, terms in sentence for t in zip(found, terms)]))
            sentence.clear()

        def handed_on() -> pa.RecordBatch:
            sums: dict[tuple[str, str], list[int]] = {}
            for language, total in totals.items():
                known = stems[language].__getitem__
                for term, c in total.items():
                    row = sums.setdefault((" ".join(map(known, term.split(" "))) if n > 1 else known(term), term), [0, 0])
                    row[0] += c
                    row[1] += c
            for key, c in over.items():  # of a sentence that began before the last hand-over too
                sums.setdefault(key, [0, 0])[1] -= c
            out = [(*key, *row) for key, row in sums.items()]
            totals.clear()
            over.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)

        for batch in batches:
            waiting: dict[str, list[str]] = {}
            for at, language, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if at == 0 and sentence:
                    close()
                known = stems.get(language)
                if known is None:
                    known = stems[language] = _Stems(language)
                terms = text.split(" ") if text else []
                found = list(map(known.__getitem__, terms))
                if n > 1:
                    terms, found = ([" ".join(x[i : i + n]) for i in range(len(x) - n + 1)] for x in (terms, found))
                sentence.append((found, terms))
                waiting.setdefault(language, []).extend(terms)
            for language, terms in waiting.items():
                totals.setdefault(language, Counter()).update(terms)
            if sum(map(len, totals.values())) > TERMS:
                yield handed_on()
            if sum(map(len, stems.values())) > TERMS:
                stems = {k: _Stems(k) for k in totals}
        if sentence:
            close()
        yield handed_on()

    return rows.mapInArrow(counts, "stem string, word string, c long, n long")


def _with_words(rows: DataFrame, unspaced: Column, dictionary: Dictionary | None, chars: int | None) -> DataFrame:
    """``rows`` with the words of their sentence as ``own``; in languages without spaces by the dictionary, where there is one."""
    if dictionary is None:
        return rows.withColumn("own", _clean_words("sentence", chars))
    cut = segmented(rows.withColumn("_s", F.when(unspaced, _counted("sentence", chars))), dictionary, "_s", name="_cut")
    return cut.withColumn("own", F.coalesce("_cut", _clean_words("sentence", chars))).drop("_s", "_cut")


def word_counts(sentences: DataFrame, n: int = 1, stop_words: bool = True, stemmed: bool = False, dictionary: Dictionary | None = None, chars: int | None = None) -> DataFrame:
    """``stem, term, count`` of words (or n-grams) of distinct sentences: a stem's most used term (ties to the least) and its capped count.

    Whole sentences are counted, or the first ``chars`` characters of each. The cap is applied inside the row: in
    the sorted words of a sentence a stem counts unless the same one stands MOST_IN_SENTENCE places before. So one aggregate by stem and word is all that is shuffled then.
    With ``stemmed`` tasks stem their words themselves and hand on sums, so no word is shuffled by itself; an n-gram's stem is
    that of its words. Sentences of languages without spaces are cut into the words of a ``dictionary``, as
    ``tidings.operators.segments`` learns it from the corpus; without one a run of characters is one word.
    """
    rows = sentences.groupBy("sentence").agg(F.collect_set(F.coalesce("language", F.lit(""))).alias("languages"))
    if stemmed:
        each = _with_words(rows.select("sentence", F.posexplode("languages").alias("at", "language")), without_spaces(F.col("language")), dictionary, chars)
        kept = drop_stop_words(F.col("own"), F.col("language")) if stop_words else F.col("own")
        parts = _stemmed_counts(each.select("at", "language", F.array_join(kept, " ").alias("text")), n)
        each = parts.groupBy("stem", "word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    else:

        def named(language: Column) -> Column:
            kept = _ngrams(drop_stop_words(F.col("own"), language) if stop_words else F.col("own"), n)
            return F.transform(kept, lambda w: F.struct(w.alias("stem"), w.alias("word")))

        rows = _with_words(rows, F.exists("languages", without_spaces), dictionary, chars).select(F.array_sort(F.flatten(F.transform("languages", named))).alias("w"))
        counts = lambda x, i: F.struct(x["stem"].alias("stem"), x["word"].alias("word"), (~F.get("w", i - MOST_IN_SENTENCE)["stem"].eqNullSafe(x["stem"])).cast("int").alias("n"))
        each = rows.select(F.inline(F.transform("w", counts))).groupBy("stem", "word").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    return each.groupBy("stem").agg(F.min_by("word", F.struct(-F.col("c"), F.col("word"))).alias("term"), F.sum("n").alias("count"))


def word_list(sentences: DataFrame, num_words: int = 500, sample: int | None = None, seed: int = 1, **how) -> DataFrame:
    """The most counted words, of a random sample of sentences if one is asked for."""
    rows = sentences if sample is None else sentences.orderBy(F.rand(seed)).limit(sample)
    return word_counts(rows, **how).orderBy(F.desc("count"), F.desc("stem")).limit(num_words)


def word_matrix(sentences: DataFrame, most: int | None = None) -> DataFrame:
    """``stories_id, stem, count``; ``most`` keeps the commonest stems."""
    own = F.filter(words(F.substr("sentence", F.lit(1), F.lit(SENTENCE_CHARS))), lambda w: ~w.rlike("^[0-9]+$"))
    own = drop_stop_words(own, F.col("language"))
    rows = sentences.select("stories_id", F.explode(own).alias("stem")).groupBy("stories_id", "stem").agg(F.count("*").alias("count"))
    if most is None:
        return rows
    common = rows.groupBy("stem").agg(F.sum("count").alias("total")).orderBy(F.desc("total"), "stem").limit(most)
    return rows.join(F.broadcast(common.select("stem")), "stem", "left_semi").select("stories_id", "stem", "count")


def dedup_sentences_by_week(sentences: DataFrame) -> DataFrame:
    """``stories_id, sentence_number, is_dup, kept``: per medium, week and sentence the first is kept and marked where it has repeats."""
    key = [F.col("media_id"), F.date_trunc("week", "publish_date").cast("date").alias("week"), F.substring(F.md5("sentence"), 1, 16).alias("h")]
    rows = sentences.select("stories_id", "sentence_number", *key)
    groups = rows.groupBy("media_id", "week", "h").agg(F.min(F.struct("stories_id", "sentence_number")).alias("first"), F.count("*").alias("n"))
    same = F.expr("r.media_id <=> g.media_id and r.week <=> g.week and r.h = g.h")
    joined = rows.alias("r").join(groups.alias("g"), same)
    kept = (F.col("r.stories_id") == F.col("g.first.stories_id")) & (F.col("r.sentence_number") == F.col("g.first.sentence_number"))
    return joined.select("r.stories_id", "r.sentence_number", (F.col("g.n") > 1).alias("is_dup"), kept.alias("kept"))


def word2vec(sentences: DataFrame, size: int = 100, least: int = 5, seed: int = 1):
    """A Word2Vec model of the sentences' words."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=size, minCount=least, seed=seed, inputCol="tokens", outputCol="vector").fit(sentences.select(words(F.col("sentence")).alias("tokens")))
