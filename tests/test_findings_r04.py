"""What a reviewer's fourth round found: steps that no longer shuffle what they need not, and whole texts and lists where there were cuts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidings.operators import index as I
from tidings.operators import languages as L
from tidings.operators import segments as S
from tidings.operators import sentences as N
from tidings.operators import words as W
from tidings.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


CHANGES = "stories_id long, text string, deleted boolean, changed int"


def _noted(monkeypatch):
    """What each run is written from."""
    seen, write = [], I.SearchIndex._write

    def noted(self, postings, *rest):
        seen.extend(map(physical, postings))
        return write(self, postings, *rest)

    monkeypatch.setattr(I.SearchIndex, "_write", noted)
    return seen


def test_runs_are_written_and_merged_without_a_shuffle(spark, monkeypatch):
    """No text and no posting is dealt anew, and a search of a merged index joins nothing."""
    seen, index = _noted(monkeypatch), I.SearchIndex(spark, fan=3)
    rows = spark.range(60).selectExpr("id as stories_id", "concat('some words number ', id) as text")
    index.add(rows)
    index.add(rows.filter("stories_id % 5 = 0").selectExpr("stories_id", "'other words' as text"))
    index.add(rows.filter("stories_id % 7 = 0").selectExpr("stories_id", "text", "true as deleted"))
    assert len(seen) == 4 and len(index.runs) == 1
    assert not [p for p in seen if "hashpartitioning" in p or "rangepartitioning" in p or "SortMergeJoin" in p]
    found = index.search('"words number" and not 58')
    assert "Join" not in plan(found)
    assert {r.stories_id for r in found.collect()} == {k for k in range(60) if k % 5 and k % 7 and k != 58}


@pytest.mark.parametrize("name", ["index_search_near", "index_search_phrase", "index_search_words"])
def test_queries_write_their_index_without_a_shuffle(spark, monkeypatch, name):
    seen = _noted(monkeypatch)
    QUERIES[name].run(spark, SMALL)
    assert len(seen) == 4 and not [p for p in seen if "hashpartitioning" in p or "SortMergeJoin" in p]


@pytest.mark.parametrize("held, passes", [(I.HELD, I.PASSES), (9, 16), (1, 0)])
def test_newest_rows_of_a_batch(spark, monkeypatch, held, passes):
    """Repeated, tied and deleted rows, whether what repeats or is hidden is broadcast at once, in parts or joined."""
    monkeypatch.setattr(I, "HELD", held)
    monkeypatch.setattr(I, "PASSES", passes)
    rng, state, index = random.Random(6), {}, I.SearchIndex(spark, fan=2)
    for batch in range(4):
        rows = [(rng.randint(0, 30), rng.choice(["oats", "rye", "rye oats", "", None]), rng.random() < 0.2, rng.choice([None, 1, 2, 3]) if batch % 2 else k) for k in range(50)]
        best = {}
        for i, t, gone, changed in rows:
            best[i] = max(best.get(i, ((-1,),)), ((-1 if changed is None else changed, gone, t or ""),))
        for i, ((_, gone, t),) in best.items():
            state[i] = None if gone else t
        index.add(spark.createDataFrame([*rows, (None, "rye", False, 9)], CHANGES), batch)
    assert {r.stories_id for r in index.search("rye").collect()} == {i for i, t in state.items() if t and "rye" in t}
    assert {r.stories_id for r in index.search("not rye").collect()} == {i for i, t in state.items() if t is not None and "rye" not in t}


def test_postings_are_sorted_in_stretches(monkeypatch):
    """Each stretch is in the order of words and stories, and holds whole texts; merged ones are sorted anew."""
    monkeypatch.setattr(I, "STRETCH", 5)
    monkeypatch.setattr(I, "HANDED_ON", 3)
    texts = pa.RecordBatch.from_arrays([pa.array([3, 1, 2, 4], pa.int64()), pa.array(["b a\x01b", "\x01a c d\x01", " ß a", "\x01"])], names=["a", "b"])
    rows = lambda batches: [tuple(r.values()) for b in batches for r in b.to_pylist()]
    first = rows(I._postings_of_texts(iter([texts])))
    assert first == [(1, "a", 0), (3, "a", 3), (3, "b", 0), (3, "b", 4), (1, "c", 3), (1, "d", 5), (2, "a", 3), (2, "ß", 1)]
    monkeypatch.setattr(I, "STRETCH", 100)
    again = rows(I._sorted_again(iter([pa.RecordBatch.from_pylist([dict(zip(I._POSTING.names, r)) for r in first], schema=I._POSTING)])))
    assert again == sorted(first, key=lambda r: (r[1], r[0]))
    assert rows(I._postings_of_texts(iter([]))) == rows(I._sorted_again(iter([]))) == []


def test_profiles_are_learnt_from_whole_texts_of_all_rows(spark):
    """More rows than the sample that was, and words behind its characters: each n-gram is counted."""
    rows = spark.range(21_000).select(F.lit("en").alias("language"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit("x q")).alias("text"))
    late = [("en", "a " * 3000 + "zzz"), ("de", "12 ... 34"), ("de", "ß"), (None, "kkk"), ("", "kkk"), ("en", None)]
    counts = {(r.language, r.gram): r.n for r in L.gram_counts(rows.union(spark.createDataFrame(late, "language string, text string"))).collect()}
    assert counts["en", " q "] == counts["en", "word"] == 21_000 and counts["en", " a "] == 3000 and counts["en", "zzz"] == 1 and counts["de", " ß "] == 1
    assert {x for x, _ in counts} == {"en", "de"} and not [g for _, g in counts if "k" in g]
    assert sum(n for (x, g), n in counts.items() if x == "de") == len(L._grams("ß"))
    asked = spark.createDataFrame([("zzzz zzzz zzzz",)], "text string")
    learnt = L.learn(spark.createDataFrame([("en", "a " * 3000 + "zzz " * 50), ("de", "b " * 3000)], "language string, text string"))
    assert [r.guess for r in L.identify(asked, learnt).collect()] == ["en"]


def test_languages_are_learnt_from_all_stories(spark, monkeypatch):
    seen, learn = [], L.learn
    monkeypatch.setattr(L, "learn", lambda stories: seen.append(stories.count()) or learn(stories))
    found = QUERIES["identify_language"].run(spark, SMALL)
    assert seen == [found.count()] == [spark.read.parquet(f"{SMALL}/documents.parquet").count()]


def test_words_are_counted_in_whole_sentences(spark):
    """Words behind the first 1,024 characters count, spaced or not, by the dictionary or without; so does what is cut there."""
    rows = [("filler " * 200 + "running late", "en"), ("x" * 1020 + " zebra https://a.b/" + "c" * 2000 + " tail", "en"), ("天" * 1030 + "地人", "zh")]
    df = spark.createDataFrame(rows, "sentence string, language string")
    got = {r.stem: r["count"] for r in W.word_counts(df, stemmed=True).collect()}
    assert got["filler"] == 3 and got["run"] == got["late"] == got["tail"] == got["x" * 1020] == 1 and not [w for w in got if "ccc" in w]
    known = S.dictionary({"地人": 5, "天": 5})
    for stemmed in (True, False):
        assert {r.stem: r["count"] for r in W.word_counts(df, stemmed=stemmed, dictionary=known).collect()}["地人"] == 1
    assert "running" not in {r.term for r in W.word_counts(df, chars=W.SENTENCE_CHARS).collect()}


def test_the_list_of_stems_counts_whole_sentences(spark, monkeypatch):
    seen, count = [], W.word_counts
    monkeypatch.setattr(W, "word_counts", lambda rows, **how: seen.append(count(rows, **how)) or seen[-1])
    QUERIES["word_list_stemmed"].run(spark, SMALL)
    assert len(seen) == 1 and "1024" not in plan(seen[0])


def test_all_abbreviations_are_kept(spark):
    """More of a language than the thousand that were kept: each keeps its sentences whole, and stands in the list."""
    letter = lambda k: F.chr(97 + (F.col("k") / F.lit(k)).cast("long") % 26)
    rows = spark.range(11_000).select("id", (F.col("id") % 1100).alias("k"), F.lit("en").alias("language"))
    rows = rows.withColumn("a", F.concat(letter(1), letter(26), letter(676))).select("id", "a", "language", F.concat(F.lit("see "), "a", F.lit(". Miller and so they all go home !")).alias("text"))
    learnt = N.learn_abbreviations(rows)
    (own,) = learnt.collect()
    assert len(own.abbreviations) == 1100 and {r.a for r in rows.select("a").distinct().collect()} == set(own.abbreviations)
    assert N.split_sentences(rows, learnt).filter("size(sentences) <> 1").count() == 0


def test_whole_texts_are_split(spark):
    """Sentences behind the first 1,048,576 characters, very many in one text, and each list in its place."""
    rows = [(1, "x" * (1 << 20) + " end. The last one.", "en"), (2, "Go on and on. " * 60_000 + "Then it is\nit ends", "en"), (3, "By J. Miller. At no. 4 they met Mrs. X. Then e.g. No\nDr.\nYes it is", "en"), (4, "By J. Then no. 4 it is", None), (5, None, "en")]
    learnt = spark.createDataFrame([("en", ["no", "e.g", "mrs"], ["dr yes", "miller at"], ["then", "at"])], "language string, abbreviations array<string>, joined array<string>, starters array<string>")
    got = {r.id: r.sentences for r in N.split_sentences(spark.createDataFrame(rows, "id int, text string, language string"), learnt).collect()}
    assert [len(s) for s in got[1]] == [(1 << 20) + 5, 13] and len(got[2]) == 60_002 and got[2][-2:] == ["Then it is", "it ends"]
    assert got[3] == ["By J. Miller. At no. 4 they met Mrs. X.", "Then e.g. No", "Yes it is"]
    assert got[4] == ["By J. Then no.", "4 it is"] and got[5] == []
