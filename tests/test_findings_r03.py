"""What a reviewer's third round found: right results where they were wrong, and steps that no longer grow past their limits."""

import datetime
import random

import public_tokenizers
from pyspark.sql import functions as F

from tidings.functions import dates
from tidings.functions import stems as S
from tidings.llm import bpe, common, toxicity
from tidings.operators import graph as G
from tidings.operators import languages as L
from tidings.operators import models as M
from tidings.operators import index as I
from tidings.operators import sentences as N7
from tidings.operators import snapshots as N
from tidings.operators import topic_lists as TL
from tidings.operators import topics as T
from tidings.operators import words as W
from tidings.plans import QUERIES, entries
from tidings.plans import graph as P
from tidings.sources import entities

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_days_with_two_digit_months(spark):
    texts = ["2023-11-01T08:00", "2023-10-1", "2023/1/31", "20231101", "2023.12.09", "2023-13-01", "2023-1101", "202311", "2023-11-31", "x2023-11-01", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.d for r in rows.select("k", dates._iso_day(F.col("t")).alias("d")).orderBy("k").collect()]
    day = datetime.date
    assert got == [day(2023, 11, 1), day(2023, 10, 1), day(2023, 1, 31), day(2023, 11, 1), day(2023, 12, 9)] + [None] * 6


def _model_tables(spark, n, runs):
    stories = spark.range(n).select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.lit(runs).cast("long"))).alias("run"), F.col("id").alias("stories_id"), F.when(F.col("id") % 11 != 5, F.col("id") % 7).alias("media_id")
    )
    day = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast((stories_id * run) % 97 as int))")
    stories = stories.withColumn("publish_date", F.when(F.col("stories_id") % 13 != 0, day)).withColumn("undateable", (F.col("stories_id") + F.col("run")) % 5 == 0)
    links = spark.range(n * 3).select((F.col("id") % n).alias("stories_id"), ((F.col("id") * 31 + 7) % (n + 3)).alias("ref_stories_id")).filter("stories_id <> ref_stories_id").distinct()
    return stories, links


def test_model_counts_of_many_runs(spark):
    """More runs than a number has bits, stories without dates or media, links to unknown stories, against plain Python."""
    stories, links = _model_tables(spark, 60, 130)
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-10", "2024-02-20"))
    got = {tuple(r) for r in M.media_counts(stories, links, start, end).select("run", "media_id", "media_inlink_count", "inlink_count").collect()}
    low, high = datetime.datetime(2024, 1, 10), datetime.datetime(2024, 2, 19, 23, 59, 59)
    pairs, rows, want = [tuple(r) for r in links.collect()], stories.collect(), set()
    for run in range(1, 131):
        own = {r.stories_id: r for r in rows if r.run == run}
        inside = {s for s, r in own.items() if not r.undateable and r.publish_date and low <= r.publish_date <= high}
        inside |= {b for a, b in pairs if a in inside and b in own}
        for m in {own[s].media_id for s in inside}:
            coming = [own[a].media_id for a, b in pairs if a in inside and b in inside and m is not None and own[b].media_id == m]
            want.add((run, m, len({x for x in coming if x is not None}), len(coming)))
    assert got == want


def test_model_joins_see_no_runs(spark):
    """Joins of stories and links carry runs as bits: no run is told apart below a join with links."""
    stories, links = _model_tables(spark, 60, 10)
    tree = plan(M.media_counts(stories, links, F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-02-20").cast("timestamp_ntz")))
    on = [line for line in tree.splitlines() if "Join " in line and "stories_id" in line]
    assert on and all("run#" not in line for line in on)


def test_links_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks that tell links apart grow in number with the links, and crossing media gathers them no second time."""
    monkeypatch.setattr(entities, "LINKS_IN_TASK", 500)
    e = entities.Entities(spark, SMALL)
    rows = e.table("lineitem").count()
    assert rows > 5000 and f", {-(-rows // 500)}), REPARTITION_BY_NUM" in e.topic_links._jdf.queryExecution().executedPlan().toString()
    cross = T.cross_media_links(e.topic_links, e.topic_stories)
    assert plan(cross).count("Aggregate [stories_id") == 1 and cross.count() == cross.distinct().count() > 0


def test_batches_of_streams_are_many_files(spark):
    """A batch of a stream keeps the partitions of its rows, and batches come in order."""
    e, seen = entities.Entities(spark, SMALL), []
    parts = [spark.range(0, 40, 1, 5), spark.range(40, 50, 1, 3)]
    note = lambda batch, number: seen.append((number, sorted(r.id for r in batch.collect()), batch.select(F.input_file_name()).distinct().count()))
    marks = entries.table_path(spark, "marks")
    entries._in_batches(e, parts, lambda s: s.writeStream.foreachBatch(note).option("checkpointLocation", marks).trigger(availableNow=True).start())
    assert seen == [(0, list(range(40)), 5), (1, list(range(40, 50)), 3)]


def test_index_reads_texts_once(spark):
    """Writing a run takes one pass over the texts for the postings and none for what it touches."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        reads.add(1)
        return t

    index = I.SearchIndex(spark, fan=2)
    rows = spark.range(60).select(F.col("id").alias("stories_id"), F.concat(F.lit("some words number "), F.col("id").cast("string")).alias("text"))
    index.add(rows.withColumn("text", counted.asNondeterministic()("text")))
    assert reads.value == 60
    index.add(rows.filter("stories_id < 10").withColumn("deleted", F.col("stories_id") < 5).withColumn("text", F.lit("other words")))
    assert {r.stories_id for r in index.search("number").collect()} == set(range(10, 60))
    assert {r.stories_id for r in index.search('"other words" or 5*').collect()} == {5, 6, 7, 8, 9, *range(50, 60)}


def test_places_of_words(spark):
    """Twice the number of a word, one more behind white space alone; marks, lone marks and ends count as they did."""
    rows = spark.createDataFrame([(1, "A b-c, d\n\t e"), (2, "  x...y z!"), (3, "..."), (4, ""), (5, "É_1 ß")], "stories_id long, text string")
    got = sorted(tuple(r) for r in I.words_with_places(rows).collect())
    assert got == [(1, "a", 0), (1, "b", 3), (1, "c", 4), (1, "d", 6), (1, "e", 9), (2, "x", 1), (2, "y", 2), (2, "z", 5), (5, "ß", 3), (5, "é_1", 0)]


def test_languages_pass_words_as_one_text(spark):
    """No list of words goes to Python, and odd texts have no language."""
    known = spark.createDataFrame([("en", "the cat and the dog went with the others to the house"), ("de", "der hund und die katze gingen mit den anderen nach hause")], "language string, text string")
    rows = spark.createDataFrame([(1, "the dogs and the cats with others"), (2, "die hunde und die katzen mit anderen"), (3, None), (4, ""), (5, "12 34 !!"), (6, "ab")], "k int, text string")
    out = L.identify(rows, L.learn(known))
    assert {r.k: r.guess for r in out.collect()} == {1: "en", 2: "de", 3: "", 4: "", 5: "", 6: ""}
    assert "array_join" in plan(out)


def test_workers_keep_one_step_only():
    """What a step has remembered stays for its own tasks and goes with the first of another step."""
    first = common.remembered("a", dict)
    first["x"] = 1
    assert common.remembered("a", dict) is first
    common.remembered(("b", 1), dict)
    assert common._kept == {("b", 1): {}}
    common._forget_others(None)
    assert not common._kept


def _dated_stories(spark):
    day = F.expr("timestamp_ntz'1969-03-01' + make_dt_interval(cast(id * 11 % 700 as int))")
    stories = spark.range(80).select(F.col("id").alias("stories_id"), (F.col("id") % 5).alias("media_id"), F.when(F.col("id") % 9 != 0, day).alias("publish_date"))
    links = spark.range(900).select((F.col("id") * 7 % 80).alias("stories_id"), ((F.col("id") * 13 + F.col("id") % 11) % 20).alias("ref_stories_id")).filter("stories_id <> ref_stories_id").distinct()
    return stories, links


def test_timespans_are_words_of_bits(spark):
    """Dates on both sides of 1970, none, and overlapping custom dates; members are kept and joined as words, far fewer than timespans."""
    stories, links = _dated_stories(spark)
    foci = spark.range(80).filter("id % 2 = 0").select((F.col("id") % 3 + 1).alias("focus"), F.col("id").alias("stories_id"))
    day = datetime.date
    custom = [(day(1969, 12, 20), day(1970, 1, 10)), (day(1970, 1, 1), day(1970, 6, 1))]
    custom_df = spark.createDataFrame(custom, "start_date date, end_date date")
    date = {r.stories_id: r.publish_date and r.publish_date.date() for r in stories.collect()}
    pairs = [tuple(r) for r in links.collect()]
    each = {(0, s) for s in date} | {tuple(r) for r in foci.collect()}
    members = {(f, "overall", None, s) for f, s in each}
    for f, s in each:
        if d := date[s]:
            members |= {(f, "weekly", d - datetime.timedelta(d.weekday()), s), (f, "monthly", d.replace(day=1), s)} | {(f, "custom", a, s) for a, b in custom if a <= d < b}
    members |= {(f, p, a, r) for f, p, a, s in members for x, r in pairs if x == s and (f, r) in each}
    got = [tuple(r) for r in N.timespan_members(stories, links, foci, custom_df, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == members
    counts = {tuple(r) for r in N.timespan_story_counts(stories, links, foci, custom_df).collect()}
    assert counts == {(*k, sum(m[:3] == k for m in members)) for k in {m[:3] for m in members}}
    assert N._member_words(stories, links, foci, custom_df, 3).count() < len(members) / 3


def test_counts_of_timespans_by_words(spark):
    stories, links = _dated_stories(spark)
    date = {r.stories_id: r.publish_date and r.publish_date.date() for r in stories.collect()}
    pairs, week = [tuple(r) for r in links.collect()], lambda d: d - datetime.timedelta(d.weekday())
    inside = {(week(d), s) for s, d in date.items() if d}
    inside |= {(week(date[a]), b) for a, b in pairs if date[a]}
    want = set()
    for w, s in inside:
        coming = [a for a, b in pairs if b == s and (w, a) in inside]
        want.add((w, s, len(coming), len({a % 5 for a in coming}), sum(a == s and (w, b) in inside for a, b in pairs)))
    got = [tuple(r) for r in TL.timespan_link_counts(stories, links, "weekly", 3).collect()]
    assert len(got) == len(want) and set(got) == want


def test_links_meet_stories_in_dealt_tasks(spark):
    """Joins of links with stories deal the links to a number of tasks of their own."""
    stories, links = _dated_stories(spark)
    found = T.medium_links(T.cross_media_links(links, stories, 7), stories, 7)
    assert found._jdf.queryExecution().executedPlan().toString().count(", 7), REPARTITION_BY_NUM") == 4
    assert sorted(found.collect()) == sorted(T.medium_links(T.cross_media_links(links, stories), stories).collect())


def test_memos_keep_what_is_common(monkeypatch):
    """Words met in each batch are encoded once, however many rare ones pass between."""
    monkeypatch.setattr(bpe, "MEMO", 50)
    encoder = bpe.PrefixEncoder(bpe.load_tokenizer(None, public_tokenizers.path("byte_bpe_50k.json")))
    seen, plain = [], encoder.encode_words
    monkeypatch.setattr(encoder, "encode_words", lambda words: seen.extend(words) or plain(words))
    batches = [[f"common words and q{k}x{n}y" for n in range(40)] for k in range(9)]
    got = [c for b in batches for c in encoder.encode_batch(b)]
    assert seen.count("common") == seen.count(" words") == 1 and len(encoder.words.young) + len(encoder.words.old) < 400
    fresh = bpe.PrefixEncoder(bpe.load_tokenizer(None, public_tokenizers.path("byte_bpe_50k.json")))
    assert got == fresh.encode_batch([t for b in batches for t in b])


def test_stems_of_a_word_and_of_a_table(spark):
    """Both ways of stemming agree in each language, on words with its endings."""
    rng, rows = random.Random(3), set()
    for language, r in S.RULES.items():
        ends = sorted({e for s in r.steps if isinstance(s, S.Step) for g in s.groups for e in g.endings.split()})
        letters = "bcdfgklmnprstvwyz'’ßqu" + r.vowels
        rows |= {(language, "".join(rng.choices(letters, k=rng.randint(1, 6)) + rng.choices(ends, k=rng.randint(0, 3))).lower()) for _ in range(300)}
        rows |= {(language, w) for w in S.EXCEPTIONS.get(language, {})}
    rows.add(("xx", "words"))
    found = S.stem_table(spark.createDataFrame(sorted(rows), "language string, word string")).collect()
    stem = {language: S.stemmer(language) for language in {r[0] for r in rows}}
    assert len(found) == len(rows) and all(stem[r.language](r.word) == r.stem for r in found)


def test_stemmed_words_are_not_shuffled_one_by_one(spark, monkeypatch):
    """Counts come from tasks as sums; the cap holds over a sentence's words, languages and hand-overs."""
    monkeypatch.setattr(W, "TERMS", 3)
    rows = [("house houses housing house houses runs", "en"), ("run running runs run", "en"), ("rosa rosas rosa rosas", "es"), ("rosa rosas rosa rosas", "en"), ("run running runs run", "en"), ("", "en"), ("42", None), ("solo", None)]
    got = W.word_counts(spark.createDataFrame(rows, "sentence string, language string"), stop_words=False, stemmed=True)
    assert "Join" not in plan(got) and "Generate explode" not in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [("hous", "house", 3), ("ros", "rosa", 3), ("rosa", "rosa", 3), ("run", "run", 4), ("solo", "solo", 1)]


def test_tokens_are_counted_before_their_types(spark):
    """Types are made of different tokens, successors kept behind stops only, and no filter makes a list once more."""
    rows = spark.createDataFrame([("Dr. No met (Dr.) Yes -- no ... 12.5. Then\nend", "en"), (None, "en"), ("", None), ("met met", None)], "text string, language string")
    found = N7._tokens(rows, "text", "language")
    got = sorted((tuple(r) for r in found.collect()), key=str)
    want = [("", "met", None, 2), *(("en", k, a, n) for k, a, n in [("##.", "then", 1), ("dr.", "no", 1), ("dr.", "yes", 1), ("end", None, 1), ("met", None, 1), ("no", None, 2), ("then", None, 1), ("yes", None, 1)])]
    assert got == sorted(want, key=str)
    assert "size(" not in "".join(x for x in plan(found).splitlines() if "Filter" in x)
    query = QUERIES["sentence_split_learnt"].run(spark, SMALL)
    assert "size(" not in "".join(x for x in plan(query).splitlines() if "Filter" in x)


def test_counts_of_stories_come_from_dealt_links(spark):
    """Links are joined and counted by both ends in a number of tasks of their own."""
    stories, links = _dated_stories(spark)
    posts = spark.range(50).select((F.col("id") % 9).alias("stories_id"), (F.col("id") % 4).alias("author"), F.lit("x").alias("channel"))
    found = T.story_link_counts(stories, T.cross_media_links(links, stories, 7), posts, 7)
    assert found._jdf.queryExecution().executedPlan().toString().count(", 7), REPARTITION_BY_NUM") >= 4
    assert sorted(found.collect()) == sorted(T.story_link_counts(stories, T.cross_media_links(links, stories), posts).collect())


def test_memos_let_rare_words_go(monkeypatch):
    """A memo holds two halves of its size at most, and what the last batch brought: words met once go, whatever their number."""
    monkeypatch.setattr(bpe, "MEMO", 50)
    encoder = bpe.PrefixEncoder(bpe.load_tokenizer(None, public_tokenizers.path("byte_bpe_50k.json")))
    for k in range(30):
        encoder.encode_batch([f"common words and {chr(97 + k % 26) * (k // 26 + 1)}q{chr(97 + n % 26) * (n // 26 + 1)}" for n in range(40)])
        for memo in (encoder.words, encoder.pieces):
            assert memo.young is not memo.old and len(memo.young) + len(memo.old) < 300


def test_counting_for_toxicity_forgets_other_steps(spark):
    """A worker that counts n-grams keeps nothing of the step before."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "you are an awful fool indeed").otherwise("a calm and friendly greeting").alias("text"))
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    asked, forget = spark.sparkContext.accumulator(0), toxicity._forget_others

    def noted(step):
        asked.add(1)
        forget(step)

    toxicity._forget_others = noted
    try:
        toxicity.train(docs, labels)
    finally:
        toxicity._forget_others = forget
    assert asked.value >= 1


def test_rounds_of_communities_make_the_links_once(spark):
    """Links are made once for all rounds of label propagation, whose labels stay those of plain Python."""
    made, rows = spark.sparkContext.accumulator(0), [(1, 2, 3), (2, 3, 1), (3, 1, 2), (4, 5, 5), (5, 6, 1), (6, 4, 2), (3, 4, 1)]

    @F.udf("long")
    def counted(w):
        made.add(1)
        return w

    edges = spark.createDataFrame(rows, "a long, b long, w long").withColumn("w", counted.asNondeterministic()("w"))
    got = {r.node: r.community for r in G.communities(edges, "a", "b", "w").collect()}
    labels = {n: n for r in rows for n in r[:2]}
    for _ in range(5):
        votes = {n: {} for n in labels}
        for a, b, w in rows:
            for x, y in ((a, b), (b, a)):
                votes[x][labels[y]] = votes[x].get(labels[y], 0) + w
        labels = {n: min(v, key=lambda c: (-v[c], c)) for n, v in votes.items()}
    assert got == labels and made.value == len(rows)


def test_media_networks_deal_their_links(spark, monkeypatch):
    """Each query on the media network joins links in tasks whose number grows with the links."""
    monkeypatch.setattr(entities, "LINKS_IN_TASK", 500)
    rows = entities.Entities(spark, SMALL).table("lineitem").count()
    seen, plain = [], P._edges

    def noted(e):
        edges = plain(e)
        seen.append(edges._jdf.queryExecution().executedPlan().toString().count(f", {-(-rows // 500)}), REPARTITION_BY_NUM"))
        return edges

    monkeypatch.setattr(P, "_edges", noted)
    names = ["communities", "communities_louvain", "community_modularity", "media_network", "ranked_edges"]
    for name in names:
        QUERIES[name].run(spark, SMALL)
    assert len(seen) == len(names) and min(seen) >= 6
