from pyspark.sql import functions as F

from tidings.functions import text, urls
from tidings.operators import graph, tables, topics
from tidings.operators.components import connected_components
from tidings.operators.words import word_counts
from tidings.sources import readers, sinks


def test_urls(spark):
    rows = [
        ("http://http://www.rye-gazette.com/fields", "http://www.rye-gazette.com/fields", "http://rye-gazette.com/fields", "rye-gazette.com"),
        ("HTTPS://News.Example.co.uk:443/A?utm_source=x&b=1#c", "https://news.example.co.uk/A?b=1", "http://example.co.uk:443/a?utm_source=x&b=1", "example.co.uk"),
        ("http://me.blogspot.com?x=&y=2", "http://me.blogspot.com/?x&y=2", "http://blogspot.com/?x=&y=2", "me.blogspot.com"),
        ("https://www.youtube.com/embed/abc?z=1", "https://www.youtube.com/embed/abc?z=1", "http://youtube.com/watch?v=abc", "youtube.com"),
        ("no url", None, "http://no%20url/", "no%20url"),
    ]
    u = F.col("u")
    df = spark.createDataFrame([(r[0],) for r in rows], "u string").select("u", urls.normalize_url(u), urls.normalize_url_lossy(u), urls.distinctive_domain(u))
    assert [tuple(r) for r in df.collect()] == rows
    flags = spark.createDataFrame([("http://bit.ly/aBc", True, False), ("http://a.com/", False, True), ("http://a.com/sports", False, True), ("http://a.com/2020/1/x.html", False, False), ("http://a.com/x.PDF", False, False)], "u string, short boolean, home boolean")
    assert all(r[0] == r[2] and r[1] == r[3] for r in flags.select("short", "home", urls.is_shortened_url(u), urls.is_homepage_url(u)).collect())


def test_text(spark):
    html = "<html><head><title>Home - A &amp; B</title></head><body><script>x()</script><p>One. Two!</p><div>Three</div><a href='http://x.com/a'>l</a></body></html>"
    row = spark.createDataFrame([(html,)], "h string").select(text.html_title(F.col("h")).alias("t"), text.html_strip(F.col("h")).alias("s"), text.page_links(F.col("h")).alias("l")).first()
    assert row.t == "A &amp; B" and row.s.split("\n") == ["One. Two!", "Three", "l"] and row.l == ["http://x.com/a"]
    got = spark.createDataFrame([("One two three. Four five six!\n[] {} <> [] {}\nok",)], "t string").select(text.sentences(F.col("t")).alias("s")).first().s
    assert got == ["One two three.", "Four five six!"]


def test_word_counts_are_capped(spark):
    rows = [(1, 0, "red red red red fox", "en"), (2, 0, "red red red red fox", "en"), (3, 0, "the fox 12", "en")]
    df = spark.createDataFrame(rows, "stories_id long, sentence_number long, sentence string, language string")
    assert {r.stem: r["count"] for r in word_counts(df).collect()} == {"red": 3, "fox": 2}
    assert {r.stem for r in word_counts(df, n=2).collect()} == {"red red", "red fox"}


def test_components_and_roots(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200), (None, 5), (300, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 300: 100}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)] + [(50, 51), (51, 50)], "k long, p long")
    assert {r.k: r.root for r in graph.roots(chain, "k", "p").collect()} == {i: 0 for i in range(20)}


def test_tables(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, tables.insert_ignore(t, spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, tables.update_where(t, F.col("k") == 2, v="z").collect())) == [(1, "a"), (2, "z")]
    assert sorted(map(tuple, tables.diff(t, spark.createDataFrame([(2, "c"), (4, "d")], "k int, v string"), "k", ["v"]).collect())) == [(1, "deleted"), (2, "modified"), (4, "added")]


def test_close_shares_meets_every_pair(spark):
    rows = [(1, 10 * k % 97, k * 40.0) for k in range(60)]
    df = spark.createDataFrame(rows, "author int, stories_id int, s double").select("author", "stories_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("publish_date"))
    want = {}
    for _, a, s in rows:
        for _, b, t in rows:
            if a > b and abs(s - t) <= 100:
                want[a, b] = min(abs(s - t), want.get((a, b), 1e9))
    assert {(r.a_id, r.b_id): r.seconds for r in topics.close_shares(df, 100).collect()} == want


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><link>http://x.com/2020/a</link><guid>http://x.com/</guid></item><item><link>http://x.com/2020/b</link><guid>g</guid></item></channel></rss>")
    assert sorted(map(tuple, readers.syndicated_feed(spark, str(tmp_path / "feed.xml")).select("url", "guid", "title").collect())) == [("http://x.com/2020/a", "http://x.com/2020/a", "A"), ("http://x.com/2020/b", "g", "(no title)")]
    (tmp_path / "posts.csv").write_text("content,author,channel,publish_date,post_id,url\nsee http://a.com/x.,me,,2024-01-02 00:00:00,1,\nold,me,c,2020-01-01 00:00:00,2,\n")
    posts = readers.csv_posts(spark, str(tmp_path / "posts.csv"), F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"))
    assert [(r.channel, r.post_id) for r in posts.collect()] == [("me", "1")]
    assert [r.url for r in readers.daily_posts(posts, "see").collect()] == ["http://a.com/x"]
    ann = spark.createDataFrame([(1, '{"people": ["P"], "labels": [{"label": "l", "score": 0.9}, {"label": "m", "score": 0.1}]}')], "stories_id int, annotation string")
    assert sorted(tuple(r)[1:] for r in readers.annotation_tags(ann).collect()) == [("labels", "l"), ("people", "P")]
    df = spark.range(3)
    assert sinks.snapshot_copy(df, str(tmp_path / "snap"), "snapshots_id", 7) and not sinks.snapshot_copy(df, str(tmp_path / "snap"), "snapshots_id", 7)
    assert spark.read.parquet(str(tmp_path / "snap")).filter("snapshots_id = 7").count() == 3
    xml = sinks.gexf(spark.createDataFrame([(1, "a&b", 2.0), (2, "c", 1.0)], "id int, label string, size double"), spark.createDataFrame([(1, 2, 3), (1, 9, 1)], "source int, target int, weight int"))
    assert xml.count("<node ") == 2 and xml.count("<edge ") == 1 and "a&amp;b" in xml


def test_language_of_a_long_text(spark):
    german = "der Hund und die Katze sind nicht auf dem Dach " * 600
    rows = [("the " + "qqqq " * 5000 + german, "de"), ("zzzz " * 5000 + german, "de"), ("qqqq " * 5000, "")]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in df.select(text.guess_language(F.col("t"))).collect()] == [w for _, w in rows]


def test_co_sharing_interval(spark):
    import datetime
    import random

    rng, day = random.Random(1), datetime.datetime(2024, 1, 1)
    posts = [(f"a{rng.randrange(6)}", rng.randrange(40), day + datetime.timedelta(seconds=rng.randrange(200 * 86400))) for _ in range(90)]
    gaps = {}
    for a, x, s in posts:
        for b, y, t in posts:
            if a == b and x > y:
                gaps[x, y] = min(abs((s - t).total_seconds()), gaps.get((x, y), 1e12))
    want = sorted((g, x, y) for (x, y), g in gaps.items())[:40]
    df = spark.createDataFrame(posts, "author string, stories_id long, publish_date timestamp_ntz")
    got = [(r.seconds, r.a_id, r.b_id) for r in topics.co_sharing_links(df, 40).collect()]
    assert len(want) == 40 and want[-1][0] > 3600 and got == want


def test_co_located_tables_join_without_a_shuffle(spark):
    from tidings.operators.storage import discard, materialize_sorted

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    a = materialize_sorted(spark.range(200).withColumnRenamed("id", "stories_id"), "co_a", ["stories_id"])
    b = materialize_sorted(spark.range(100, 300).withColumnRenamed("id", "stories_id"), "co_b", ["stories_id"])
    joined = a.join(b, "stories_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count() == 100 and "Exchange" not in plan
    discard(a)
    discard(b)


def test_atom_entries(spark, tmp_path):
    (tmp_path / "atom.xml").write_text('<feed><entry><title>A</title><link href="http://x.com/2020/a"/><id>tag:1</id><updated>2024-01-02</updated><summary>s</summary></entry></feed>')
    got = readers.syndicated_feed(spark, str(tmp_path / "atom.xml"), "entry").collect()
    assert [tuple(r) for r in got] == [("http://x.com/2020/a", "tag:1", "A", "s", "2024-01-02")]


def test_exact_search_and_medians(spark):
    from tidings.functions.boolean import predicate
    from tidings.operators.graph import element_at

    df = spark.createDataFrame([(1, "rye then oats"), (2, "the oats and more and more rye"), (3, "thence")], "id int, text string")
    ids = lambda q: [r.id for r in df.filter(predicate(q, exact=True)).orderBy("id").collect()]
    assert ids("the") == [2] and ids("the*") == [1, 2, 3] and ids('"rye oats"~1') == [1] and ids('"oats rye"~9') == [1, 2]
    for values in ([5.0], [1.0, 1.0, 9.0], [3.0, -2.0, 8.0, 8.0], [float(i * i % 97) for i in range(200)]):
        got = element_at(spark.createDataFrame([(v,) for v in values], "v double"), "v", 4).first()[0]
        assert got == sorted(values)[len(values) // 2]


def test_words_and_language_of_other_scripts(spark):
    rows = [("今天天气很好", "zh", "zh"), ("これは本です", "ja", "ja"), ("это не то что было в доме", "ru", "ru"), ("यह एक किताब है और वह नहीं", "hi", "hi"), ("het huis is van een man die niet in de stad was", "nl", "nl")]
    df = spark.createDataFrame(rows, "t string, language string, guess string")
    assert [r[0] for r in df.select(text.guess_language(F.col("t"))).collect()] == [r[2] for r in rows]
    kept = df.select(text.drop_stop_words(text.words(F.col("t")), F.col("language")))
    assert kept.collect()[4][0] == ["huis", "man", "stad"]
