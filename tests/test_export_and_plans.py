"""The closed export against plain Python, and plans on skewed tables."""

import datetime as dt

from pyspark.sql import functions as F

from tidings.functions import dates, sql
from tidings.operators import mining as M
from tidings.operators import topics as T
from tidings.operators.export import Reference, closed_subset


def test_closed_export(spark):
    media = [(i, i // 2 if i and i % 3 else None) for i in range(40)]
    stories = [(i, i % 40) for i in range(200)] + [(500, 99), (501, None)]
    links = [(i, i * 7 % 200, i * 11 % 200) for i in range(150)]
    tables = {
        "media": spark.createDataFrame(media, "media_id long, dup long"),
        "stories": spark.createDataFrame(stories, "stories_id long, media_id long"),
        "links": spark.createDataFrame(links, "links_id long, a long, b long"),
        "unused": spark.createDataFrame([(1,)], "x long"),
    }
    keys = {"media": "media_id", "stories": "stories_id", "links": "links_id", "unused": "x"}
    refs = [Reference("stories", "media_id", "media"), Reference("media", "dup", "media"), Reference("links", "a", "stories", True), Reference("links", "b", "stories")]
    out = closed_subset(tables, keys, refs, {"stories": spark.createDataFrame([(3,), (500,), (501,), (9999,)], "stories_id long")})
    got = {t: {r[0] for r in out[t].select(keys[t]).collect()} for t in tables}
    kept = {"stories": {3, 500, 501}, "media": set(), "links": set()}
    while True:
        before = sum(map(len, kept.values()))
        kept["links"] |= {i for i, a, _ in links if a in kept["stories"]}
        kept["stories"] |= {x for i, a, b in links if i in kept["links"] for x in (a, b)}
        kept["media"] |= {m for s, m in stories if s in kept["stories"] and m is not None and m < 40}
        kept["media"] |= {d for m, d in media if m in kept["media"] and d is not None}
        if sum(map(len, kept.values())) == before:
            break
    assert got == {**kept, "unused": set()}
    assert out["links"].columns == ["links_id", "a", "b"]


def test_top_tenth_where_nearly_all_tie(spark):
    rows = [(i, 0 if i >= 30 else 5, i % 7) for i in range(2000)]
    wanted = -(-len(rows) // 10)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    bar = order[wanted][2] - 1
    got = T.top_tenth(spark.createDataFrame(rows, "stories_id long, media_inlinks long, inlinks long"))
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in order[:wanted] if r[2] > bar)
    assert T.top_tenth(spark.createDataFrame([], "stories_id long, media_inlinks long, inlinks long")).count() == 0


def test_one_url_with_very_many_stories(spark):
    day = F.expr("date_add(date'2024-01-01', cast(id as int))").cast("timestamp")
    stories = spark.range(5000).select(F.col("id").alias("stories_id"), (F.col("id") % 3).alias("media_id"), F.lit("http://a.com/home").alias("url"), F.lit(None).cast("string").alias("guid"), day.alias("publish_date"))
    media = spark.createDataFrame([(0, None, False), (1, 0, False), (2, None, True)], "media_id long, dup_media_id long, foreign_rss_links boolean")
    asked = spark.createDataFrame([("http://a.com/home", None), ("http://b.com/x", None)], "url string, redirect_url string")
    found = M.match_stories(asked, stories, media)
    newest = [i for i in range(4999, -1, -1) if i % 3 != 2][:100]
    assert [(r.url, r.stories_id) for r in found.collect()] == [("http://a.com/home", min(i for i in newest if i % 3 == 0))]
    assert "WindowGroupLimit" in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_labels_of_many_media_tell_nothing(spark):
    media = spark.createDataFrame([(i, f"http://www.host{i}.platform.com/", "n") for i in range(20)] + [(50, "http://gazette.com/", "x"), (51, "http://news.org/", "the gazette")], "media_id long, url string, name string")
    assert {tuple(r) for r in M.merge_candidates(media, 10).collect()} == {(50, 51)}
    assert M.merge_candidates(media).count() == 20 * 19 + 1


def test_dates_of_pages(spark):
    rows = [
        ("http://x.com/2024/01/02/a", '<meta name="date" content="2023-05-06">', dt.date(2023, 5, 6), "guess_by_meta_date"),
        ("http://x.com/2024/01/02/a", '<meta name="date" content="soon">', dt.date(2024, 1, 2), "guess_by_url"),
        ("http://x.com/a", "<p>Updated <i>on</i> 3rd Feb. 2021</p>", dt.date(2021, 2, 3), "guess_by_text"),
        ("http://x.com/a", "<p>Posted May 31st, 2020</p>", dt.date(2020, 5, 31), "guess_by_text"),
        ("http://x.com/a", "<p>in March 2020 we published 30 February 2020</p>", None, "undateable"),
        (None, None, None, "undateable"),
    ]
    df = spark.createDataFrame(rows, "url string, html string, day date, method string")
    for r in df.withColumn("g", dates.guess_date(F.col("url"), F.col("html"))).collect():
        assert (r.g.day, r.g.method) == (r.day, r.method), r


def test_sql_functions(spark):
    sql.register(spark)
    sql.register(spark)
    (r,) = spark.sql("SELECT half_md5('a') h, week_start_date(DATE'2024-01-03') w, month_start_date(DATE'2024-02-03') m, next_day_of(DATE'2024-02-29') n, url_host('https://u@A.com:80/x') u, in_period(TIMESTAMP'2024-01-01', TIMESTAMP'2024-01-01', TIMESTAMP'2024-01-01 00:00:01') p, in_period(TIMESTAMP'2024-01-01 00:00:01', TIMESTAMP'2024-01-01', TIMESTAMP'2024-01-01 00:00:01') q, word_starts('Old Ryes (x', 'ryes (') s, word_starts('bryes', 'rye') t").collect()
    assert tuple(r) == ("0cc175b9c0f1b6a8", dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 3, 1), "a.com", True, False, True, False)
    assert [tuple(x) for x in spark.sql("SELECT * FROM weeks_between(DATE'2024-01-03', DATE'2024-01-09')").collect()] == [(dt.date(2024, 1, 1), dt.date(2024, 1, 8)), (dt.date(2024, 1, 8), dt.date(2024, 1, 15))]
