import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidings.sources import post_source


@pytest.fixture
def posts(spark, tmp_path):
    post_source.register(spark)
    rows = [{"id": i, "author": f"a{i % 3}", "text": "é" * (i % 7) + f" post {i}", "date": f"2024-01-{1 + i % 28:02d}T10:00:00", "url": None} for i in range(500)]
    for k in range(3):
        (tmp_path / f"part{k}.json").write_text("".join(json.dumps(r, ensure_ascii=k == 0) + "\n" for r in rows[k::3]) + ("not json\n[1]\n{}\n" if k == 1 else ""), encoding="utf-8")
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path), rows


def test_every_line_is_read_once_in_stretches(spark, posts):
    path, rows = posts
    df = spark.read.format("saved_posts").option("path", path).option("stretch", 701).load()
    assert df.rdd.getNumPartitions() > 20
    got = {(r.post_id, r.author, r.channel, r.content) for r in df.collect()}
    assert got == {(str(r["id"]), r["author"], r["author"], r["text"]) for r in rows} and df.count() == 500


def test_filters_are_taken(spark, posts):
    path, rows = posts
    df = spark.read.format("saved_posts").option("path", path).load()
    kept = df.filter((F.col("author") == "a1") & (F.col("publish_date") >= F.lit(dt.datetime(2024, 1, 20))) & F.contains("content", F.lit("post 1")))
    want = [r for r in rows if r["author"] == "a1" and r["date"] >= "2024-01-20" and "post 1" in r["text"]]
    assert sorted(r.post_id for r in kept.collect()) == sorted(str(r["id"]) for r in want)


def test_platforms(spark, tmp_path):
    post_source.register(spark)
    lines = [{"id_str": "7", "user": {"screen_name": "me"}, "full_text": "hi", "created_at": "Wed Jan 03 10:00:00 +0000 2024"}, {"id_str": "8", "user": {}, "text": "yo", "created_at": "soon"}]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, lines)))
    got = spark.read.format("saved_posts").options(path=str(tmp_path), platform="twitter").load().orderBy("post_id").collect()
    assert [(r.post_id, r.author, r.content, r.publish_date and r.publish_date.day) for r in got] == [("7", "me", "hi", 3), ("8", None, "yo", None)]
    (tmp_path / "t.json").write_text(json.dumps({"id": "x", "selftext": "body", "created_utc": 1704276000, "author": "u", "subreddit": "s", "where": {"at": "http://a.com"}}))
    (r,) = spark.read.format("saved_posts").options(path=str(tmp_path), platform="reddit", field_url="where.at").load().collect()
    assert (r.post_id, r.channel, r.content, r.publish_date.year, r.url) == ("x", "s", "body", 2024, "http://a.com")


def test_stream_reads_new_files(spark, posts, tmp_path_factory):
    path, rows = posts
    marks, got = str(tmp_path_factory.mktemp("marks")), []
    for more in (0, 1):
        if more:
            (tmp_path_factory.getbasetemp() / "x").write_text("")
            with open(f"{path}/part9.json", "w") as f:
                f.write(json.dumps({"id": 900, "author": "n", "text": "new", "date": 1704276000}))
        q = spark.readStream.format("saved_posts").option("path", path).load().writeStream.foreachBatch(lambda b, n: got.extend(r.post_id for r in b.collect())).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(got, key=int) == [*map(str, range(500)), "900"]
