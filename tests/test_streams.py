import datetime as dt
import time

import pytest

from tidings.streaming import streams


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def source(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def test_dedup_and_counts(spark, tmp_path):
    day = dt.datetime(2024, 1, 3)
    rows = [(1, 5, "same sentence", day), (2, 5, "same sentence", day), (3, 6, "same sentence", day), (4, 5, "same sentence", day + dt.timedelta(days=7))]
    schema = "stories_id int, media_id int, sentence string, publish_date timestamp"
    got = run(streams.sentence_stream_dedup(source(spark, tmp_path / "a", rows, schema)), "dedup")
    assert sorted((r.media_id, r.publish_date.day) for r in got) == [(5, 3), (5, 10), (6, 3)]
    got = run(streams.story_stream_dedup(source(spark, tmp_path / "b", rows, schema), ["media_id", "sentence"], "publish_date"), "stories")
    assert len(got) == 2
    got = run(streams.rolling_counts(source(spark, tmp_path / "c", rows, schema), "publish_date", "media_id"), "rolling", "complete")
    assert sum(r.n for r in got) == 7 * 4


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_delta(spark, tmp_path):
    rows = [(1, 1, False, "x"), (1, 2, False, "y"), (2, 1, True, "z")]
    q = streams.index_delta(source(spark, tmp_path / "e", rows, "stories_id int, changed int, in_snapshot boolean, text string"), str(tmp_path / "index"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted((r.stories_id, r.text) for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [(1, "y"), (2, "z")]


def test_domain_locks_expire(rocks, tmp_path):
    spark, path, schema = rocks, str(tmp_path / "requests"), "domain string, at timestamp"
    batches = [[("a", at(0)), ("a", at(3)), ("a", at(12)), ("b", at(1))], [("c", at(500))], [("a", at(501)), ("c", at(505))]]
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        out = streams.domain_lock(spark.readStream.schema(schema).parquet(path), 10, "5 seconds")
        q = out.writeStream.foreachBatch(lambda batch, n: got.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    want = [("a", at(0), True), ("a", at(3), False), ("a", at(12), True), ("b", at(1), True), ("c", at(500), True), ("a", at(501), True), ("c", at(505), False)]
    assert sorted(got) == sorted(want)
    held = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "ck"))
    assert {r.key.domain for r in held.collect()} == {"a", "c"}  # b's lock has expired


def test_job_states(rocks, tmp_path):
    spark, path, schema = rocks, str(tmp_path / "jobs"), "job string, state string, message string, at timestamp"
    batches = [[("1", "queued", None, at(0)), ("1", "running", None, at(5)), ("1", "completed", "ok", at(9)), ("2", "completed", None, at(1)), ("2", "running", None, at(2)), ("3", "queued", None, at(3))], [("1", "running", None, at(400)), ("4", "running", None, at(401))], [("3", "queued", "again", at(410)), ("4", "running", "half", at(411)), ("4", "error", "x", at(412))]]
    got = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        out = streams.job_states(spark.readStream.schema(schema).parquet(path), 60, "5 seconds")
        q = out.writeStream.foreachBatch(lambda batch, n: got.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    moves = spark.createDataFrame(got, schema)
    assert {(r.job, r.state, r.message) for r in streams.latest_jobs(moves).collect()} == {("1", "completed", "ok"), ("2", "error", "not heard of"), ("3", "queued", "again"), ("4", "error", "x")}
    assert ("3", "error", "not heard of") in {g[:3] for g in got}


def test_late_and_redone_batches_keep_all_posts(spark, tmp_path):
    path, schema = str(tmp_path / "days"), "post_id int, publish_date timestamp, content string"
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    first = spark.createDataFrame([(i, day(3, i), "x") for i in range(5)], schema)
    second = spark.createDataFrame([(i, day(3, i), "x") for i in range(3, 8)] + [(20, day(6, 1), "y"), (20, day(6, 1), "y"), (None, day(3, 1), "z")], schema)
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):  # both are redone
        streams.load_days(batch, number, path)
        assert spark.read.parquet(f"{path}/posts").count() == (5 if number == 0 and batch is first and not (tmp_path / "days/marks/batch=1").exists() else 9)
    assert sorted(r.post_id for r in spark.read.parquet(f"{path}/posts").collect()) == [*range(8), 20]
    assert {(r.day.day, r.posts, r.complete) for r in streams.loaded_days(spark, path).collect()} == {(3, 8, True), (6, 1, False)}


def test_increments_by_a_mark(spark):
    rows = [(1, "a", 2), (2, "b", 3), (3, "a", 5)]
    df = spark.createDataFrame(rows, "id int, medium string, n int")
    totals, mark = streams.add_new(None, df.filter("id < 3"), None, "id", ["medium"], "n")
    for _ in range(2):
        totals, mark = streams.add_new(totals, df, mark, "id", ["medium"], "n")
    assert mark == 3 and {tuple(r) for r in totals.collect()} == {("a", 7), ("b", 3)}


def test_stream_status(spark, tmp_path):
    status = streams.StreamStatus()
    spark.streams.addListener(status)
    run(source(spark, tmp_path / "s", [(1,), (2,)], "x int"), "plain")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    for _ in range(50):
        if [r[1] for r in status.rows.values()] == ["completed"]:
            break
        time.sleep(0.2)
    spark.streams.removeListener(status)
    assert [(r.state, r.rows) for r in status.table(spark).collect()] == [("completed", 2)]
