"""Structured Streaming forms: deduplication on arrival, index changes, daily loads, rolling counts, throttles, domain locks, job states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from tidings.operators.index import SearchIndex
from tidings.operators.storage import path_exists


def story_stream_dedup(stories: DataFrame, keys: list[str], time: str = "collect_date", late: str = "7 days") -> DataFrame:
    """Stories that are new by their keys within the watermark."""
    return stories.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sentence_stream_dedup(sentences: DataFrame, late: str = "14 days") -> DataFrame:
    """The first of each medium's equal sentences of a week; state goes when its weeks are past."""
    keyed = sentences.withColumn("week", F.date_trunc("week", "publish_date")).withColumn("h", F.md5("sentence"))
    return keyed.withWatermark("week", late).dropDuplicates(["media_id", "week", "h"])


def rolling_counts(rows: DataFrame, time: str, key: str, size: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    return rows.withWatermark(time, late).groupBy(F.window(time, size, slide), key).agg(F.count("*").alias("n"))


def index_delta(changes: DataFrame, index: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write changed search documents batch by batch, snapshot stories first, then the newest ids; a batch that is redone replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("stories_id").agg(F.max_by(F.struct(*batch.columns), "changed").alias("d")).select("d.*")
        last.orderBy(F.desc("in_snapshot"), F.desc("stories_id")).write.mode("overwrite").parquet(f"{index}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def index_stream(changes: DataFrame, index: SearchIndex, checkpoint: str) -> StreamingQuery:
    """Add each batch of ``stories_id, text[, deleted][, changed]`` to a levelled index; a batch that is redone changes nothing."""
    return changes.writeStream.foreachBatch(lambda batch, number: index.add(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Days that must have passed, by the newest post seen, before a day counts as complete.
LATE_DAYS = 1


def load_days(batch: DataFrame, number: int, path: str) -> None:
    """Add a batch of posts to the days under ``path``: ``posts/day=/batch=`` and, for each batch, its marks.

    A batch writes its own partitions only. One that is redone replaces itself, and posts that another batch
    has loaded for the same day are left out; so late, split and repeated batches neither lose nor repeat a
    post. The mark of a batch says which days it has added to and how far the posts had come by then.
    """
    spark = batch.sparkSession
    rows = batch.filter("post_id is not null").withColumn("day", F.to_date("publish_date")).dropDuplicates(["post_id"])
    if path_exists(spark, f"{path}/posts"):
        there = spark.read.option("basePath", f"{path}/posts").parquet(f"{path}/posts").filter(F.col("batch") != number)
        rows = rows.join(there.select("day", "post_id"), ["day", "post_id"], "left_anti").select(*batch.columns, "day")
    rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/posts")
    seen = batch.groupBy(F.to_date("publish_date").alias("day")).agg(F.max("publish_date").alias("high"))
    seen.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/marks")


def daily_load(posts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Load a stream of posts by day; see ``load_days`` and ``loaded_days``."""
    return posts.writeStream.foreachBatch(lambda batch, number: load_days(batch, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loaded_days(spark: SparkSession, path: str, late: int = LATE_DAYS) -> DataFrame:
    """``day, posts, complete``: a day is complete once a post has been seen that is ``late`` days younger than its end."""
    marks = spark.read.parquet(f"{path}/marks")
    high = F.broadcast(marks.agg(F.to_date(F.max("high")).alias("high")))
    counts = spark.read.parquet(f"{path}/posts").groupBy("day").agg(F.count("*").alias("posts"))
    return counts.crossJoin(high).select("day", "posts", (F.datediff("high", "day") > late).alias("complete"))


def add_new(totals: DataFrame | None, rows: DataFrame, mark, key: str, by: list[str], column: str) -> tuple[DataFrame, object]:
    """Totals of ``column`` by ``by`` with the rows whose ``key`` is beyond ``mark`` added, and the new mark: an increment that a repeat leaves as it is."""
    fresh = rows if mark is None else rows.filter(F.col(key) > F.lit(mark))
    sums = fresh.groupBy(*by).agg(F.sum(column).alias(column))
    whole = sums if totals is None else totals.select(*by, column).unionByName(sums).groupBy(*by).agg(F.sum(column).alias(column))
    return whole, fresh.agg(F.max(key)).first()[0] or mark


def throttle(pending: DataFrame, most: int = 10_000) -> DataFrame:
    """For each tick: one download of each host, by priority, then the newest; at most ``most``."""
    w = Window.partitionBy("host").orderBy("priority", F.desc("downloads_id"))
    return pending.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k").orderBy("priority", "downloads_id").limit(most)


class _Lock(StatefulProcessor):
    """The last grant of a domain, forgotten when it is too old to matter."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp", ttlDurationMs=None)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows of a batch are granted in their order of time."""
        asked = pd.concat(list(rows))["at"].sort_values()
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for at in asked:
            fine = last is None or (at - pd.Timestamp(last)).total_seconds() >= self.seconds
            out.append(fine)
            last = at if fine else last
        self.last.update((pd.Timestamp(last).to_pydatetime(),))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(pd.Timestamp(last).timestamp() * 1000) + self.seconds * 1000)
        yield pd.DataFrame({"domain": key[0], "at": asked.to_numpy(), "granted": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def domain_lock(requests: DataFrame, seconds: int, late: str = "1 minute") -> DataFrame:
    """``domain, at, granted``: a request is granted when the domain's last grant is ``seconds`` old.

    The lock of a domain is state with a timer in event time: once the watermark is past it, it is dropped,
    so the state holds the domains of the last ``seconds`` only. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = requests.withWatermark("at", late).groupBy("domain")
    return keyed.transformWithStateInPandas(_Lock(seconds), "domain string, at timestamp, granted boolean", "Append", "EventTime")


#: States of a job, and those that it may take from each.
JOB_MOVES = {None: ("queued", "running"), "queued": ("running", "error"), "running": ("running", "completed", "error"), "completed": (), "error": ("queued",)}


class _Job(StatefulProcessor):
    """The state of a job; a running one from which nothing is heard for ``silent`` seconds is an error."""

    def __init__(self, silent: int):
        self.silent = silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string, message string, at timestamp")
        self.handle = handle

    def _answer(self, key, state: str, message: str | None, at) -> pd.DataFrame:
        return pd.DataFrame({"job": [key[0]], "state": [state], "message": [message], "at": [pd.Timestamp(at)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.now.get() if self.now.exists() else (None, None, None)
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            if r.state in JOB_MOVES[now[0]]:
                now = (r.state, r.message, r.at.to_pydatetime())
                yield self._answer(key, *now)
        if now[0] is None:
            return
        self.now.update(now)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if now[0] in ("queued", "running"):
            self.handle.registerTimer(int(pd.Timestamp(now[2]).timestamp() * 1000) + self.silent * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        self.now.update(("error", "not heard of", at.to_pydatetime()))
        yield self._answer(key, "error", "not heard of", at)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, silent: int, late: str = "1 minute") -> DataFrame:
    """``job, state, message, at``: the moves of each job between its states, from ``job, state, message, at``.

    Moves that a state does not allow are left out. A queued or running job that is silent for ``silent``
    seconds of event time becomes an error by a timer. The newest row of a job is its state; see ``latest_jobs``.
    """
    keyed = events.withWatermark("at", late).groupBy("job")
    return keyed.transformWithStateInPandas(_Job(silent), "job string, state string, message string, at timestamp", "Append", "EventTime")


def latest_jobs(moves: DataFrame) -> DataFrame:
    return moves.groupBy("job").agg(F.max_by("state", "at").alias("state"), F.max_by("message", "at").alias("message"), F.max("at").alias("at"))


class StreamStatus(StreamingQueryListener):
    """Each stream's own state as rows ``stream, state, rows, message`` in ``self.rows``: queued by its start, running, completed or error."""

    def __init__(self):
        self.rows: dict[str, tuple] = {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = (str(event.id), "queued", 0, None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.id)] = (str(p.id), "running", self.rows.get(str(p.id), (0, 0, 0))[2] + p.numInputRows, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        old = self.rows.get(str(event.id), (0, 0, 0))
        self.rows[str(event.id)] = (str(event.id), "error" if event.exception else "completed", old[2], event.exception)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows.values()), "stream string, state string, rows long, message string")


def stale_to_pending(downloads: DataFrame, now, hours: int = 24) -> DataFrame:
    """Downloads that are being fetched for too long are pending again."""
    stale = (F.col("state") == "fetching") & (F.col("download_time") < now - F.expr(f"interval {hours} hours"))
    return downloads.withColumn("state", F.when(stale, "pending").otherwise(F.col("state")))
