"""Health of media sources from counts per day (``medium, stat_date, num_stories, num_sentences``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Best weeks that make the expected volume; the share of it under which a week is a gap or a medium ill.
BEST_WEEKS, HEALTHY_RATIO = 20, 0.25


def media_weeks(daily: DataFrame) -> DataFrame:
    """Every medium with every week, from Monday, that the dates span."""
    span = daily.agg(F.min("stat_date").alias("lo"), F.max("stat_date").alias("hi"))
    weeks = span.select(F.explode(F.sequence(F.date_trunc("week", "lo").cast("date"), F.col("hi"), F.expr("interval 7 days"))).alias("week"))
    return daily.select("medium").distinct().crossJoin(F.broadcast(weeks))


def weekly(daily: DataFrame) -> DataFrame:
    """Averages per day of each week, and the ranks of a medium's weeks by stories and by sentences."""
    rows = daily.groupBy("medium", F.date_trunc("week", "stat_date").cast("date").alias("week")).agg(F.round(F.sum("num_stories") / 7, 2).alias("num_stories"), F.round(F.sum("num_sentences") / 7, 2).alias("num_sentences"))
    rank = lambda c: F.row_number().over(Window.partitionBy("medium").orderBy(F.desc(c), "week"))
    return rows.withColumn("stories_rank", rank("num_stories")).withColumn("sentences_rank", rank("num_sentences"))


def expected_volume(weeks: DataFrame) -> DataFrame:
    """The mean of the best weeks, and the first and last week of healthy volume."""
    best = weeks.groupBy("medium").agg(F.round(F.avg(F.when(F.col("stories_rank") <= BEST_WEEKS, F.col("num_stories"))), 2).alias("expected_stories"), F.round(F.avg(F.when(F.col("sentences_rank") <= BEST_WEEKS, F.col("num_sentences"))), 2).alias("expected_sentences"))
    fine = weeks.join(best, "medium").filter(F.col("num_stories") > F.col("expected_stories") * HEALTHY_RATIO).groupBy("medium").agg(F.min("week").alias("start_week"), F.max("week").alias("end_week"))
    return best.join(fine, "medium", "left")


def coverage_gaps(daily: DataFrame) -> DataFrame:
    """Weeks between a medium's healthy ends that are under the ratio, missing weeks as 0."""
    weeks = weekly(daily)
    rows = media_weeks(daily).join(weeks.select("medium", "week", "num_stories"), ["medium", "week"], "left").withColumn("num_stories", F.coalesce("num_stories", F.lit(0.0)))
    rows = rows.join(expected_volume(weeks), "medium")
    return rows.filter((F.col("num_stories") < F.col("expected_stories") * HEALTHY_RATIO) & F.col("week").between(F.col("start_week"), F.col("end_week"))).select("medium", "week", "num_stories", "expected_stories")


def media_health(daily: DataFrame) -> DataFrame:
    """Day, week, 90 days and year averages up to the last day of the data."""
    last = F.broadcast(daily.agg(F.max("stat_date").alias("today")))
    age = F.datediff("today", "stat_date")
    rows = daily.crossJoin(last)
    out = []
    for c in ("num_stories", "num_sentences"):
        for name, days in (("", 1), ("_w", 7), ("_90", 90), ("_y", 365)):
            out.append(F.round(F.coalesce(F.sum(F.when(age < days, F.col(c))), F.lit(0)) / days, 2).alias(c + name))
    return rows.groupBy("medium").agg(*out)


def health_status(health: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Ill: much less in the last week than in 90 days or a year, or nothing at all in 90 days.

    ``feeds`` (medium, active) tells who has an active feed; without it more than one story in 90 days does.
    """
    falls = F.lit(False)
    for c in ("num_stories", "num_sentences"):
        for base in ("_y", "_90"):
            falls = falls | (F.col(f"{c}_w") / F.greatest(F.col(c + base), F.lit(1.0)) < HEALTHY_RATIO)
    ill = ((F.col("num_stories_90") > 10) & falls) | (F.col("num_sentences_90") == 0)
    rows = health.withColumn("is_healthy", ~ill)
    if feeds is None:
        return rows.withColumn("has_active_feed", F.col("num_stories_90") > 1)
    active = feeds.groupBy("medium").agg(F.max("active").alias("has_active_feed"))
    return rows.join(active, "medium", "left").withColumn("has_active_feed", F.coalesce("has_active_feed", F.lit(False)))


def health_report(status: DataFrame, worst: int = 50) -> DataFrame:
    return status.orderBy("is_healthy", F.desc("num_stories_90"), "medium").limit(worst)


def primary_language(stories: DataFrame) -> DataFrame:
    """The language of more than half of a medium's stories, else ``none``."""
    counts = stories.groupBy("media_id", "language").agg(F.count("*").alias("n"))
    return counts.groupBy("media_id").agg(F.sum("n").alias("total"), F.max_by("language", "n").alias("language"), F.max("n").alias("n")).select("media_id", F.when(F.col("n") * 2 > F.col("total"), F.col("language")).otherwise("none").alias("primary_language"))


def ready_media(feeds: DataFrame, stories: DataFrame, least: int = 102) -> DataFrame:
    """Media with an active feed and at least ``least`` stories."""
    enough = stories.groupBy("media_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return enough.join(feeds.filter("active"), "media_id", "left_semi").select("media_id")


def feeds_swap(old: DataFrame, new: DataFrame) -> DataFrame:
    """New feeds in; web pages off where the medium has an active syndicated one."""
    rows = old.unionByName(new.join(old.select("feeds_id"), "feeds_id", "left_anti"))
    syndicated = rows.filter("active and type = 'syndicated'").select("media_id").distinct().withColumn("s", F.lit(True))
    return rows.join(syndicated, "media_id", "left").withColumn("active", F.when((F.col("type") == "web_page") & F.col("s"), False).otherwise(F.col("active"))).select(*old.columns)


def error_percentage(rows: DataFrame, failed) -> DataFrame:
    return rows.agg(F.coalesce(F.round(F.lit(100.0) * F.count_if(failed) / F.nullif(F.count("*"), F.lit(0)), 1), F.lit(0.0)).alias("percent"))


def due_feeds(feeds: DataFrame, now) -> DataFrame:
    """Feeds to fetch again: after the time that the last try came behind the last new story, and 5 minutes; at most a week."""
    wait = F.least(F.unix_timestamp("last_try") - F.unix_timestamp("last_new") + 300, F.lit(7 * 86400))
    ready = F.col("last_try").isNull() | (F.unix_timestamp("last_try") + F.coalesce(wait, F.lit(300)) <= F.unix_timestamp(now))
    return feeds.filter(F.col("active") & ready)
