"""Health of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators import health as H
from tidings.plans.registry import entity_query as query
from tidings.streaming import streams

WEEKS = ", weeks AS (SELECT medium, CAST(date_trunc('week', stat_date) AS DATE) AS week, round(sum(num_stories) / 7.0, 2) AS num_stories, round(sum(num_sentences) / 7.0, 2) AS num_sentences FROM daily GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY medium ORDER BY num_stories DESC, week) AS stories_rank, row_number() OVER (PARTITION BY medium ORDER BY num_sentences DESC, week) AS sentences_rank FROM weeks) "
EXPECTED = WEEKS.rstrip() + ", best AS (SELECT medium, round(avg(num_stories) FILTER (stories_rank <= 20), 2) AS expected_stories, round(avg(num_sentences) FILTER (sentences_rank <= 20), 2) AS expected_sentences FROM ranked GROUP BY 1), expected AS (SELECT b.*, start_week, end_week FROM best b LEFT JOIN (SELECT medium, min(week) AS start_week, max(week) AS end_week FROM ranked JOIN best USING (medium) WHERE num_stories > expected_stories * 0.25 GROUP BY 1) USING (medium)) "
HEALTH = ", health AS (SELECT medium, " + ", ".join(f"round(coalesce(sum({c}) FILTER (date_diff('day', stat_date, today) < {d}), 0) / {d}.0, 2) AS {c}{n}" for c in ("num_stories", "num_sentences") for n, d in (("", 1), ("_w", 7), ("_90", 90), ("_y", 365))) + " FROM daily, (SELECT max(stat_date) AS today FROM daily) GROUP BY 1), status AS (SELECT *, NOT ((num_stories_90 > 10 AND (" + " OR ".join(f"{c}_w / greatest({c}_{b}, 1) < 0.25" for c in ("num_stories", "num_sentences") for b in ("y", "90")) + ")) OR num_sentences_90 = 0) AS is_healthy, num_stories_90 > 1 AS has_active_feed FROM health) "


@query("health_weekly_ranks", WEEKS + "SELECT * FROM ranked")
def _(e):
    return H.weekly(e.daily)


@query("health_expected_volume", EXPECTED + "SELECT * FROM expected")
def _(e):
    return H.expected_volume(H.weekly(e.daily))


#: The click counts of two weeks are left out, so that there are gaps to find.
HOLED = EXPECTED.replace("FROM daily", "FROM holed").replace(", weeks AS", ", holed AS (SELECT * FROM daily WHERE NOT (medium = 'click' AND day(stat_date) BETWEEN 8 AND 21)), weeks AS", 1)


@query("health_gaps", HOLED + "SELECT x.medium, g.week, coalesce(w.num_stories, 0) AS num_stories, x.expected_stories FROM expected x CROSS JOIN (SELECT CAST(unnest(generate_series(date_trunc('week', min(stat_date)), CAST(max(stat_date) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week FROM holed) g LEFT JOIN weeks w ON w.medium = x.medium AND w.week = g.week WHERE coalesce(w.num_stories, 0) < x.expected_stories * 0.25 AND g.week BETWEEN x.start_week AND x.end_week")
def _(e):
    return H.coverage_gaps(e.daily.filter("not (medium = 'click' and day(stat_date) between 8 and 21)"))


@query("health_table", HEALTH + "SELECT * EXCLUDE (is_healthy, has_active_feed) FROM status")
def _(e):
    return H.media_health(e.daily)


@query("health_status", HEALTH + "SELECT * FROM status")
def _(e):
    return H.health_status(H.media_health(e.daily))


@query("health_report", HEALTH + "SELECT * FROM status ORDER BY is_healthy, num_stories_90 DESC, medium LIMIT 3")
def _(e):
    return H.health_report(H.health_status(H.media_health(e.daily)), 3)


@query("crawled_media", "SELECT media_id FROM media m WHERE EXISTS (SELECT 1 FROM feeds f WHERE f.media_id = m.media_id AND type = 'syndicated' AND active)")
def _(e):
    return e.media.join(e.feeds.filter("active and type = 'syndicated'"), "media_id", "left_semi").select("media_id")


@query("ready_media", "SELECT media_id FROM stories GROUP BY 1 HAVING count(*) >= 40 AND media_id IN (SELECT media_id FROM feeds WHERE active)")
def _(e):
    return H.ready_media(e.feeds, e.stories, 40)


@query("untagged_media", "SELECT m.media_id FROM media m WHERE media_id NOT IN (SELECT media_id FROM media_tags WHERE tags_id >= 200) AND media_id IN (SELECT media_id FROM stories GROUP BY 1 HAVING count(*) > 10)")
def _(e):
    enough = e.stories.groupBy("media_id").agg(F.count("*").alias("n")).filter("n > 10")
    return e.media.join(e.media_tags.filter("tags_id >= 200"), "media_id", "left_anti").join(enough, "media_id", "left_semi").select("media_id")


@query("feeds_swap", "SELECT feeds_id, media_id, type, CASE WHEN type = 'web_page' AND media_id IN (SELECT media_id FROM feeds WHERE active AND type = 'syndicated') THEN false ELSE active END AS active FROM feeds")
def _(e):
    return H.feeds_swap(e.feeds, e.feeds.limit(0))


@query("error_percentage", "SELECT round(100.0 * count(*) FILTER (event_type = 'error') / nullif(count(*), 0), 1) AS percent FROM events")
def _(e):
    return H.error_percentage(e.table("events"), F.col("event_type") == "error")


@query("volume_checks", "SELECT (SELECT count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS last_day, (SELECT count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR) AS last_hours, (SELECT count(*) FROM feeds) AS feeds")
def _(e):
    ev = e.table("events").select("ts")
    last = F.broadcast(ev.agg(F.max("ts").alias("last")))
    counts = ev.crossJoin(last).agg(F.count_if(F.expr("ts >= last - interval 1 day")).alias("last_day"), F.count_if(F.expr("ts >= last - interval 2 hours")).alias("last_hours"))
    return counts.crossJoin(F.broadcast(e.feeds.agg(F.count("*").alias("feeds"))))


@query("stale_feeds", "SELECT author FROM (SELECT author, max(publish_date) AS last_new FROM posts GROUP BY 1) WHERE last_new < (SELECT max(publish_date) FROM posts) - INTERVAL 12 HOUR")
def _(e):
    last = F.broadcast(e.posts.agg((F.max("publish_date") - F.expr("interval 12 hours")).alias("bar")))
    return e.posts.groupBy("author").agg(F.max("publish_date").alias("last_new")).crossJoin(last).filter("last_new < bar").select("author")


@query("due_feeds", "SELECT author FROM (SELECT author, max(publish_date) AS last_try, max(publish_date) FILTER (channel = 'signup') AS last_new FROM posts GROUP BY 1) WHERE floor(epoch(last_try)) + coalesce(least(floor(epoch(last_try)) - floor(epoch(last_new)) + 300, 604800), 604800) <= 1706572800")
def _(e):
    utc = lambda c: F.to_timestamp(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    feeds = e.posts.groupBy("author").agg(utc(F.max("publish_date")).alias("last_try"), utc(F.max(F.when(F.col("channel") == "signup", F.col("publish_date")))).alias("last_new")).withColumn("active", F.lit(True))
    return H.due_feeds(feeds, F.timestamp_seconds(F.lit(1706572800))).select("author")


@query("daily_increments", "SELECT channel, CAST(publish_date AS DATE) AS day, count(*) AS n FROM posts GROUP BY 1, 2")
def _(e):
    """Daily counts in two increments from a stored mark on; the second sees all posts again and adds the new ones only."""
    rows = e.posts.select("post_id", "channel", F.to_date("publish_date").alias("day"), F.lit(1).cast("long").alias("n"))
    half = rows.agg((F.max("post_id") / 2).cast("long")).first()[0]
    totals, mark = streams.add_new(None, rows.filter(F.col("post_id") <= half), None, "post_id", ["channel", "day"], "n")
    return streams.add_new(totals, rows, mark, "post_id", ["channel", "day"], "n")[0]
