"""Topic snapshots, mining and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators import topics as T
from tidings.plans.registry import entity_query as query

CROSS = "cross_links AS (SELECT DISTINCT l.stories_id, l.ref_stories_id, a.media_id AS from_media, b.media_id AS to_media FROM topic_links l JOIN topic_stories a ON a.stories_id = l.stories_id JOIN topic_stories b ON b.stories_id = l.ref_stories_id WHERE a.media_id <> b.media_id)"
COUNTS = f", {CROSS}, counts AS (SELECT s.stories_id, s.media_id, coalesce(i.m, 0) AS media_inlink_count, coalesce(i.n, 0) AS inlink_count, coalesce(o.n, 0) AS outlink_count, coalesce(p.n, 0) AS post_count, coalesce(p.a, 0) AS author_count, coalesce(p.c, 0) AS channel_count FROM topic_stories s LEFT JOIN (SELECT ref_stories_id AS k, count(*) AS n, count(DISTINCT from_media) AS m FROM cross_links GROUP BY 1) i ON i.k = s.stories_id LEFT JOIN (SELECT stories_id AS k, count(*) AS n FROM cross_links GROUP BY 1) o ON o.k = s.stories_id LEFT JOIN (SELECT stories_id AS k, count(*) AS n, count(DISTINCT author) AS a, count(DISTINCT channel) AS c FROM posts GROUP BY 1) p ON p.k = s.stories_id) "


@query("story_link_counts", COUNTS + "SELECT * FROM counts")
def _(e):
    return T.story_link_counts(e.topic_stories, T.cross_media_links(e.topic_links, e.topic_stories, e.link_parts), e.posts, e.link_parts)


@query("medium_link_counts", COUNTS + "SELECT c.media_id, count(*) AS story_count, CAST(sum(inlink_count) AS BIGINT) AS inlink_count, CAST(sum(outlink_count) AS BIGINT) AS outlink_count, CAST(sum(post_count) AS BIGINT) AS post_count, CAST(sum(media_inlink_count) AS BIGINT) AS sum_media_inlink_count, coalesce(max(l.n), 0) AS media_inlink_count FROM counts c LEFT JOIN (SELECT to_media, count(DISTINCT from_media) AS n FROM cross_links GROUP BY 1) l ON l.to_media = c.media_id GROUP BY 1")
def _(e):
    return T.snapshot(e.topic_stories, e.topic_links, e.posts)["medium_link_counts"]


@query("medium_links", f", {CROSS} SELECT from_media AS source_media_id, to_media AS ref_media_id, count(*) AS link_count FROM cross_links GROUP BY 1, 2")
def _(e):
    return T.medium_links(T.cross_media_links(e.topic_links, e.topic_stories, e.link_parts), e.topic_stories, e.link_parts)


for _period, _unit, _step in (("weekly", "week", "7 DAY"), ("monthly", "month", "1 MONTH")):
    query(f"timespans_{_period}", f"SELECT '{_period}' AS period, CAST(w AS DATE) AS start_date, CAST(w + INTERVAL {_step} AS DATE) AS end_date FROM (SELECT unnest(generate_series(date_trunc('{_unit}', min(publish_date)), CAST(max(publish_date) AS TIMESTAMP), INTERVAL {_step})) AS w FROM topic_stories)")(
        lambda e, p=_period: T.timespans(e.topic_stories, p)
    )
    query(f"timespan_stories_{_period}", f"SELECT CAST(date_trunc('{_unit}', publish_date) AS DATE) AS start_date, stories_id FROM topic_stories WHERE publish_date IS NOT NULL UNION SELECT CAST(date_trunc('{_unit}', publish_date) AS DATE), ref_stories_id FROM topic_links JOIN topic_stories USING (stories_id) WHERE publish_date IS NOT NULL")(
        lambda e, p=_period: T.stories_by_timespan(e.topic_stories, e.topic_links, p)
    )


@query("period_stories", "SELECT stories_id FROM topic_stories WHERE publish_date BETWEEN TIMESTAMP '1992-02-01' AND TIMESTAMP '1992-03-01' - INTERVAL 1 SECOND UNION SELECT ref_stories_id FROM topic_links JOIN topic_stories s USING (stories_id) WHERE s.publish_date BETWEEN TIMESTAMP '1992-02-01' AND TIMESTAMP '1992-03-01' - INTERVAL 1 SECOND")
def _(e):
    return T.period_stories(e.topic_stories, e.topic_links, F.lit("1992-02-01").cast("timestamp_ntz"), F.lit("1992-03-01").cast("timestamp_ntz"))


@query("period_posts", "SELECT DISTINCT stories_id FROM posts WHERE publish_date >= TIMESTAMP '2024-01-05' AND publish_date < TIMESTAMP '2024-01-06'")
def _(e):
    day = [F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-06")]
    return e.posts.filter((F.col("publish_date") >= day[0]) & (F.col("publish_date") < day[1])).select("stories_id").distinct()


@query("engaged_stories", "SELECT stories_id FROM topic_links UNION SELECT ref_stories_id FROM topic_links UNION (SELECT stories_id FROM posts GROUP BY 1 HAVING count(*) >= 10)")
def _(e):
    return T.engaged_stories(e.topic_links, e.posts)


@query("co_sharing_links", "SELECT a_id, b_id, seconds FROM (SELECT a.stories_id AS a_id, b.stories_id AS b_id, min(abs(epoch(a.publish_date) - epoch(b.publish_date))) AS seconds FROM posts a JOIN posts b ON a.author = b.author AND a.stories_id > b.stories_id GROUP BY 1, 2) ORDER BY seconds, a_id, b_id LIMIT 40")
def _(e):
    return T.close_shares(e.posts, 3600).orderBy("seconds", "a_id", "b_id").limit(40)


@query("boolean_focus", "SELECT stories_id FROM topic_stories WHERE regexp_matches(title, '(?i)customer#0+1')")
def _(e):
    from tidings.functions.boolean import predicate

    return e.topic_stories.filter(predicate("customer", "title") & F.col("title").rlike("(?i)customer#0+1")).select("stories_id")


@query("story_links_without_wire", f", {CROSS} SELECT stories_id, ref_stories_id FROM cross_links WHERE from_media <> 3")
def _(e):
    wire = e.topic_stories.filter("media_id = 3").select("stories_id")
    return T.cross_media_links(e.topic_links, e.topic_stories).join(wire, "stories_id", "left_anti")


@query("story_tags_fallback", "SELECT stories_id, tags_id FROM story_tags WHERE stories_id % 2 = 0 UNION ALL SELECT stories_id, tags_id FROM story_tags WHERE stories_id % 2 = 1 AND tags_id > 2")
def _(e):
    return T.story_tags_with_fallback(e.story_tags.filter("stories_id % 2 = 0"), e.story_tags.filter("tags_id > 2"))


@query("confidence_models")
def _(e):
    return T.confidence_models(e.topic_stories, e.topic_links)


@query("topic_permissions", "SELECT u AS \"user\", t AS topic, CASE WHEN u % 5 = 0 THEN 'admin' WHEN (u + t) % 4 = 0 THEN 'write' WHEN t % 2 = 0 THEN 'read' ELSE 'none' END AS permission FROM (SELECT DISTINCT media_id AS u FROM media), (VALUES (1), (2), (3)) v(t)")
def _(e):
    users = e.media.select(F.col("media_id").alias("user"), (F.col("media_id") % 5 == 0).alias("is_admin"))
    topics = e.spark.createDataFrame([(1, False), (2, True), (3, False)], "topic int, is_public boolean")
    grants = users.crossJoin(F.broadcast(topics)).filter("(user + topic) % 4 = 0").select("user", "topic", F.lit("write").alias("permission"))
    return T.permissions(users, topics, grants)


@query("topic_story_page", COUNTS + "SELECT stories_id, inlink_count FROM counts WHERE media_id IN (1, 2, 3) ORDER BY inlink_count DESC NULLS LAST, md5(CAST(stories_id AS VARCHAR)) DESC LIMIT 20")
def _(e):
    counts = T.snapshot(e.topic_stories, e.topic_links, e.posts)["story_link_counts"].filter("media_id in (1, 2, 3)")
    return counts.orderBy(F.desc_nulls_last("inlink_count"), F.desc(F.md5(F.col("stories_id").cast("string")))).limit(20).select("stories_id", "inlink_count")


@query("links_from_medium", "SELECT DISTINCT l.ref_stories_id AS stories_id FROM topic_links l JOIN topic_stories s USING (stories_id) WHERE s.media_id = 4")
def _(e):
    return e.topic_links.join(e.topic_stories.filter("media_id = 4"), "stories_id", "left_semi").select(F.col("ref_stories_id").alias("stories_id")).distinct()


@query("dedup_title_day", "SELECT s.stories_id, g.first_id FROM stories s JOIN (SELECT media_id, title, CAST(publish_date AS DATE) AS day, min(stories_id) AS first_id FROM stories GROUP BY 1, 2, 3 HAVING count(*) > 1) g ON g.media_id = s.media_id AND g.title = s.title AND g.day = CAST(s.publish_date AS DATE)")
def _(e):
    return T.duplicate_groups(e.stories.withColumn("day", F.to_date("publish_date")), ["media_id", "title", "day"])


@query("dedup_text", "SELECT s.stories_id, g.first_id FROM stories s JOIN (SELECT text, min(stories_id) AS first_id FROM stories GROUP BY 1 HAVING count(*) > 1) g USING (text)")
def _(e):
    return T.duplicate_groups(e.stories.withColumn("h", F.sha2("text", 256)), ["h"])


@query("merge_duplicate_links", "SELECT DISTINCT a AS stories_id, b AS ref_stories_id FROM (SELECT CASE WHEN stories_id % 10 = 3 THEN stories_id - 1 ELSE stories_id END AS a, CASE WHEN ref_stories_id % 10 = 3 THEN ref_stories_id - 1 ELSE ref_stories_id END AS b FROM topic_links) WHERE a <> b")
def _(e):
    return T.merge_duplicates(e.topic_links, e.topic_stories.filter("stories_id % 10 = 3").select("stories_id", (F.col("stories_id") - 1).alias("target")))


@query("preferred_story", "SELECT title, arg_min(stories_id, (NOT foreign_rss_links, dup_media_id IS NOT NULL, -n, stories_id)) AS stories_id FROM stories JOIN media USING (media_id) JOIN (SELECT stories_id, count(*) AS n FROM sentences GROUP BY 1) USING (stories_id) GROUP BY 1")
def _(e):
    rows = e.stories.select("stories_id", "media_id", "title").join(e.media.select("media_id", "dup_media_id", F.col("foreign_rss_links").alias("is_dup_target")), "media_id")
    return T.preferred_story(rows.join(e.sentences.groupBy("stories_id").agg(F.count("*").alias("n_sentences")), "stories_id"), "title")


@query("new_story_dedup", "SELECT stories_id FROM stories s WHERE stories_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM stories k WHERE k.stories_id % 3 <> 0 AND k.media_id = s.media_id AND (k.url = s.url OR (k.title = s.title AND CAST(k.publish_date AS DATE) = CAST(s.publish_date AS DATE))))")
def _(e):
    rows = e.stories.select("stories_id", "media_id", "url", F.md5("title").alias("title_hash"), F.to_date("publish_date").alias("day"))
    return T.new_stories(rows.filter("stories_id % 3 <> 0"), rows.filter("stories_id % 3 = 0")).select("stories_id")


@query("spider_iterations", ", seeds AS (SELECT stories_id FROM topic_stories WHERE stories_id % 200 = 0), one AS (SELECT DISTINCT ref_stories_id AS stories_id FROM topic_links WHERE stories_id IN (SELECT * FROM seeds)), two AS (SELECT DISTINCT ref_stories_id AS stories_id FROM topic_links WHERE stories_id IN (SELECT * FROM one)) SELECT stories_id, min(k) AS iteration FROM (SELECT stories_id, 0 AS k FROM seeds UNION ALL SELECT stories_id, 1 FROM one UNION ALL SELECT stories_id, 2 FROM two) GROUP BY 1")
def _(e):
    return T.spider(e.topic_links, e.topic_stories.filter("stories_id % 200 = 0"), 2)


@query("seed_import", "SELECT DISTINCT p.stories_id FROM posts p WHERE p.channel = 'purchase' AND p.stories_id NOT IN (SELECT media_id FROM media)")
def _(e):
    return e.posts.filter("channel = 'purchase'").select("stories_id").distinct().join(e.media.select(F.col("media_id").alias("stories_id")), "stories_id", "left_anti")


@query("date_window_margin", "SELECT stories_id FROM stories WHERE publish_date IS NULL OR publish_date BETWEEN TIMESTAMP '2024-02-01' - INTERVAL 7 DAY AND TIMESTAMP '2024-02-15' + INTERVAL 7 DAY")
def _(e):
    return e.stories.filter("publish_date is null or publish_date between timestamp_ntz'2024-01-25' and timestamp_ntz'2024-02-22'").select("stories_id")


@query("latest_share_counts", "SELECT stories_id, arg_max(author, (publish_date, post_id)) AS author FROM posts GROUP BY 1")
def _(e):
    return e.posts.groupBy("stories_id").agg(F.max_by("author", F.struct("publish_date", "post_id")).alias("author"))
