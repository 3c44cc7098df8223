"""Lists over topics and their snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.functions.boolean import predicate
from tidings.operators import mining as M
from tidings.operators import search as S
from tidings.operators import snapshots as N
from tidings.operators import topic_lists as L
from tidings.operators import topics as T
from tidings.operators import words as W
from tidings.plans.registry import entity_query as query
from tidings.plans.text import GOOD
from tidings.plans.topics import COUNTS, CROSS


def _timespan_sql(unit: str) -> str:
    return f", {CROSS}, inside AS (SELECT CAST(date_trunc('{unit}', publish_date) AS DATE) AS start_date, stories_id FROM topic_stories WHERE publish_date IS NOT NULL UNION SELECT CAST(date_trunc('{unit}', publish_date) AS DATE), ref_stories_id FROM cross_links JOIN topic_stories USING (stories_id) WHERE publish_date IS NOT NULL), both_ends AS (SELECT a.start_date, c.* FROM cross_links c JOIN inside a ON a.stories_id = c.stories_id JOIN inside b ON b.stories_id = c.ref_stories_id AND b.start_date = a.start_date), span_counts AS (SELECT i.start_date, i.stories_id, coalesce(x.n, 0) AS inlink_count, coalesce(x.m, 0) AS media_inlink_count, coalesce(o.n, 0) AS outlink_count FROM inside i LEFT JOIN (SELECT start_date, ref_stories_id, count(*) AS n, count(DISTINCT from_media) AS m FROM both_ends GROUP BY 1, 2) x ON x.start_date = i.start_date AND x.ref_stories_id = i.stories_id LEFT JOIN (SELECT start_date, stories_id, count(*) AS n FROM both_ends GROUP BY 1, 2) o ON o.start_date = i.start_date AND o.stories_id = i.stories_id) "


def _span_counts(e, period):
    return L.timespan_link_counts(e.topic_stories, T.cross_media_links(e.topic_links, e.topic_stories), period, e.link_parts)


for _period, _unit in (("weekly", "week"), ("monthly", "month")):
    query(f"timespan_link_counts_{_period}", _timespan_sql(_unit) + "SELECT * FROM span_counts")(lambda e, p=_period: _span_counts(e, p))


@query("timespan_row_statistics", _timespan_sql("month") + "SELECT start_date, count(*) AS stories, count(DISTINCT media_id) AS media, CAST(sum(outlink_count) AS BIGINT) AS links, count(*) FILTER (inlink_count > 0) AS linked_stories FROM span_counts JOIN topic_stories USING (stories_id) GROUP BY 1")
def _(e):
    return L.row_statistics(_span_counts(e, "monthly"), e.topic_stories)


@query("snapshot_view", _timespan_sql("month") + "SELECT stories_id, inlink_count FROM span_counts WHERE start_date = DATE '1995-03-01'")
def _(e):
    names = L.create_views({"story_link_counts": _span_counts(e, "monthly")}, "snapshot", F.col("start_date") == F.lit("1995-03-01").cast("date"))
    return e.spark.table(names[0]).select("stories_id", "inlink_count")


def _seeds(e):
    seeds = e.spark.createDataFrame([(1, 1, "twitter"), (1, 2, "web"), (2, 3, "reddit"), (2, 4, "generic_post")], "topics_id long, topic_seed_queries_id long, platform string")
    known = [(1, "Boolean Query", "sport", '{"query": "ball or goal"}'), (1, "Boolean Query", "art", '{"query": "opera"}'), (2, "URL Sharing", "old", '{"mode": "url_sharing", "topic_seed_queries_id": 3}'), (2, "URL Sharing", "gone", '{"mode": "url_sharing", "topic_seed_queries_id": 9}')]
    return seeds, e.spark.createDataFrame(known, "topics_id long, focal_technique string, name string, arguments string")


@query("sharing_foci", "SELECT * FROM (VALUES (1, 'Boolean Query', 'sport', '{\"query\": \"ball or goal\"}'), (1, 'Boolean Query', 'art', '{\"query\": \"opera\"}'), (2, 'URL Sharing', 'old', '{\"mode\": \"url_sharing\", \"topic_seed_queries_id\": 3}'), (1, 'URL Sharing', 'twitter [1]', '{\"mode\":\"url_sharing\",\"topic_seed_queries_id\":1}'), (2, 'URL Sharing', 'generic_post [4]', '{\"mode\":\"url_sharing\",\"topic_seed_queries_id\":4}')) v(topics_id, focal_technique, name, arguments)")
def _(e):
    return L.sharing_foci(*_seeds(e))


@query("focal_set_list", "SELECT media_id % 3 AS topics_id, 'Boolean Query' AS focal_technique, len(array_agg(name)) AS n, string_agg(name || ':' || name || ' or x', ',' ORDER BY name) AS foci FROM media GROUP BY 1")
def _(e):
    foci = e.media.select((F.col("media_id") % 3).alias("topics_id"), F.lit("Boolean Query").alias("focal_technique"), "name", F.format_string('{"query": "%s or x"}', "name").alias("arguments"))
    sets = L.focal_sets(foci)
    return sets.select("topics_id", "focal_technique", F.size("foci").cast("long").alias("n"), F.array_join(F.transform("foci", lambda f: F.concat_ws(":", f["name"], f["query"])), ",").alias("foci"))


@query("topic_snapshot_list", "SELECT m.media_id AS \"user\", t AS topics_id, s AS snapshots_id, (SELECT string_agg(p || ':' || id, ',' ORDER BY p, id) FROM (VALUES ('monthly', 1), ('overall', 2), ('weekly', 3)) v(p, i), (SELECT s * 10 + i AS id) WHERE s <> 3) AS timespans FROM media m, (VALUES (1, 1), (1, 2), (2, 3)) x(t, s) WHERE (m.media_id + t) % 2 = 0")
def _(e):
    topics = e.spark.createDataFrame([(1,), (2,), (3,)], "topics_id long")
    snapshots = e.spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "topics_id long, snapshots_id long")
    spans = snapshots.filter("snapshots_id <> 3").select("snapshots_id", F.posexplode(F.array(F.lit("monthly"), F.lit("overall"), F.lit("weekly"))).alias("k", "period"))
    spans = spans.select("snapshots_id", "period", F.lit("2024-01-01").cast("date").alias("start_date"), (F.col("snapshots_id") * 10 + F.col("k") + 1).alias("timespans_id"))
    may = e.media.select(F.col("media_id").alias("user"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(3).cast("long"))).alias("topic"))
    may = may.withColumn("permission", F.when((F.col("user") + F.col("topic")) % 2 == 0, "read").otherwise("none"))
    rows = L.snapshot_list(topics, snapshots, spans, may)
    return rows.withColumn("timespans", F.array_join(F.transform("timespans", lambda t: F.concat_ws(":", t["period"], t["timespans_id"].cast("string"))), ","))


@query("sibling_foci", "SELECT DISTINCT stories_id, f AS foci_id FROM topic_stories, (VALUES (7), (8)) v(f) WHERE stories_id % 3 = 0 AND ((f = 7 AND stories_id % 2 = 0) OR (f = 8 AND stories_id % 5 = 0))")
def _(e):
    spans = [(1, 1, "weekly", "2024-01-01", "2024-01-08", None), (2, 1, "weekly", "2024-01-01", "2024-01-08", 7), (3, 1, "weekly", "2024-01-01", "2024-01-08", 8), (4, 1, "weekly", "2024-01-08", "2024-01-15", 9), (5, 2, "weekly", "2024-01-01", "2024-01-08", 10)]
    spans = e.spark.createDataFrame(spans, "timespans_id long, snapshots_id long, period string, start_date string, end_date string, foci_id long")
    ids = lambda k, n: e.topic_stories.filter(F.col("stories_id") % n == 0).select("stories_id", F.lit(k).cast("long").alias("timespans_id"))
    return L.sibling_foci(ids(1, 3).union(ids(2, 2)).union(ids(3, 5)).union(ids(4, 1)).union(ids(5, 1)), spans, 1)


@query("topic_media_page", COUNTS + ", per AS (SELECT media_id, CAST(sum(inlink_count) AS BIGINT) AS inlink_count FROM counts GROUP BY 1) SELECT p.media_id, name, inlink_count, (SELECT string_agg(DISTINCT CAST(tags_id AS VARCHAR), ',' ORDER BY CAST(tags_id AS VARCHAR)) FROM media_tags t WHERE t.media_id = p.media_id) AS tags FROM per p JOIN media m ON m.media_id = p.media_id WHERE name LIKE '%src1%' ORDER BY inlink_count DESC, md5(CAST(p.media_id AS VARCHAR)) DESC LIMIT 5 OFFSET 2")
def _(e):
    counts = T.snapshot(e.topic_stories, e.topic_links, e.posts)["medium_link_counts"].select("media_id", "inlink_count")
    return L.topic_media(counts, e.media, e.media_tags, "SRC1", rows=5, skip=2).withColumn("tags", F.array_join(F.col("tags").cast("array<string>"), ","))


@query("topic_story_count", "SELECT count(*) AS stories FROM stories WHERE regexp_matches(text, '(?i)(?:^|[^\\p{L}\\p{N}_])the') AND publish_date >= TIMESTAMP '2024-01-08' AND publish_date < TIMESTAMP '2024-02-01'")
def _(e):
    span = e.stories.filter("publish_date >= timestamp_ntz'2024-01-08' and publish_date < timestamp_ntz'2024-02-01'").select("stories_id")
    return S.search(e.stories, "the").join(span, "stories_id", "left_semi").agg(F.count("*").alias("stories"))


@query("topic_words", GOOD.replace("FROM sentences", "FROM sentences WHERE stories_id IN (SELECT stories_id FROM stories WHERE publish_date >= TIMESTAMP '2024-01-08' AND publish_date < TIMESTAMP '2024-02-01')") + " ORDER BY 3 DESC, 1 DESC LIMIT 100")
def _(e):
    span = e.stories.filter("publish_date >= timestamp_ntz'2024-01-08' and publish_date < timestamp_ntz'2024-02-01'").select("stories_id")
    return W.word_list(e.sentences.join(span, "stories_id", "left_semi"), 100, chars=W.SENTENCE_CHARS)


@query("list_page", "SELECT media_id, name FROM media ORDER BY name LIMIT 5 OFFSET 5")
def _(e):
    return L.paged(e.media.select("media_id", "name"), [F.col("name")], 1, 5)[0]


@query("public_fields", "SELECT stories_id, title, language FROM stories")
def _(e):
    return L.public_fields(e.stories, ["language", "title", "stories_id", "text", "full_text_rss"], L.PUBLIC_STORY_FIELDS)


@query("extra_media_fields", "SELECT media_id, CASE WHEN media_id % 7 = 0 THEN 'null' WHEN media_id % 2 = 0 THEN 'left' ELSE 'right' END AS partisanship, CASE WHEN media_id % 3 = 1 THEN 1 ELSE 0 END AS fake_news FROM media")
def _(e):
    return L.extra_media_fields(e.media, e.media_tags, e.tags, 20, 101)


@query("health_nested_gaps", "SELECT medium, n, gaps FROM (SELECT medium, count(*) AS n FROM daily GROUP BY 1) LEFT JOIN (SELECT medium, string_agg(CAST(stat_date AS VARCHAR), ',' ORDER BY stat_date) AS gaps FROM daily WHERE num_stories < 60 GROUP BY 1) USING (medium)")
def _(e):
    rows = L.nested_gaps(e.daily.groupBy("medium").agg(F.count("*").alias("n")), e.daily.filter("num_stories < 60"), "medium", "stat_date")
    return rows.select("medium", "n", F.array_join(F.col("coverage_gap_list").cast("array<string>"), ",").alias("gaps"))


@query("alert_recipients", "SELECT DISTINCT stories_id AS topic, author AS \"user\" FROM posts WHERE channel <> 'view'")
def _(e):
    rows = e.posts.select(F.col("stories_id").alias("topic"), F.col("author").alias("user"), F.when(F.col("channel") == "view", "none").otherwise("read").alias("permission"))
    return L.alert_recipients(rows)


@query("topic_dump_links", f", {CROSS} SELECT c.stories_id, c.ref_stories_id, a.title AS source_title, a.media_id AS source_media_id, m.name AS source_media_name, b.title AS ref_title, b.media_id AS ref_media_id, n.name AS ref_media_name FROM cross_links c JOIN topic_stories a ON a.stories_id = c.stories_id JOIN topic_stories b ON b.stories_id = c.ref_stories_id LEFT JOIN media m ON m.media_id = a.media_id LEFT JOIN media n ON n.media_id = b.media_id")
def _(e):
    return L.topic_dump(T.cross_media_links(e.topic_links, e.topic_stories), e.topic_stories, e.media)


@query("topic_dump_posts", "SELECT stories_id, count(*) FILTER (channel = 'view') AS view_post_count, count(*) FILTER (channel = 'click') AS click_post_count FROM posts GROUP BY 1")
def _(e):
    return L.posts_by_channel(e.posts, ["view", "click"])


@query("query_export", "SELECT s.stories_id, media_id, title, url, publish_date, n AS post_count FROM stories s LEFT JOIN (SELECT stories_id, count(*) AS n FROM posts GROUP BY 1) p USING (stories_id) WHERE regexp_matches(text, '(?i)(?:^|[^\\p{L}\\p{N}_])und')")
def _(e):
    counts = e.posts.filter("stories_id is not null").groupBy("stories_id").agg(F.count("*").alias("post_count"))
    return L.query_export(S.search(e.stories, "und"), counts)


# Timespans of all foci, merges and fetches

SPANS = """, foci AS (SELECT DISTINCT media_id % 3 + 1 AS focus, stories_id FROM topic_stories WHERE stories_id % 2 = 0), custom(s, e) AS (VALUES (DATE '1995-01-15', DATE '1995-03-01'), (DATE '1995-02-20', DATE '1995-02-27')),
each AS (SELECT 0 AS focus, stories_id, publish_date FROM topic_stories UNION ALL SELECT focus, stories_id, publish_date FROM foci JOIN topic_stories USING (stories_id)),
dated AS (SELECT focus, 'overall' AS period, CAST(NULL AS DATE) AS start_date, stories_id FROM each UNION SELECT focus, 'weekly', CAST(date_trunc('week', publish_date) AS DATE), stories_id FROM each WHERE publish_date IS NOT NULL
  UNION SELECT focus, 'monthly', CAST(date_trunc('month', publish_date) AS DATE), stories_id FROM each WHERE publish_date IS NOT NULL UNION SELECT focus, 'custom', s, stories_id FROM each JOIN custom ON publish_date >= s AND publish_date < e),
members AS (SELECT * FROM dated UNION SELECT d.focus, d.period, d.start_date, l.ref_stories_id FROM dated d JOIN topic_links l USING (stories_id) JOIN each e ON e.focus = d.focus AND e.stories_id = l.ref_stories_id)"""


def _foci(e):
    custom = e.spark.createDataFrame([("1995-01-15", "1995-03-01"), ("1995-02-20", "1995-02-27")], "start_date string, end_date string")
    foci = e.topic_stories.filter("stories_id % 2 = 0").select((F.col("media_id") % 3 + 1).alias("focus"), "stories_id")
    return foci, custom.select(F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"))


@query("focus_timespan_stories", SPANS + " SELECT focus, period, start_date, count(*) AS stories FROM members GROUP BY 1, 2, 3")
def _(e):
    return N.timespan_story_counts(e.topic_stories, e.topic_links, *_foci(e), e.link_parts)


@query("focus_timespan_media", SPANS + """, inside AS (SELECT a.focus, a.period, a.start_date, x.media_id AS from_media, y.media_id AS to_media FROM (SELECT DISTINCT stories_id, ref_stories_id FROM topic_links) l JOIN members a USING (stories_id) JOIN members b ON b.stories_id = l.ref_stories_id AND a.focus = b.focus AND a.period = b.period AND a.start_date IS NOT DISTINCT FROM b.start_date
  JOIN topic_stories x ON x.stories_id = l.stories_id JOIN topic_stories y ON y.stories_id = l.ref_stories_id WHERE x.media_id <> y.media_id)
SELECT c.focus, c.period, c.start_date, c.media_id, story_count, coalesce(i.n, 0) AS inlink_count, coalesce(o.n, 0) AS outlink_count, coalesce(i.m, 0) AS media_inlink_count
FROM (SELECT focus, period, start_date, media_id, count(*) AS story_count FROM members JOIN topic_stories USING (stories_id) GROUP BY 1, 2, 3, 4) c
LEFT JOIN (SELECT focus, period, start_date, to_media, count(*) AS n, count(DISTINCT from_media) AS m FROM inside GROUP BY 1, 2, 3, 4) i ON i.focus = c.focus AND i.period = c.period AND i.start_date IS NOT DISTINCT FROM c.start_date AND i.to_media = c.media_id
LEFT JOIN (SELECT focus, period, start_date, from_media, count(*) AS n FROM inside GROUP BY 1, 2, 3, 4) o ON o.focus = c.focus AND o.period = c.period AND o.start_date IS NOT DISTINCT FROM c.start_date AND o.from_media = c.media_id""")
def _(e):
    return N.timespan_media(e.topic_stories, e.topic_links, *_foci(e), e.link_parts)


MERGED = ", t AS (SELECT stories_id, CASE WHEN stories_id % 10 = 3 THEN stories_id - 2 WHEN stories_id % 10 = 4 THEN stories_id - 3 ELSE stories_id END AS target, stories_id % 5 AS iteration FROM topic_stories)"


def _merged(e):
    """Stories that end in 4 are merged into those in 3, and these into those in 1."""
    merges = e.topic_stories.filter("stories_id % 10 in (3, 4)").select("stories_id", F.when(F.col("stories_id") % 10 == 4, F.col("stories_id") - 1).otherwise(F.col("stories_id") - 2).alias("target"))
    rows = e.topic_stories.select("stories_id", (F.col("stories_id") % 5).alias("iteration"), (F.col("stories_id") % 2 == 0).alias("link_mined"))
    seeds = e.posts.select("post_id", (F.col("stories_id") + 1).alias("stories_id"))
    return M.merge_stories(rows, e.topic_links, seeds, merges)


@query("merged_topic_stories", MERGED + " SELECT target AS stories_id, min(iteration) AS iteration, count(*) > 1 OR bool_or(stories_id % 2 = 0) AS link_mined FROM t GROUP BY 1")
def _(e):
    return _merged(e)["topic_stories"]


@query("merged_topic_links", MERGED + " SELECT DISTINCT a.target AS stories_id, b.target AS ref_stories_id FROM topic_links l JOIN t a ON a.stories_id = l.stories_id JOIN t b ON b.stories_id = l.ref_stories_id WHERE a.target <> b.target")
def _(e):
    return _merged(e)["links"].select("stories_id", "ref_stories_id")


@query("merged_topic_seeds", MERGED + " SELECT post_id, coalesce(target, p.stories_id + 1) AS stories_id FROM posts p LEFT JOIN t ON t.stories_id = p.stories_id + 1")
def _(e):
    return _merged(e)["seeds"]


@query("fetch_transitions", """, f AS (SELECT url, page_id % 11 AS k, page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'ignored' WHEN 1 THEN 'request failed' WHEN 2 THEN 'story match' WHEN 3 THEN 'tweet pending' WHEN 4 THEN 'pending' WHEN 5 THEN 'ignored' WHEN 6 THEN 'request failed' WHEN 7 THEN 'story match' WHEN 8 THEN 'content match failed' WHEN 9 THEN 'story added' ELSE 'story added' END AS state,
  CASE k WHEN 0 THEN 403 WHEN 1 THEN 500 WHEN 2 THEN 200 WHEN 5 THEN 403 WHEN 6 THEN 404 WHEN 7 THEN 200 WHEN 8 THEN 200 WHEN 9 THEN 200 WHEN 10 THEN 200 END AS code FROM f""")
def _(e):
    """The pages as URLs to fetch; the page's number says what is known of it."""
    k = F.col("page_id") % 11
    url = F.when(k == 0, "http://ignored.example.org/").when(k == 3, "https://twitter.com/someone/status/").otherwise("http://site.example.com/")
    rows = e.table("pages").select("page_id", k.alias("k"), F.concat(url, F.col("page_id").cast("string")).alias("url"), F.lit("pending").alias("state"), (k == 10).alias("assume_match"))
    failed = rows.filter("k = 1").select("url", F.lit("request failed").alias("state"), F.lit(500).alias("code"), F.lit("down").alias("message"))
    matches = rows.filter("k in (0, 2)").select("url", F.col("page_id").alias("stories_id"))
    answers = rows.filter("k > 4").select(
        "url", F.when(F.col("k") == 6, 404).otherwise(200).alias("code"), (F.col("k") != 6).alias("success"), F.when(F.col("k") == 5, "http://ignored.example.org/x").otherwise(F.col("url")).alias("response_url"),
        F.when(F.col("k") == 9, "about rye").otherwise("about oats").alias("content"), F.lit(None).cast("string").alias("message"), F.when(F.col("k") == 7, F.col("page_id")).alias("known_id"),
    )
    none = e.spark.createDataFrame([("selfish.net",)], "domain string")
    found = M.advance_fetches(rows.select("url", "state", "assume_match"), failed, none, matches, answers, lambda u: F.contains(u, F.lit("ignored.example")), predicate("rye", "content"))
    return rows.select("page_id", "url").join(found, "url").select("page_id", "state", "code")


@query("back_fill_stories", "SELECT stories_id FROM stories WHERE stories_id % 4 = 0 AND publish_date >= TIMESTAMP '2024-02-01' QUALIFY row_number() OVER (PARTITION BY media_id, title, CAST(publish_date AS DATE) ORDER BY url) = 1 AND (media_id, title, CAST(publish_date AS DATE)) NOT IN (SELECT (media_id, title, CAST(publish_date AS DATE)) FROM stories WHERE stories_id % 4 <> 0 AND publish_date IS NOT NULL)")
def _(e):
    """Every fourth story comes from an archive; those that the others hold by title and day are left out."""
    rows = e.stories.withColumn("guid", F.col("url"))
    return M.back_fill(rows.filter("stories_id % 4 = 0"), rows.filter("stories_id % 4 <> 0"), "2024-02-01").select("stories_id")
