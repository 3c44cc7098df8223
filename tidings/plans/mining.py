"""Mining of stories and media for topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators import graph as G
from tidings.operators import mining as M
from tidings.plans.registry import entity_query as query

ROOTS = ", roots AS (SELECT m.media_id, coalesce(g.media_id, p.media_id, m.media_id) AS root FROM media m LEFT JOIN media p ON p.media_id = m.dup_media_id LEFT JOIN media g ON g.media_id = p.dup_media_id WHERE coalesce(g.dup_media_id, p.dup_media_id, m.dup_media_id) IS NULL OR coalesce(g.media_id, p.media_id) IS NOT NULL)"
WIRE = ", dups AS (SELECT stories_id, count(*) AS n FROM sentences WHERE length(sentence) >= 32 AND md5(sentence) IN (SELECT md5(sentence) FROM sentences WHERE media_id = 3) GROUP BY 1)"


def _guid(e):
    return e.stories.withColumn("guid", F.col("url"))


@query("story_match_by_url", "SELECT 'HTTPS://M.SRC' || media_id || '.example.com/news/' || stories_id || '#top' AS url, stories_id FROM stories JOIN media USING (media_id) WHERE NOT foreign_rss_links")
def _(e):
    asked = e.stories.select(F.concat(F.lit("HTTPS://M.SRC"), F.col("media_id").cast("string"), F.lit(".example.com/news/"), F.col("stories_id").cast("string"), F.lit("#top")).alias("url"), F.lit(None).cast("string").alias("redirect_url"))
    return M.match_stories(asked, _guid(e), e.media)


@query("duplicate_media_stories", ROOTS + ", moved AS (SELECT s.*, r.root FROM stories s JOIN roots r USING (media_id) WHERE r.root <> s.media_id) SELECT m.stories_id, m.root AS root_media_id, min(t.stories_id) AS target_id FROM moved m LEFT JOIN stories t ON t.media_id = m.root AND (t.url = m.url OR (t.title = m.title AND CAST(t.publish_date AS DATE) = CAST(m.publish_date AS DATE))) GROUP BY 1, 2")
def _(e):
    return M.move_to_root_media(_guid(e), G.roots(e.media, "media_id", "dup_media_id"))


@query("copy_stories_to_topic", "SELECT url, stories_id, 'topic 2' AS source FROM stories WHERE stories_id % 7 <> 0 AND url NOT IN (SELECT url FROM stories WHERE stories_id % 11 = 0)")
def _(e):
    by_id = e.stories.filter("stories_id % 7 = 0").select(F.concat("url", F.lit("/old")).alias("url"), "stories_id")
    by_url = e.stories.filter("stories_id % 11 = 0").select("url", F.lit(None).cast("long").alias("stories_id"))
    return M.copy_to_topic(e.stories, by_id.union(by_url), "topic 2")


@query("foreign_rss_seeds", "SELECT s.url, 'merge_foreign_rss_stories' AS source FROM stories s JOIN media m USING (media_id) WHERE m.foreign_rss_links AND s.stories_id % 6 <> 0")
def _(e):
    return M.split_foreign_rss(e.stories.withColumn("valid_foreign_rss_story", F.col("stories_id") % 6 == 0), e.media)[1]


@query("foreign_rss_kept", "SELECT s.stories_id FROM stories s JOIN media m USING (media_id) WHERE NOT (m.foreign_rss_links AND s.stories_id % 6 <> 0)")
def _(e):
    return M.split_foreign_rss(e.stories.withColumn("valid_foreign_rss_story", F.col("stories_id") % 6 == 0), e.media)[0].select("stories_id")


@query("link_states", "SELECT state, count(*) AS links FROM (SELECT CASE WHEN url LIKE '%src1.%' THEN 'ignored' WHEN stories_id % 10 = 0 THEN 'skipped' WHEN stories_id % 3 = 0 THEN 'story match' ELSE 'pending' END AS state FROM stories) GROUP BY 1")
def _(e):
    url = F.when(F.col("stories_id") % 10 == 0, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url"))
    links = e.stories.select(url.alias("url"))
    matches = e.stories.filter("stories_id % 3 = 0").select("url", "stories_id")
    return M.link_states(links, matches, F.contains("url", F.lit("src1."))).groupBy("state").agg(F.count("*").alias("links"))


@query("medium_by_url", "SELECT media_id AS asked, media_id FROM media")
def _(e):
    asked = e.media.select(F.concat(F.lit("https://news.SRC"), F.col("media_id").cast("string"), F.lit(".example.com")).alias("url"), F.col("media_id").alias("asked"))
    return asked.join(M.medium_by_url(asked, e.media, e.media.filter("media_id % 2 = 0")), "url").select("asked", "media_id")


@query("dedup_media_by_url", "SELECT 1000 + media_id AS media_id, media_id AS dup_of FROM media WHERE dup_media_id IS NULL UNION ALL SELECT media_id, 1000 + media_id FROM media WHERE dup_media_id IS NOT NULL")
def _(e):
    twins = e.media.select((F.col("media_id") + 1000).alias("media_id"), F.replace("url", F.lit("www."), F.lit("m.")).alias("url"), F.lit(None).cast("long").alias("dup_media_id"))
    return M.dedup_media(e.media.select("media_id", "url", "dup_media_id").union(twins))


@query("merge_candidates", "SELECT a.media_id, b.media_id AS candidate_id FROM media a, media b WHERE a.media_id <> b.media_id AND b.url LIKE '%example%'")
def _(e):
    return M.merge_candidates(e.media)


@query("respider_flags", "SELECT stories_id FROM stories WHERE (publish_date >= TIMESTAMP '2024-01-10' AND publish_date < TIMESTAMP '2024-03-01') AND NOT (publish_date >= TIMESTAMP '2024-02-01' AND publish_date < TIMESTAMP '2024-02-10')")
def _(e):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return M.respider_flags(e.stories, (day("2024-02-01"), day("2024-02-10")), (day("2024-01-10"), day("2024-03-01")))


@query("user_chunks", "SELECT author, author // 50 AS block, (row_number() OVER (PARTITION BY author // 50 ORDER BY author) - 1) // 20 AS chunk FROM (SELECT DISTINCT author FROM posts)")
def _(e):
    return M.id_chunks(e.posts, "author", 20, 50)


@query("story_text_choice", "SELECT stories_id, CASE WHEN length(text) > length(title || chr(10) || language) THEN 'extracted' ELSE 'feed' END AS kind, md5(CASE WHEN length(text) > length(title || chr(10) || language) THEN text ELSE title || chr(10) || language END) AS h FROM stories WHERE text IS NOT NULL")
def _(e):
    text = M.story_text(F.col("title"), F.col("language"), F.col("text"))
    return e.stories.filter("text is not null").select("stories_id", F.when(text == F.col("text"), "extracted").otherwise("feed").alias("kind"), F.md5(text).alias("h"))


@query("wire_sentences", WIRE + " SELECT stories_id, n AS dup_sentences FROM dups")
def _(e):
    return M.wire_sentences(e.sentences, e.sentences.filter("media_id = 3"))


@query("syndicated_stories", WIRE + """, t AS (SELECT s.stories_id, language, coalesce(n, 0) AS n, CASE s.stories_id % 6 WHEN 0 THEN 'NEW YORK (AP) ' WHEN 1 THEN 'by "The Associated Press" ' WHEN 2 THEN 'associated press, ap news ' WHEN 3 THEN 'associated press <b' WHEN 4 THEN '<i associated press> ' ELSE '' END AS mark FROM stories s LEFT JOIN dups d ON d.stories_id = s.stories_id)
SELECT stories_id FROM t WHERE language = 'en' AND CASE WHEN mark LIKE '%(AP)%' OR mark LIKE '%"The%' THEN true WHEN mark <> '' AND n BETWEEN 1 AND 10 THEN true WHEN mark <> '' THEN true WHEN n BETWEEN 1 AND 10 THEN false ELSE n > 10 END""")
def _(e):
    marks = ["NEW YORK (AP) ", 'by "The Associated Press" ', "associated press, ap news ", "associated press <b", "<i associated press> "]
    mark = F.lit("")
    for k, m in enumerate(marks):
        mark = F.when(F.col("stories_id") % 6 == k, m).otherwise(mark)
    rows = e.stories.join(M.wire_sentences(e.sentences, e.sentences.filter("media_id = 3")), "stories_id", "left")
    text = F.concat(mark, F.lit("Some Title Here "), F.coalesce("text", F.lit("")))
    return rows.filter(M.is_syndicated(text, F.lit("Some title here"), F.col("language"), F.coalesce("dup_sentences", F.lit(0)))).select("stories_id")


@query("reliable_dates", "SELECT stories_id, stories_id % 5 = 1 OR stories_id % 5 = 3 AS date_is_reliable FROM stories")
def _(e):
    rows = [(1, "guess_by_url", "date_guess_method"), (2, "guess_by_url_x", "date_guess_method"), (3, "undateable", "date_invalid"), (4, "undateable", "date_invalid"), (4, "guess_by_url_x", "date_guess_method")]
    tags = e.spark.createDataFrame(rows, "k int, tag string, tag_set string")
    return M.reliable_dates(e.stories, e.stories.select("stories_id", (F.col("stories_id") % 5).cast("int").alias("k")).join(tags, "k"))


@query("due_for_rescrape", "SELECT media_id FROM media WHERE media_id % 4 <> 0 AND (media_id % 3 = 0 OR media_id % 5 <> 1) AND NOT (media_id % 2 = 1 AND media_id NOT IN (SELECT media_id FROM feeds WHERE active AND feeds_id % 10 = 0))")
def _(e):
    last = F.when(F.col("media_id") % 3 == 0, None).when(F.col("media_id") % 5 == 1, F.lit("2024-01-01")).otherwise("2022-05-01").cast("timestamp")
    rescraping = e.media.select("media_id", (F.col("media_id") % 4 == 0).alias("disable"), last.alias("last_rescrape_time"))
    return M.due_for_rescrape(rescraping, e.media.filter("media_id % 2 = 1"), e.feeds.filter("feeds_id % 10 = 0"), F.lit("2024-06-01").cast("timestamp"))


@query("value_colours", "SELECT DISTINCT CASE WHEN media_id % 4 = 0 THEN NULL ELSE media_id % 4 END AS \"value\", CASE media_id % 4 WHEN 0 THEN '999999' WHEN 1 THEN 'ff0000' ELSE 'aaaaaa' END AS colour FROM media")
def _(e):
    stored = e.spark.createDataFrame([(1, "ff0000")], "value long, colour string")
    values = e.media.select(F.nullif(F.col("media_id") % 4, F.lit(0).cast("long")).alias("kind"))
    return M.colours(values, "kind", stored, ["aaaaaa"])
