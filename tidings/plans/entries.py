"""Lookups, changes of tables, query forms, files and streams, each as a query of its own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidings.functions import boolean, dates, sql, urls
from tidings.operators import export as X
from tidings.operators import health as H
from tidings.operators import mining as M
from tidings.operators import search as S
from tidings.operators import tables as B
from tidings.operators import topics as T
from tidings.operators.storage import table_path
from tidings.plans.registry import entity_query as query
from tidings.sources import post_source, readers, sinks
from tidings.streaming import streams

TOKENS = "position_words AS (SELECT stories_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM stories)"
PAIRS = ", pairs AS (SELECT a.stories_id AS a_id, b.stories_id AS b_id, min(abs(epoch(a.publish_date) - epoch(b.publish_date))) AS seconds FROM posts a JOIN posts b ON a.author = b.author AND a.stories_id > b.stories_id GROUP BY 1, 2), n AS (SELECT count(DISTINCT stories_id) AS n FROM posts), steps AS (SELECT CAST(floor(31536000 / 2 ** k) AS BIGINT) AS s FROM range(0, 12) t(k)), chosen AS (SELECT max(s) AS s FROM steps, n WHERE (SELECT count(*) FROM pairs WHERE seconds <= s) < 2 * n)"


@query("co_sharing_adaptive", PAIRS + " SELECT a_id, b_id, seconds FROM pairs, chosen WHERE seconds <= s ORDER BY seconds, a_id, b_id LIMIT (SELECT n FROM n)")
def _(e):
    posts = e.posts.filter("stories_id is not null")
    return T.co_sharing_links(posts, posts.select("stories_id").distinct().count())


@query("search_near_distance", f", {TOKENS}, places AS (SELECT stories_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM position_words) SELECT DISTINCT a.stories_id FROM places a JOIN places b ON a.stories_id = b.stories_id AND abs(a.i - b.i) <= 6 WHERE a.w = 'from' AND b.w = 'with'")
def _(e):
    return S.search(e.stories, '"from with"~5', exact=True).select("stories_id")


@query("search_whole_words", f", {TOKENS} SELECT stories_id FROM position_words WHERE list_contains(w, 'the') AND len(list_filter(w, lambda x: starts_with(x, 'licen'))) > 0")
def _(e):
    return S.search(e.stories, "the and licen*", exact=True).select("stories_id")


@query("tsquery_forms", "SELECT * FROM (VALUES ('rye AND oats', '( rye & oats )'), ('rye -oats', '( rye & !oats )'), ('“rye bread” corn*', '( ( rye & bread ) | corn:* )'), ('language:de and rye', 'rye')) v(q, form)")
def _(e):
    asked = ["rye AND oats", "rye -oats", "“rye bread” corn*", "language:de and rye"]
    return e.spark.createDataFrame([(q, boolean.tsquery(q)) for q in asked], "q string, form string")


@query("keyed_lookup", "SELECT stories_id, url FROM stories WHERE stories_id = 7")
def _(e):
    return B.lookup(e.stories, "stories_id", 7).select("stories_id", "url")


@query("find_or_create", "SELECT author, min(channel) AS channel FROM posts WHERE channel = 'view' GROUP BY 1 UNION ALL SELECT DISTINCT author, 'new' FROM posts WHERE author NOT IN (SELECT author FROM posts WHERE channel = 'view')")
def _(e):
    known = e.posts.filter("channel = 'view'").select("author", "channel").distinct()
    return B.find_or_create(known, e.posts.select("author", F.lit("new").alias("channel")), ["author"])


@query("update_and_delete", "SELECT media_id, CASE WHEN media_id % 3 = 0 THEN 'closed' ELSE name END AS name FROM media WHERE media_id % 5 <> 0")
def _(e):
    rows = B.update_where(e.media.select("media_id", "name"), F.col("media_id") % 3 == 0, name="closed")
    return B.delete_where(rows, F.col("media_id") % 5 == 0)


@query("latest_overall", "SELECT * FROM (VALUES (1, 12), (2, 21)) v(topics_id, timespans_id)")
def _(e):
    rows = [(1, 11, "overall", "2024-01-01"), (1, 12, "overall", "2024-02-01"), (1, 13, "weekly", "2024-03-01"), (2, 21, "overall", "2023-01-01")]
    return T.latest_overall(e.spark.createDataFrame(rows, "topics_id long, timespans_id long, period string, snapshot_date string"))


@query("video_urls", "SELECT page_id, 'https://www.youtube.com/watch?v=' || page_id AS url FROM pages")
def _(e):
    return e.table("pages").select("page_id", urls.normalize_youtube_url(F.format_string("http://m.youtube.com/embed/%d?rel=0", "page_id")).alias("url"))


@query("urls_in_text", "SELECT page_id, regexp_replace(url, '[.,;:!?]+$', '') AS url FROM pages")
def _(e):
    seen = F.concat(F.lit("see "), F.col("url"), F.lit(", or ("), F.col("url"), F.lit(")."))
    return e.table("pages").select("page_id", F.explode(urls.http_urls_in_string(seen)).alias("url"))


@query("annotation_tags", "SELECT stories_id, 'people' AS tag_set, 'Ann ' || stories_id % 3 AS tag FROM stories UNION SELECT stories_id, 'labels', 'sport' FROM stories WHERE stories_id % 2 = 0")
def _(e):
    json = F.format_string('{"people": ["Ann %d"], "labels": [{"label": "sport", "score": 0.%d}]}', F.col("stories_id") % 3, F.when(F.col("stories_id") % 2 == 0, 9).otherwise(1))
    return readers.annotation_tags(e.stories.select("stories_id", json.alias("annotation")))


@query("csv_round_trip", "SELECT media_id, name FROM media")
def _(e):
    path = table_path(e.spark, "csv")
    sinks.csv_dump(e.media.select("media_id", "name"), path)
    return e.spark.read.csv(path, header=True, schema="media_id long, name string")


@query("json_round_trip", "SELECT media_id, name FROM media")
def _(e):
    path = table_path(e.spark, "json")
    sinks.json_dump(e.media.select("media_id", "name"), path)
    return e.spark.read.schema("media_id long, name string").json(path)


@query("snapshot_copy_round_trip", "SELECT media_id, name, 4 AS snapshots_id FROM media")
def _(e):
    path = table_path(e.spark, "snapshots")
    sinks.snapshot_copy(e.media.select("media_id", "name"), path, "snapshots_id", 4)
    sinks.snapshot_copy(e.media.select("media_id", "name"), path, "snapshots_id", 4)
    return e.spark.read.parquet(path)


@query("daily_urls_round_trip", "SELECT url AS \"value\" FROM stories WHERE CAST(publish_date AS DATE) = DATE '2024-02-01'")
def _(e):
    path = table_path(e.spark, "urls")
    sinks.daily_urls(e.stories, "2024-02-01", path)
    return e.spark.read.text(path)


@query("host_throttle", "SELECT medium, arg_max(stat_date, (num_stories, stat_date)) AS stat_date FROM daily GROUP BY 1")
def _(e):
    pending = e.daily.select(F.col("medium").alias("host"), "medium", "stat_date", (-F.col("num_stories")).alias("priority"), F.unix_date("stat_date").alias("downloads_id"))
    return streams.throttle(pending).select("medium", "stat_date")


@query("stale_downloads", "SELECT post_id, CASE WHEN publish_date < TIMESTAMP '2024-01-09' THEN 'pending' ELSE 'fetching' END AS state FROM posts")
def _(e):
    rows = e.posts.select("post_id", F.lit("fetching").alias("state"), F.col("publish_date").alias("download_time"))
    return streams.stale_to_pending(rows, F.lit("2024-01-10").cast("timestamp_ntz")).select("post_id", "state")


def _streamed(e, rows, make, mode="append"):
    """Write rows, read them as a stream, and run it to its end into a table."""
    spark, source = e.spark, table_path(e.spark, "source")
    rows.write.parquet(source)
    out, mark = table_path(spark, "sink"), table_path(spark, "marks")
    stream = make(spark.readStream.schema(rows.schema).parquet(source))
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("stream_story_dedup", "SELECT DISTINCT author, channel FROM posts")
def _(e):
    rows = e.posts.select("author", "channel", F.col("publish_date").cast("timestamp").alias("collect_date"))
    return _streamed(e, rows, lambda s: streams.story_stream_dedup(s, ["author", "channel"], late="100 days")).select("author", "channel")


@query("stream_rolling_counts", "SELECT CAST(publish_date AS DATE) AS day, channel, count(*) AS n FROM posts GROUP BY 1, 2")
def _(e):
    rows = e.posts.select("channel", F.col("publish_date").cast("timestamp").alias("at"))
    out = _streamed(e, rows, lambda s: streams.rolling_counts(s, "at", "channel", "1 day", "1 day"), "complete")
    return out.select(F.to_date("window.start").alias("day"), "channel", "n")


@query("health_active_feed", "SELECT medium, medium IN ('view', 'click') AS has_active_feed FROM (SELECT DISTINCT medium FROM daily)")
def _(e):
    feeds = e.daily.select("medium").distinct().select("medium", F.col("medium").isin("view", "click").alias("active"))
    rows = e.daily.groupBy("medium").agg(*(F.sum(c).cast("double").alias(c + s) for c in ("num_stories", "num_sentences") for s in ("_w", "_y", "_90")))
    return H.health_status(rows, feeds).select("medium", "has_active_feed")




# Streams in several batches


def _in_batches(e, parts, start):
    """Write the parts one after another to a folder that a stream reads; it runs to its end behind each, so a part is a batch of all its files.

    ``start`` starts the stream; it must go on from one checkpoint.
    """
    path = table_path(e.spark, "batches")
    for part in parts:
        part.write.mode("append").parquet(path)
        start(e.spark.readStream.schema(parts[0].schema).parquet(path)).awaitTermination()


@query("stream_daily_load", "SELECT CAST(publish_date AS DATE) AS day, count(*) AS posts, date_diff('day', CAST(publish_date AS DATE), (SELECT max(CAST(publish_date AS DATE)) FROM posts)) > 1 AS complete FROM posts GROUP BY 1")
def _(e):
    """A first load without every third post, then one of all posts: late ones come in, none comes twice."""
    posts = e.posts.withColumn("publish_date", F.col("publish_date").cast("timestamp"))
    path, marks = table_path(e.spark, "days"), table_path(e.spark, "marks")
    _in_batches(e, [posts.filter("post_id % 3 <> 0"), posts], lambda stream: streams.daily_load(stream, path, marks))
    return streams.loaded_days(e.spark, path)


@query("stream_index_search", ", tokens AS (SELECT stories_id, regexp_extract_all(lower(CASE WHEN stories_id % 4 = 0 THEN 'press release' ELSE text END), '[\\p{L}\\p{N}_]+') AS w FROM stories WHERE stories_id % 9 <> 0) SELECT stories_id FROM tokens WHERE (list_contains(w, 'press') OR list_contains(w, 'with')) AND NOT list_contains(w, 'from')")
def _(e):
    """Stories come in, some are changed and some deleted; the index follows the stream of changes."""
    from tidings.operators.index import SearchIndex

    rows = e.stories.select("stories_id", "text", F.lit(False).alias("deleted"))
    changed = rows.filter("stories_id % 4 = 0").withColumn("text", F.lit("press release"))
    gone = rows.filter("stories_id % 9 = 0").select("stories_id", "text", F.lit(True).alias("deleted"))
    index, marks = SearchIndex(e.spark), table_path(e.spark, "marks")
    _in_batches(e, [rows, changed, gone], lambda stream: streams.index_stream(stream, index, marks))
    return index.search("(press or with) and not from")


ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("stream_domain_lock", ", grants AS (SELECT * FROM (WITH RECURSIVE g AS (SELECT author, min(publish_date) AS t FROM posts GROUP BY 1 UNION ALL SELECT g.author, (SELECT min(p.publish_date) FROM posts p WHERE p.author = g.author AND p.publish_date >= g.t + INTERVAL 6 HOUR) FROM g WHERE g.t IS NOT NULL) SELECT * FROM g WHERE t IS NOT NULL)) SELECT author, strftime(t, '%Y-%m-%d %H:%M:%S') AS granted_at FROM grants")
def _(e):
    """Each author is a domain whose requests are granted six hours apart, by state with timers."""
    old = e.spark.conf.get(ROCKS[0])
    e.spark.conf.set(*ROCKS)
    try:
        rows = e.posts.select(F.col("author").cast("string").alias("domain"), F.col("publish_date").cast("timestamp").alias("at"))
        out = _streamed(e, rows, lambda s: streams.domain_lock(s, 6 * 3600, "100 days"))
    finally:
        e.spark.conf.set(ROCKS[0], old)
    return out.filter("granted").select(F.col("domain").cast("long").alias("author"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("granted_at"))


@query("saved_posts", "SELECT author, count(*) AS posts, CAST(min(publish_date) AS DATE) AS first_day FROM posts WHERE channel = 'view' AND publish_date >= TIMESTAMP '2024-01-10' GROUP BY 1")
def _(e):
    """Posts saved as JSON lines and read again through the data source, which takes the filters."""
    post_source.register(e.spark)
    path = table_path(e.spark, "posts")
    e.posts.select(F.col("post_id").cast("string").alias("id"), F.struct(F.col("author").alias("name")).alias("by"), F.col("channel"), F.lit("seen").alias("text"), F.date_format("publish_date", "yyyy-MM-dd'T'HH:mm:ss").alias("date")).write.json(path)
    rows = e.spark.read.format("saved_posts").options(path=path, field_author="by.name").load()
    kept = rows.filter((F.col("channel") == "view") & (F.col("publish_date") >= F.lit("2024-01-10 00:00:00").cast("timestamp")))
    return kept.groupBy(F.col("author").cast("long").alias("author")).agg(F.count("*").alias("posts"), F.to_date(F.min("publish_date")).alias("first_day"))


# Rules on data that puts them to the test


@query("co_sharing_adaptive_rows", PAIRS.replace("range(0, 12)", "range(0, 22)") + " SELECT a_id, b_id, seconds FROM pairs, chosen WHERE seconds <= s ORDER BY seconds, a_id, b_id LIMIT (SELECT n FROM n)")
def _(e):
    """The interval may go down to 15 seconds, where some authors have shared two stories."""
    posts = e.posts.filter("stories_id is not null")
    return T.co_sharing_links(posts, posts.select("stories_id").distinct().count(), least=15)


@query("period_stories_first_month", ", f AS (SELECT date_trunc('month', min(publish_date)) AS lo FROM topic_stories), own AS (SELECT stories_id FROM topic_stories, f WHERE publish_date BETWEEN lo AND lo + INTERVAL 1 MONTH - INTERVAL 1 SECOND) SELECT stories_id FROM own UNION SELECT ref_stories_id FROM topic_links JOIN own USING (stories_id) WHERE ref_stories_id IN (SELECT stories_id FROM topic_stories)")
def _(e):
    first = F.lit(e.topic_stories.agg(F.date_trunc("month", F.min("publish_date"))).first()[0]).cast("timestamp_ntz")
    return T.period_stories(e.topic_stories, e.topic_links, first, first + F.expr("interval 1 month"))


@query("join_anti_rows", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def _(e):
    return e.table("part").join(e.table("lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("tsquery_of_titles", "SELECT stories_id, '( ' || array_to_string(w, ' & ') || ' )' AS form FROM (SELECT stories_id, regexp_extract_all(lower(title), '[a-z]{3,}')[1:3] AS w FROM stories) WHERE len(w) = 3 AND len(list_intersect(w, ['and', 'not'])) = 0")
def _(e):
    """The first three words of each title, joined by AND, in the notation of text search queries."""
    words = F.slice(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{3,}"), F.lit(0)), 1, 3)
    rows = e.stories.select("stories_id", words.alias("w")).filter((F.size("w") == 3) & ~F.arrays_overlap("w", F.array(F.lit("and"), F.lit("not"))))

    @F.pandas_udf("string")
    def form(queries: pd.Series) -> pd.Series:
        return queries.map(boolean.tsquery)

    return rows.select("stories_id", form(F.array_join("w", " AND ")).alias("form"))


@query("latest_overall_of_media", "SELECT media_id AS topics_id, arg_max(stories_id, (publish_date, stories_id)) AS timespans_id FROM stories WHERE stories_id % 3 = 0 AND publish_date IS NOT NULL GROUP BY 1")
def _(e):
    """Each medium as a topic and its stories as timespans, every third of them overall."""
    rows = e.stories.filter("publish_date is not null").select(F.col("media_id").alias("topics_id"), F.col("stories_id").alias("timespans_id"), F.when(F.col("stories_id") % 3 == 0, "overall").otherwise("weekly").alias("period"), F.col("publish_date").alias("snapshot_date"))
    return T.latest_overall(rows)


@query("page_url_forms", "SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '[?&](utm_source|ref)=[^&]*', '') AS url FROM pages")
def _(e):
    """URLs of pages without what tracks readers and without fragments."""
    tidy = F.regexp_replace(urls.normalize_url(F.concat("url")), r"\?$", "")
    return e.table("pages").select("page_id", tidy.alias("url"))


@query("page_dates", "SELECT page_id, CASE WHEN page_id % 6 = 5 THEN NULL ELSE DATE '2023-01-01' + CAST(page_id % 400 AS INTEGER) END AS day, CASE page_id % 6 WHEN 0 THEN 'guess_by_meta_article:published_time' WHEN 1 THEN 'guess_by_url' WHEN 2 THEN 'guess_by_time_tag' WHEN 3 THEN 'guess_by_text' WHEN 4 THEN 'guess_by_meta_datePublished' ELSE 'undateable' END AS method FROM pages")
def _(e):
    """The pages with a date planted in the way that a page's number asks for; those of others have weaker evidence of another day."""
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") % 400).cast("int"))
    k, iso = F.col("page_id") % 6, F.date_format(day, "yyyy-MM-dd")
    meta = F.when(k == 0, F.concat(F.lit('<meta property="article:published_time" content="'), iso, F.lit('T08:00:00Z">'))).when(k == 4, F.concat(F.lit('<meta content="'), iso, F.lit('" itemprop="datePublished"><time datetime="2001-02-03">'))).otherwise("")
    tag = F.when(k == 2, F.concat(F.lit('<time class="x" datetime="'), iso, F.lit('">'))).when(k == 0, "<time datetime='2001-02-03'>").otherwise("")
    text = F.when(k == 3, F.concat(F.lit("<p>Posted <b>on</b> "), F.date_format(day, "MMMM d, yyyy"))).when(k == 2, "<p>published 4 May 1999").otherwise("<p>published soon, 31 February 2020")
    url = F.when(k == 1, F.concat(F.lit("http://x.example.com/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/a"))).otherwise(F.col("url"))
    return e.table("pages").select("page_id", dates.guess_date(url, F.concat(meta, tag, text, "html")).alias("g")).select("page_id", "g.*")


@query("page_media", "SELECT p.page_id, m.media_id FROM (SELECT page_id, regexp_extract(url, '^https?://((m|blog|www)\\.)?([^/?#:]+)', 3) AS h FROM pages) p JOIN (SELECT h, arg_min(page_id, (page_id % 2 = 0, page_id)) AS media_id FROM (SELECT page_id, regexp_extract(url, '^https?://((m|blog|www)\\.)?([^/?#:]+)', 3) AS h FROM pages WHERE page_id % 3 = 0) GROUP BY 1) m USING (h)")
def _(e):
    """Every third page's host is a medium; the medium of each page, found by the lossy form of its site."""
    site = F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("/"))
    pages = e.table("pages").select("page_id", site.alias("url"))
    media = pages.filter("page_id % 3 = 0").select(F.col("page_id").alias("media_id"), "url", F.lit(None).cast("long").alias("dup_media_id"))
    found = M.medium_by_url(pages.select("url").distinct(), media, media.filter("media_id % 2 = 0"))
    return pages.join(found, "url").select("page_id", "media_id")


@query("page_media_duplicates", "WITH h AS (SELECT page_id, regexp_extract(url, '^https?://((m|blog|www)\\.)?([^/?#:]+)', 3) AS h FROM pages) SELECT page_id AS media_id, least AS dup_of FROM (SELECT page_id, min(page_id) OVER (PARTITION BY h) AS least FROM h) WHERE page_id <> least".replace("WITH h AS", ", h AS"))
def _(e):
    site = F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("/"))
    return M.dedup_media(e.table("pages").select(F.col("page_id").alias("media_id"), site.alias("url"), F.lit(None).cast("long").alias("dup_media_id")))


@query("topic_permission_of", "SELECT DISTINCT author AS \"user\", stories_id % 40 AS topic, CASE WHEN author % 5 = 0 THEN 'admin' WHEN (author + stories_id % 40) % 4 = 0 THEN 'write' WHEN stories_id % 40 % 2 = 0 THEN 'read' ELSE 'none' END AS permission FROM posts WHERE stories_id IS NOT NULL")
def _(e):
    """Permissions of the pairs that posts ask for."""
    asked = e.posts.filter("stories_id is not null").select(F.col("author").alias("user"), (F.col("stories_id") % 40).alias("topic"))
    users = asked.select("user").distinct().withColumn("is_admin", F.col("user") % 5 == 0)
    topics = asked.select("topic").distinct().withColumn("is_public", F.col("topic") % 2 == 0)
    grants = asked.distinct().filter("(user + topic) % 4 = 0").withColumn("permission", F.lit("write"))
    return T.permissions_of(asked, users, topics, grants)


_CLOSED = ", RECURSIVE_NONE AS (SELECT 1), seeds AS (SELECT stories_id FROM stories WHERE stories_id % 37 = 0), m AS (SELECT * FROM (WITH RECURSIVE c AS (SELECT media_id FROM stories WHERE stories_id % 37 = 0 UNION SELECT m.dup_media_id FROM media m JOIN c USING (media_id) WHERE m.dup_media_id IS NOT NULL) SELECT * FROM c)), kept_tags AS (SELECT DISTINCT tags_id FROM story_tags WHERE stories_id IN (SELECT stories_id FROM seeds))"


@query("closed_export", _CLOSED + " SELECT 'stories' AS \"table\", stories_id AS id FROM seeds UNION ALL SELECT 'media', media_id FROM m UNION ALL SELECT 'feeds', feeds_id FROM feeds WHERE media_id IN (SELECT media_id FROM m) UNION ALL SELECT 'tags', tags_id FROM kept_tags UNION ALL SELECT 'story_tags', stories_id * 10 + tags_id FROM story_tags WHERE stories_id IN (SELECT stories_id FROM seeds)")
def _(e):
    """Every 37th story with its tags, its medium, those it is a duplicate of, and their feeds."""
    tables = {"stories": e.stories.select("stories_id", "media_id"), "media": e.media, "feeds": e.feeds, "tags": e.tags, "story_tags": e.story_tags.withColumn("id", F.col("stories_id") * 10 + F.col("tags_id"))}
    keys = {"stories": "stories_id", "media": "media_id", "feeds": "feeds_id", "tags": "tags_id", "story_tags": "id"}
    refs = [X.Reference("stories", "media_id", "media"), X.Reference("media", "dup_media_id", "media"), X.Reference("feeds", "media_id", "media", True), X.Reference("story_tags", "stories_id", "stories", True), X.Reference("story_tags", "tags_id", "tags")]
    out = X.closed_subset(tables, keys, refs, {"stories": e.stories.filter("stories_id % 37 = 0")})
    parts = [out[t].select(F.lit(t).alias("table"), F.col(keys[t]).alias("id")) for t in keys]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


@query("sql_functions", ", weeks AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-12', INTERVAL 7 DAY)) AS DATE) AS week) SELECT week, count(stories_id) AS stories, min(substr(md5(url), 1, 16)) AS first_hash FROM weeks LEFT JOIN stories ON publish_date >= week AND publish_date < week + INTERVAL 7 DAY AND regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])the') GROUP BY 1")
def _(e):
    """A query written as SQL over the library's functions: a table function, a predicate and values."""
    sql.register(e.spark)
    return e.spark.sql(
        "SELECT week, count(stories_id) AS stories, min(half_md5(url)) AS first_hash FROM weeks_between(DATE'2024-01-01', DATE'2024-02-12') LEFT JOIN {stories} ON week_start_date(CAST(publish_date AS DATE)) = week AND word_starts(text, 'the') GROUP BY week",
        stories=e.stories,
    )


# Sources that are files, written from the tables and read again


@query("feed_items", "SELECT url, CASE WHEN stories_id % 3 = 0 THEN url ELSE 'tag:' || stories_id END AS guid, CASE WHEN stories_id % 4 = 0 THEN '(no title)' ELSE language || ' ' || stories_id END AS title FROM stories")
def _(e):
    """Stories as items of RSS files; items without a guid or a title get the reader's own."""
    path = table_path(e.spark, "feed")
    guid = F.when(F.col("stories_id") % 3 != 0, F.concat(F.lit("tag:"), F.col("stories_id").cast("string")))
    title = F.when(F.col("stories_id") % 4 != 0, F.concat_ws(" ", "language", F.col("stories_id").cast("string")))
    e.stories.select(F.col("url").alias("link"), guid.alias("guid"), title.alias("title")).write.format("xml").option("rowTag", "item").option("rootTag", "rss").save(path)
    return readers.syndicated_feed(e.spark, path).select("url", "guid", "title")


@query("csv_posts", "SELECT CAST(post_id AS VARCHAR) AS post_id, CAST(author AS VARCHAR) AS author, CASE WHEN post_id % 5 = 0 THEN CAST(author AS VARCHAR) ELSE channel END AS channel FROM posts WHERE publish_date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND post_id % 7 <> 0")
def _(e):
    """Posts as CSV files, read within two dates; posts without content go, and a missing channel is the author."""
    path = table_path(e.spark, "csv_posts")
    content = F.when(F.col("post_id") % 7 != 0, F.concat(F.lit('said "hi",\n'), F.col("post_id").cast("string")))
    channel = F.when(F.col("post_id") % 5 != 0, F.col("channel"))
    rows = e.posts.select(content.alias("content"), F.col("author").cast("string").alias("author"), channel.alias("channel"), F.date_format("publish_date", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("publish_date"), F.col("post_id").cast("string").alias("post_id"), F.lit("http://a.example.com/").alias("url"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    day = lambda d: F.lit(d).cast("timestamp")
    return readers.csv_posts(e.spark, path, day("2024-01-05"), day("2024-01-12")).select("post_id", "author", "channel")


@query("stream_sentence_dedup", "SELECT DISTINCT media_id, CAST(date_trunc('week', publish_date) AS DATE) AS week, md5(sentence) AS h FROM sentences WHERE publish_date IS NOT NULL")
def _(e):
    rows = e.sentences.filter("publish_date is not null").select("media_id", "sentence", F.col("publish_date").cast("timestamp").alias("publish_date"))
    out = _streamed(e, rows, lambda s: streams.sentence_stream_dedup(s, late="365 days"))
    return out.select("media_id", F.to_date("week").alias("week"), "h")


@query("split_tags", "SELECT stories_id, 'lang' AS tag_set, language || ':' || media_id AS tag FROM stories")
def _(e):
    tag = readers.split_tag(F.concat(F.lit(" lang : "), "language", F.lit(":"), F.col("media_id").cast("string"), F.lit(" ")))
    return e.stories.select("stories_id", tag.alias("t")).select("stories_id", "t.*")
