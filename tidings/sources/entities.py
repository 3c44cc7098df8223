"""The driver's tables as the entities of the data model.

``documents`` are stories and their media, ``labels`` story tags, ``events`` posts,
``customer``, ``orders`` and ``lineitem`` the stories and links of a topic.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Links, about, that a task tells apart.
LINKS_IN_TASK = 500_000


class Entities:
    """Lazy DataFrames over one directory of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def stories(self) -> DataFrame:
        when = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 120 as int), cast(doc_id % 24 as int))")
        return self.table("documents").select(
            F.col("doc_id").alias("stories_id"),
            F.substring("source", 4, 10).cast("long").alias("media_id"),
            F.concat(F.lit("http://www."), "source", F.lit(".example.com/news/"), F.col("doc_id").cast("string")).alias("url"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            "text",
            F.col("lang").alias("language"),
            F.when(F.col("doc_id") % 97 != 0, when).alias("publish_date"),
            (F.col("doc_id") % 11 == 0).alias("full_text_rss"),
        )

    @cached_property
    def sentences(self) -> DataFrame:
        rows = self.stories.select("stories_id", "media_id", "publish_date", "language", F.posexplode(F.split("text", "\n")).alias("sentence_number", "sentence"))
        return rows.withColumn("sentence", F.trim("sentence")).filter("sentence <> ''").withColumn("sentence_number", F.col("sentence_number").cast("long"))

    @cached_property
    def media(self) -> DataFrame:
        rows = self.table("documents").select("source").distinct().select(F.substring("source", 4, 10).cast("long").alias("media_id"), F.col("source").alias("name"), F.concat(F.lit("http://www."), "source", F.lit(".example.com/")).alias("url"))
        return rows.withColumn("dup_media_id", F.when((F.col("media_id") % 4).isin(2, 3), F.col("media_id") - 1)).withColumn("foreign_rss_links", F.col("media_id") % 5 == 0)

    @cached_property
    def feeds(self) -> DataFrame:
        rows = self.media.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("k"))
        return rows.select((F.col("media_id") * 10 + F.col("k")).alias("feeds_id"), "media_id", F.when(F.col("k") == 1, "web_page").otherwise("syndicated").alias("type"), ((F.col("media_id") + F.col("k")) % 3 != 0).alias("active"))

    @cached_property
    def story_tags(self) -> DataFrame:
        labels = self.table("labels")
        return labels.select(F.col("doc_id").alias("stories_id"), (F.col("quality") + 1).cast("long").alias("tags_id")).union(labels.select("doc_id", (F.col("toxic") + 3).cast("long")))

    @cached_property
    def tags(self) -> DataFrame:
        return self.spark.createDataFrame([(1, 1, "low quality"), (2, 1, "high quality"), (3, 2, "civil"), (4, 2, "toxic"), (100, 10, "press"), (101, 10, "broadcast"), (102, 10, "Not Typed"), (200, 20, "left"), (201, 20, "right")], "tags_id long, tag_sets_id long, tag string")

    @cached_property
    def media_tags(self) -> DataFrame:
        m = self.media
        return m.select("media_id", (F.col("media_id") % 3 + 100).alias("tags_id")).union(m.filter("media_id % 7 <> 0").select("media_id", F.col("media_id") % 2 + 200))

    @cached_property
    def posts(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("post_id"), F.col("user_id").alias("author"), F.col("event_type").alias("channel"), F.col("ts").alias("publish_date"), F.get_json_object("props", "$.k").cast("long").alias("stories_id"))

    @cached_property
    def topic_stories(self) -> DataFrame:
        first = self.table("orders").groupBy(F.col("o_custkey").alias("stories_id")).agg(F.min("o_orderdate").alias("publish_date"))
        return self.table("customer").select(F.col("c_custkey").alias("stories_id"), F.col("c_nationkey").cast("long").alias("media_id"), F.col("c_name").alias("title")).join(first, "stories_id", "left")

    @cached_property
    def link_parts(self) -> int:
        """Tasks that links are dealt to."""
        return -(-self.table("lineitem").count() // LINKS_IN_TASK) or 1

    @cached_property
    def topic_links(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("stories_id"))
        links = self.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("ref_stories_id")).repartition(self.link_parts, "o_orderkey").join(orders, "o_orderkey")
        # dealt first, and by a number that grows with the rows: a task's table of distinct links stays of one size
        return links.filter("stories_id <> ref_stories_id").select("stories_id", "ref_stories_id").repartition(self.link_parts, "stories_id", "ref_stories_id").distinct()

    @cached_property
    def daily(self) -> DataFrame:
        """Counts of each medium (an event type) and day, for the health of sources."""
        return self.table("events").groupBy(F.col("event_type").alias("medium"), F.to_date("ts").alias("stat_date")).agg(F.count("*").alias("num_stories"), F.countDistinct("user_id").alias("num_sentences"))


#: The same entities for DuckDB, to put before a query that is to agree.
ENTITIES_SQL = """WITH stories AS (
  SELECT doc_id AS stories_id, CAST(substr(source, 4) AS BIGINT) AS media_id, 'http://www.' || source || '.example.com/news/' || doc_id AS url,
    split_part(text, chr(10), 1) AS title, text, lang AS language,
    CASE WHEN doc_id % 97 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 120 AS INTEGER)) + to_hours(doc_id % 24) END AS publish_date,
    doc_id % 11 = 0 AS full_text_rss
  FROM documents),
raw_sentences AS (
  SELECT stories_id, media_id, publish_date, language, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM stories),
sentences AS (
  SELECT stories_id, media_id, publish_date, language, CAST(n AS BIGINT) AS sentence_number, trim(s) AS sentence FROM raw_sentences WHERE trim(s) <> ''),
media AS (
  SELECT CAST(substr(source, 4) AS BIGINT) AS media_id, source AS name, 'http://www.' || source || '.example.com/' AS url,
    CASE WHEN CAST(substr(source, 4) AS BIGINT) % 4 IN (2, 3) THEN CAST(substr(source, 4) AS BIGINT) - 1 END AS dup_media_id,
    CAST(substr(source, 4) AS BIGINT) % 5 = 0 AS foreign_rss_links
  FROM (SELECT DISTINCT source FROM documents)),
feeds AS (
  SELECT media_id * 10 + k AS feeds_id, media_id, CASE WHEN k = 1 THEN 'web_page' ELSE 'syndicated' END AS type, (media_id + k) % 3 <> 0 AS active
  FROM media, (VALUES (0), (1), (2)) v(k)),
story_tags AS (
  SELECT doc_id AS stories_id, CAST(quality + 1 AS BIGINT) AS tags_id FROM labels UNION ALL SELECT doc_id, toxic + 3 FROM labels),
tags AS (
  SELECT * FROM (VALUES (1, 1, 'low quality'), (2, 1, 'high quality'), (3, 2, 'civil'), (4, 2, 'toxic'), (100, 10, 'press'), (101, 10, 'broadcast'), (102, 10, 'Not Typed'), (200, 20, 'left'), (201, 20, 'right')) t(tags_id, tag_sets_id, tag)),
media_tags AS (
  SELECT media_id, media_id % 3 + 100 AS tags_id FROM media UNION ALL SELECT media_id, media_id % 2 + 200 FROM media WHERE media_id % 7 <> 0),
posts AS (
  SELECT event_id AS post_id, user_id AS author, event_type AS channel, ts AS publish_date, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS stories_id FROM events),
topic_stories AS (
  SELECT c_custkey AS stories_id, CAST(c_nationkey AS BIGINT) AS media_id, c_name AS title, d AS publish_date
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey),
topic_links AS (
  SELECT DISTINCT o_custkey AS stories_id, l_suppkey AS ref_stories_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey),
daily AS (
  SELECT event_type AS medium, CAST(ts AS DATE) AS stat_date, count(*) AS num_stories, count(DISTINCT user_id) AS num_sentences FROM events GROUP BY 1, 2)
"""
