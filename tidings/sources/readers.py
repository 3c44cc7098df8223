"""Readers of feeds, posts, annotations and blobs from files; fetching them is outside the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions.boolean import predicate
from tidings.functions.urls import http_urls_in_string, is_homepage_url

FEED_SCHEMA = "title string, link struct<_VALUE: string, _href: string>, id string, updated string, summary string, guid string, pubDate string, description string"
POST_SCHEMA = "content string, author string, channel string, publish_date timestamp, post_id string, url string"


def relational(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options) -> DataFrame:
    """A table of a database; by key ranges in parallel where a key is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def syndicated_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """``url, guid, title, description, published``: items of RSS or Atom files.

    The guid falls back to the URL, also where it is a home page; the title to ``(no title)``.
    """
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(FEED_SCHEMA).load(path)
    # an entry of an Atom file names its address in an attribute, and its id, day and text otherwise
    rows = rows.select("title", F.coalesce("link._href", "link._VALUE").alias("link"), F.coalesce("guid", "id").alias("guid"), F.coalesce("pubDate", "updated").alias("pubDate"), F.coalesce("description", "summary").alias("description")).filter("link is not null")
    guid = F.when(F.col("guid").isNull() | (F.trim("guid") == "") | is_homepage_url(F.col("guid")), F.col("link")).otherwise(F.col("guid"))
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "(no title)").otherwise(F.trim("title"))
    return rows.select(F.trim("link").alias("url"), guid.alias("guid"), title.alias("title"), "description", F.col("pubDate").alias("published"))


#: Readers by the type of a feed; pages and podcasts come in as feeds or blobs of their own.
FEED_READERS = {"syndicated": syndicated_feed, "podcast": syndicated_feed}


def csv_posts(spark: SparkSession, path: str, start: Column, end: Column) -> DataFrame:
    """Posts of CSV files within both dates; the channel falls back to the author."""
    rows = spark.read.csv(path, header=True, schema=POST_SCHEMA, multiLine=True, enforceSchema=False)
    rows = rows.filter(F.col("content").isNotNull() & F.col("author").isNotNull() & F.col("publish_date").between(start, end))
    return rows.withColumn("channel", F.coalesce("channel", "author")).withColumn("post_id", F.coalesce("post_id", F.md5(F.concat_ws("|", "author", F.col("publish_date").cast("string"), "content"))))


def json_posts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Posts from saved API answers, one JSON object a line."""
    return spark.read.schema(schema).json(path)


def daily_posts(posts: DataFrame, query: str, ignored_hosts: list[str] | None = None) -> DataFrame:
    """``day, post_id, url``: URLs of posts that match the topic, each once a day."""
    rows = posts.filter(predicate(query, "content")).select(F.to_date("publish_date").alias("day"), "post_id", F.explode(http_urls_in_string(F.col("content"))).alias("url"))
    for host in ignored_hosts or []:
        rows = rows.filter(~F.contains("url", F.lit(host)))
    return rows.dropDuplicates(["day", "post_id", "url"])


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Key to bytes; gzip and bzip2 texts are read by ``spark.read.text`` as they are."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("key"), "content")


def annotation_tags(rows: DataFrame, json_col: str = "annotation", least: float = 0.2) -> DataFrame:
    """``stories_id, tag_set, tag``: people, organizations, places and labels of JSON annotations."""
    schema = "struct<people: array<string>, organizations: array<string>, countries: array<string>, labels: array<struct<label: string, score: double>>>"
    parsed = rows.select("stories_id", F.from_json(json_col, schema).alias("a"))
    out = None
    for name in ("people", "organizations", "countries"):
        part = parsed.select("stories_id", F.lit(name).alias("tag_set"), F.explode(f"a.{name}").alias("tag"))
        out = part if out is None else out.union(part)
    labels = parsed.select("stories_id", F.inline("a.labels")).filter(F.col("score") > least).select("stories_id", F.lit("labels").alias("tag_set"), F.col("label").alias("tag"))
    return out.union(labels).distinct()


def split_tag(tag: Column) -> Column:
    """``set:tag`` as its two parts."""
    return F.struct(F.trim(F.substring_index(tag, ":", 1)).alias("tag_set"), F.trim(F.substr(tag, F.instr(tag, ":") + 1)).alias("tag"))
