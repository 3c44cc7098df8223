"""Lists over a topic's snapshots: timespans and their counts, media, focal sets, siblings, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.operators import spanbits as B
from tidings.operators.storage import materialize

# Platforms whose seed queries become subtopics, the technique's name, rows of a page.
SHARING_PLATFORMS, SHARING, PAGE_ROWS = ["twitter", "reddit", "generic_post"], "URL Sharing", 20
#: Fields that a public list of stories may show.
PUBLIC_STORY_FIELDS = "stories_id media_id url title publish_date language".split()


def timespan_link_counts(stories: DataFrame, cross_links: DataFrame, period: str, parts: int | None = None) -> DataFrame:
    """``start_date, stories_id, inlink_count, media_inlink_count, outlink_count`` of every timespan of a period at once.

    A link counts in a timespan that has both its ends. A story's timespans are words of bits, so a link meets few
    rows, and timespans are told apart after the counts. Links are dealt to ``parts`` tasks, where it is given.
    """
    dealt = lambda df, *by: df.repartition(parts, *by) if parts else df
    kind = F.lit(B.PERIODS.index(period))
    start = F.date_trunc("week" if period == "weekly" else "month", "publish_date").cast("date")
    dated = stories.filter("publish_date is not null").select("stories_id", B.number_of(kind, start).alias("number")).select("stories_id", *B.words("number"))
    linked = cross_links.join(dated, "stories_id").select(F.col("ref_stories_id").alias("stories_id"), "word", "bits")
    inside = materialize(dealt(dated.union(linked), "stories_id").groupBy("stories_id", "word").agg(F.bit_or("bits").alias("bits")), "inside")
    going = dealt(cross_links.join(inside, "stories_id"), "ref_stories_id", "word")
    coming = dealt(inside.select(F.col("stories_id").alias("ref_stories_id"), "word", F.col("bits").alias("other")), "ref_stories_id", "word")
    both = going.join(coming, ["ref_stories_id", "word"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("other"))).filter("bits <> 0")
    both = materialize(both.select("stories_id", "ref_stories_id", "word", "bits"), "both")
    linking = dealt(both.join(stories.select("stories_id", "media_id"), "stories_id"), "ref_stories_id").groupBy(F.col("ref_stories_id").alias("stories_id"), "word", "media_id").agg(F.bit_or("bits").alias("bits"), *B.bit_counts("inlink_count"))
    linking = linking.withColumn("bits", F.when(F.col("media_id").isNotNull(), F.col("bits")))
    inlinks = linking.groupBy("stories_id", "word").agg(*(F.sum(f"inlink_count_{k}").alias(f"inlink_count_{k}") for k in range(B.WIDTH)), *B.bit_counts("media_inlink_count"))
    outlinks = dealt(both.select("stories_id", "word", "bits"), "stories_id").groupBy("stories_id", "word").agg(*B.bit_counts("outlink_count"))
    rows = inside.join(inlinks, ["stories_id", "word"], "left").join(outlinks, ["stories_id", "word"], "left")
    names = ["inlink_count", "media_inlink_count", "outlink_count"]
    own = rows.select("stories_id", "word", *(B.has("bits", k).alias(f"in_{k}") for k in range(B.WIDTH)), *(F.coalesce(f"{n}_{k}", F.lit(0).cast("long")).alias(f"{n}_{k}") for n in names for k in range(B.WIDTH)))
    return B.by_number(own, ["stories_id"], ["in", *names]).select(B.start_of(kind, F.col("number")).alias("start_date"), "stories_id", *names)


def row_statistics(counts: DataFrame, stories: DataFrame) -> DataFrame:
    """One row per timespan: its stories, media, links, and stories that are linked."""
    rows = counts.join(stories.select("stories_id", "media_id"), "stories_id")
    return rows.groupBy("start_date").agg(F.count("*").alias("stories"), F.countDistinct("media_id").alias("media"), F.sum("outlink_count").alias("links"), F.count(F.when(F.col("inlink_count") > 0, 1)).alias("linked_stories"))


def create_views(tables: dict[str, DataFrame], prefix: str, timespan: Column | None = None) -> list[str]:
    """Temporary views ``prefix_name`` over snapshot tables, cut to one timespan where they have one; returns their names."""
    names = []
    for name, table in tables.items():
        own = table.filter(timespan) if timespan is not None and "start_date" in table.columns else table
        own.createOrReplaceTempView(f"{prefix}_{name}")
        names.append(f"{prefix}_{name}")
    return names


def sharing_foci(seed_queries: DataFrame, definitions: DataFrame) -> DataFrame:
    """Focus definitions with one for each seed query of the sharing platforms.

    Those of seed queries that are gone go; existing ones stay; new ones are named by platform and id.
    ``definitions``: topics_id, focal_technique, name, arguments (JSON).
    """
    seed = F.get_json_object("arguments", "$.topic_seed_queries_id").cast("long")
    ours = definitions.filter(F.col("focal_technique") == SHARING).withColumn("topic_seed_queries_id", seed)
    kept = ours.join(seed_queries.select("topics_id", "topic_seed_queries_id"), ["topics_id", "topic_seed_queries_id"], "left_semi")
    wanted = seed_queries.filter(F.col("platform").isin(SHARING_PLATFORMS)).join(kept, ["topics_id", "topic_seed_queries_id"], "left_anti")
    arguments = F.to_json(F.struct(F.lit("url_sharing").alias("mode"), "topic_seed_queries_id"))
    made = wanted.select("topics_id", F.lit(SHARING).alias("focal_technique"), F.format_string("%s [%d]", "platform", "topic_seed_queries_id").alias("name"), arguments.alias("arguments"))
    return definitions.filter(F.col("focal_technique") != SHARING).unionByName(kept.drop("topic_seed_queries_id")).unionByName(made)


def focal_sets(foci: DataFrame) -> DataFrame:
    """``topics_id, focal_technique, foci``: foci nested in order of name, each with the query of its arguments."""
    query = F.coalesce(F.get_json_object("arguments", "$.query"), F.lit(""))
    return foci.groupBy("topics_id", "focal_technique").agg(F.array_sort(F.collect_list(F.struct("name", query.alias("query")))).alias("foci"))


def snapshot_list(topics: DataFrame, snapshots: DataFrame, timespans: DataFrame, permissions: DataFrame) -> DataFrame:
    """``user, topics_id, snapshots_id, timespans``: snapshots of the topics that a user may read, with their timespans nested."""
    nested = timespans.groupBy("snapshots_id").agg(F.array_sort(F.collect_list(F.struct("period", "start_date", "timespans_id"))).alias("timespans"))
    allowed = permissions.filter("permission <> 'none'").select("user", F.col("topic").alias("topics_id"))
    return topics.join(allowed, "topics_id").join(snapshots, "topics_id").join(nested, "snapshots_id", "left").select("user", "topics_id", "snapshots_id", "timespans")


def sibling_foci(counts: DataFrame, timespans: DataFrame, timespans_id: int) -> DataFrame:
    """``stories_id, foci_id``: subtopics in whose timespan of the same snapshot, period and dates a story is, too."""
    same = ["snapshots_id", "period", "start_date", "end_date"]
    own = timespans.filter(F.col("timespans_id") == timespans_id).select(*same)
    siblings = timespans.join(own, same).filter("foci_id is not null").select("timespans_id", "foci_id")
    here = counts.filter(F.col("timespans_id") == timespans_id).select("stories_id")
    return counts.join(siblings, "timespans_id").join(here, "stories_id", "left_semi").select("stories_id", "foci_id").distinct()


def topic_media(counts: DataFrame, media: DataFrame, media_tags: DataFrame, name: str | None = None, by: str = "inlink_count", rows: int = PAGE_ROWS, skip: int = 0) -> DataFrame:
    """A page of a topic's media by a count, ties by the md5 of their ids, with names and tags nested."""
    named = counts.join(media.select("media_id", "name"), "media_id")
    if name is not None:
        named = named.filter(F.contains(F.lower("name"), F.lit(name.lower())))
    page = named.orderBy(F.desc_nulls_last(by), F.desc(F.md5(F.col("media_id").cast("string")))).offset(skip).limit(rows)
    tags = media_tags.groupBy("media_id").agg(F.array_sort(F.collect_set("tags_id")).alias("tags"))
    return page.join(tags, "media_id", "left")


def paged(rows: DataFrame, order: list[Column], page: int = 0, limit: int = PAGE_ROWS) -> tuple[DataFrame, dict]:
    """A page of a list, and the parameters of the pages before and after it."""
    links = {"current": page, "next": page + 1} | ({"previous": page - 1} if page else {})
    return rows.orderBy(*order).offset(page * limit).limit(limit), links


def public_fields(rows: DataFrame, wanted: list[str], allowed: list[str]) -> DataFrame:
    """The wanted fields that a list may show, in the order of the whitelist."""
    return rows.select(*(c for c in allowed if c in wanted and c in rows.columns))


def extra_media_fields(media: DataFrame, media_tags: DataFrame, tags: DataFrame, partisan_set: int, fake_tag: int) -> DataFrame:
    """``media_id, partisanship, fake_news``: the tag of a set, or the word null; whether a medium is in a collection."""
    partisan = media_tags.join(tags.filter(F.col("tag_sets_id") == partisan_set), "tags_id").groupBy("media_id").agg(F.max("tag").alias("partisanship"))
    fake = media_tags.filter(F.col("tags_id") == fake_tag).select("media_id").distinct().withColumn("fake", F.lit(1))
    return media.select("media_id").join(partisan, "media_id", "left").join(fake, "media_id", "left").select("media_id", F.coalesce("partisanship", F.lit("null")).alias("partisanship"), F.coalesce("fake", F.lit(0)).alias("fake_news"))


def nested_gaps(health: DataFrame, gaps: DataFrame, key: str, week: str) -> DataFrame:
    """Health rows with their coverage gaps nested in order of week."""
    nested = gaps.groupBy(key).agg(F.array_sort(F.collect_list(F.col(week))).alias("coverage_gap_list"))
    return health.join(nested, key, "left")


def alert_recipients(permissions: DataFrame) -> DataFrame:
    """``topic, user``: distinct users with a permission of their own on a topic."""
    return permissions.filter("permission <> 'none'").select("topic", "user").distinct()


def topic_dump(cross_links: DataFrame, stories: DataFrame, media: DataFrame) -> DataFrame:
    """Story links with title and medium of both ends."""
    end = lambda x, key: stories.join(media.select("media_id", "name"), "media_id", "left").select(F.col("stories_id").alias(key), F.col("title").alias(f"{x}_title"), F.col("media_id").alias(f"{x}_media_id"), F.col("name").alias(f"{x}_media_name"))
    return cross_links.join(end("source", "stories_id"), "stories_id").join(end("ref", "ref_stories_id"), "ref_stories_id")


def posts_by_channel(posts: DataFrame, channels: list[str]) -> DataFrame:
    """``stories_id`` and one count column for each channel (or seed query)."""
    return posts.groupBy("stories_id").agg(*(F.count(F.when(F.col("channel") == c, 1)).alias(f"{c}_post_count") for c in channels))


def query_export(found: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Rows of a story search for a file, with link counts where a timespan's are given."""
    rows = found.select("stories_id", "media_id", "title", "url", "publish_date")
    return rows if counts is None else rows.join(counts, "stories_id", "left")
