"""Timespans of a topic in all its foci at once: overall, weeks, months and custom dates, with the counts of media in each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.operators import spanbits as B
from tidings.operators.storage import materialize
from tidings.operators.topics import cross_media_links

#: Focus of a timespan that has none.
NO_FOCUS = 0


def with_foci(stories: DataFrame, foci: DataFrame) -> DataFrame:
    """``focus, stories_id, publish_date``: each story without a focus, and once in each focus that has it (``focus, stories_id``)."""
    plain = stories.select(F.lit(NO_FOCUS).alias("focus"), "stories_id", "publish_date")
    return plain.unionByName(foci.select(F.col("focus").cast("int").alias("focus"), "stories_id").distinct().join(stories.select("stories_id", "publish_date"), "stories_id").select("focus", "stories_id", "publish_date"))


def dated_in(rows: DataFrame, custom: DataFrame) -> DataFrame:
    """``rows`` once for each timespan that their date lies in, as ``period, start_date``: the week, the month, overall and custom dates.

    ``custom``: start_date, end_date (not included). Custom dates are dealt into their days, so they meet stories
    in an equi-join by day, however they overlap. Rows without a date are in the overall timespan only.
    """
    day = F.to_date("publish_date")
    own = F.array(
        F.struct(F.lit("overall").alias("period"), F.lit(None).cast("date").alias("start_date")),
        F.struct(F.lit("weekly").alias("period"), F.date_trunc("week", "publish_date").cast("date").alias("start_date")),
        F.struct(F.lit("monthly").alias("period"), F.date_trunc("month", "publish_date").cast("date").alias("start_date")),
    )
    plain = rows.select("*", F.inline(own)).filter("period = 'overall' or start_date is not null")
    days = custom.filter("start_date < end_date").distinct().select("start_date", F.explode(F.sequence("start_date", F.date_sub("end_date", 1))).alias("_day")).distinct()
    named = rows.withColumn("_day", day).join(days, "_day").withColumn("period", F.lit("custom")).select(*rows.columns, "period", "start_date")
    return plain.unionByName(named)


def _member_words(stories: DataFrame, links: DataFrame, foci: DataFrame, custom: DataFrame, parts: int | None) -> DataFrame:
    """``stories_id, focus, kind, word, bits``: the timespans that have a story, as bits of words; see ``timespan_members``."""
    each = with_foci(stories, foci)
    dated = dated_in(each, custom).withColumn("kind", B.kind_of(F.col("period"))).withColumn("number", B.number_of(F.col("kind"), F.col("start_date")))
    dated = dated.select("stories_id", "focus", "kind", *B.words("number"))
    linked = (links.repartition(parts, "stories_id") if parts else links).join(dated, "stories_id").select(F.col("ref_stories_id").alias("stories_id"), "focus", "kind", "word", "bits")
    linked = linked.repartition(parts, "stories_id") if parts else linked  # a task has all links to its stories, and so few groups
    once = lambda df: df.groupBy("stories_id", "focus", "kind", "word").agg(F.bit_or("bits").alias("bits"))
    linked = once(linked).join(each.select("focus", "stories_id").distinct(), ["focus", "stories_id"], "left_semi").select(*dated.columns)
    return materialize(once(dated.union(linked)), "members")


def _named(df: DataFrame, *columns: str) -> DataFrame:
    """``focus, period, start_date`` and the columns."""
    return df.select("focus", B.period_of(F.col("kind")).alias("period"), B.start_of(F.col("kind"), F.col("number")).alias("start_date"), *columns)


def timespan_members(stories: DataFrame, links: DataFrame, foci: DataFrame, custom: DataFrame, parts: int | None = None) -> DataFrame:
    """``focus, period, start_date, stories_id``: stories of each timespan: those dated in it, and those of its focus that one of these links to.

    ``links`` may repeat; they are dealt to ``parts`` tasks by the story that they lead to, where it is given.
    """
    members = _member_words(stories, links, foci, custom, parts)
    own = members.select("*", *(B.has("bits", k).alias(f"in_{k}") for k in range(B.WIDTH)))
    return _named(B.by_number(own, ["focus", "kind", "stories_id"], ["in"]), "stories_id")


def timespan_story_counts(stories: DataFrame, links: DataFrame, foci: DataFrame, custom: DataFrame, parts: int | None = None) -> DataFrame:
    """``focus, period, start_date, stories``: how many stories each timespan has."""
    members = _member_words(stories, links, foci, custom, parts)
    counts = members.groupBy("focus", "kind", "word").agg(*B.bit_counts("stories"))
    return _named(B.by_number(counts, ["focus", "kind"], ["stories"]), "stories")


def timespan_media(stories: DataFrame, links: DataFrame, foci: DataFrame, custom: DataFrame, parts: int | None = None) -> DataFrame:
    """``focus, period, start_date, media_id, story_count, inlink_count, outlink_count, media_inlink_count`` of each timespan's media.

    Links count where both stories are in the timespan and of different media.
    """
    members = _member_words(stories, links, foci, custom, parts).join(stories.select("stories_id", "media_id"), "stories_id")
    keys = ["focus", "kind", "word"]
    a = members.withColumnRenamed("media_id", "from_media")
    b = members.select(F.col("stories_id").alias("ref_stories_id"), *keys, F.col("bits").alias("other"), F.col("media_id").alias("to_media"))
    inside = cross_media_links(links, stories, parts).join(a, "stories_id").join(b, ["ref_stories_id", *keys]).withColumn("bits", F.col("bits").bitwiseAND(F.col("other"))).filter("bits <> 0")
    pairs = materialize(inside.groupBy(*keys, "from_media", "to_media").agg(*B.bit_counts("n")), "pairs")
    total = lambda name: [F.sum(f"n_{k}").alias(f"{name}_{k}") for k in range(B.WIDTH)]
    media = [F.sum((F.col(f"n_{k}") > 0).cast("long")).alias(f"media_inlink_count_{k}") for k in range(B.WIDTH)]
    of = ["focus", "kind", "media_id"]
    coming = B.by_number(pairs.groupBy(*keys, F.col("to_media").alias("media_id")).agg(*total("inlink_count"), *media), of, ["inlink_count", "media_inlink_count"])
    going = B.by_number(pairs.groupBy(*keys, F.col("from_media").alias("media_id")).agg(*total("outlink_count")), of, ["outlink_count"])
    counts = B.by_number(members.groupBy(*keys, "media_id").agg(*B.bit_counts("story_count")), of, ["story_count"])
    out = counts.join(coming, [*of, "number"], "left").join(going, [*of, "number"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _named(out, "media_id", "story_count", zero("inlink_count"), zero("outlink_count"), zero("media_inlink_count"))
