"""Story search: queries in the boolean language over stories and sentences, counts and facets of what they match."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions import boolean
from tidings.functions.text import TEXT_LIMIT

#: Most stories that a sentence query looks into, most rows of a page.
SENTENCE_STORIES, PAGE = 1_000_000, 1000


def story_fields() -> dict:
    """Field clauses on story columns."""
    number = lambda name: lambda v: F.col(name) == int(v)
    tagged = lambda v: F.coalesce(F.array_contains("media_tags", F.lit(int(v)).cast("long")), F.lit(False))
    return {
        "tags_id_media": tagged,
        "collections_id": tagged,
        "stories_id": number("stories_id"),
        "media_id": number("media_id"),
        "language": lambda v: F.col("language") == v,
        "title": lambda v: F.col("title").rlike(boolean.pattern(boolean.Node("term", (v, False)))),
    }


def with_media_tags(stories: DataFrame, media_tags: DataFrame) -> DataFrame:
    """Stories with ``media_tags``, the tags of their medium, for collection clauses: one row per medium is joined, nothing is collected."""
    tags = media_tags.groupBy("media_id").agg(F.collect_set("tags_id").alias("media_tags"))
    return stories.join(tags, "media_id", "left")


def search(stories: DataFrame, query: str, *filters: Column, exact: bool = False) -> DataFrame:
    """Stories that match a query; ``filters`` may be any Columns, for ranges too.

    ``tags_id_media:`` and ``collections_id:`` clauses ask for stories of ``with_media_tags``. With ``exact``
    plain terms are whole words, and the distance of a near clause counts.
    """
    if re.search(r"(?:tags_id_media|collections_id):\[", query):
        raise boolean.QueryError("a collection clause takes ids, no range")
    out = stories.filter(boolean.predicate(query, "text", story_fields(), exact))
    for f in filters:
        out = out.filter(f)
    return out


def page_after(found: DataFrame, last: int | None, rows: int, key: str = "stories_id") -> DataFrame:
    """Keyset paging: the next rows above the last key."""
    after = found if last is None else found.filter(F.col(key) > last)
    return after.orderBy(key).limit(min(rows, PAGE))


def matching_sentences(found: DataFrame, sentences: DataFrame, query: str) -> DataFrame:
    """Sentences of matching stories in which any positive term of the query occurs."""
    ids = found.select("stories_id").orderBy("stories_id").limit(SENTENCE_STORIES)
    return sentences.join(ids, "stories_id", "left_semi").filter(boolean.any_term(query, "sentence"))


def date_histogram(found: DataFrame, period: str) -> DataFrame:
    return found.filter("publish_date is not null").groupBy(F.date_trunc(period, "publish_date").cast("date").alias("period")).agg(F.countDistinct("stories_id").alias("stories"))


def tag_facet(found: DataFrame, story_tags: DataFrame, tags: DataFrame, limit: int, tag_sets_id: int | None = None) -> DataFrame:
    """Top tags by stories, ties to the smaller id; the limit goes before the filter on the tag set."""
    counts = story_tags.join(found.select("stories_id"), "stories_id", "left_semi").groupBy("tags_id").agg(F.count("*").alias("stories"))
    top = counts.orderBy(F.desc("stories"), "tags_id").limit(limit).join(F.broadcast(tags), "tags_id")
    return top if tag_sets_id is None else top.filter(F.col("tag_sets_id") == tag_sets_id)


def is_relevant(query: str, title: Column, url: Column, text: Column) -> Column:
    """Whether a topic's query matches a story's title, URL, or the first MiB of its text."""
    node = boolean.text_part(query)
    return boolean.matches(node, title) | boolean.matches(node, F.regexp_replace(url, "[^A-Za-z0-9]+", " ")) | boolean.matches(node, F.substr(text, F.lit(1), F.lit(TEXT_LIMIT)))


def search_documents(stories: DataFrame, sentences: DataFrame, story_tags: DataFrame) -> DataFrame:
    """One document per story: its sentences joined in order by a space, its tags, its date cut to the day."""
    joined = sentences.groupBy("stories_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_number", "sentence"))), lambda s: s["sentence"]), " ").alias("text"))
    tags = story_tags.groupBy("stories_id").agg(F.array_join(F.array_sort(F.collect_set("tags_id")).cast("array<string>"), ",").alias("tags"))
    return stories.select("stories_id", "media_id", "language", "title", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_day")).join(joined, "stories_id", "left").join(tags, "stories_id", "left")
