"""Mining of stories and media for a topic: matches by URL, merges into root media, seeds, syndication, rescrapes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions import urls

# Most stories that one URL is matched with, the newest first.
MOST_MATCHES = 100
# Methods of dating that are relied on, the tag of stories without a date, and its tag set.
RELIABLE_METHODS = "guess_by_og_article_published_time guess_by_url guess_by_url_and_date_text merged_story_rss manual".split()
UNDATEABLE, METHOD_SET = "undateable", "date_guess_method"
# Least characters of a sentence that counts as the wire service's, how many are very many, and nearness to the title.
WIRE_SENTENCE, MANY_SENTENCES, NEAR_TITLE = 32, 10, 256


def match_stories(wanted: DataFrame, stories: DataFrame, media: DataFrame) -> DataFrame:
    """``url, stories_id``: stories of usable media that go by the URL, its redirect, or the lossy form of either.

    Of the newest MOST_MATCHES the preferred one is taken: of no duplicate medium, then the lower id. All
    forms are exploded on both sides and meet in one equi-join.
    """
    forms = lambda *c: F.array_distinct(F.array_compact(F.array(*(x for u in c for x in (F.col(u), urls.normalize_url_lossy(F.col(u)))))))
    asked = wanted.select("url", F.explode(forms("url", "redirect_url")).alias("form")).distinct()
    usable = stories.join(media.filter(~F.col("foreign_rss_links")).select("media_id", "dup_media_id"), "media_id")
    known = usable.select("stories_id", "dup_media_id", "publish_date", F.explode(forms("url", "guid")).alias("form"))
    found = asked.join(known, "form").select("url", "stories_id", "dup_media_id", "publish_date").distinct()
    # the newest of a URL are cut before the shuffle too, so a home page sends MOST_MATCHES rows from each task at most
    newest = F.row_number().over(Window.partitionBy("url").orderBy(F.desc_nulls_last("publish_date"), F.desc("stories_id")))
    best = F.min_by("stories_id", F.struct(F.col("dup_media_id").isNotNull(), F.col("stories_id")))
    return found.withColumn("k", newest).filter(F.col("k") <= MOST_MATCHES).groupBy("url").agg(best.alias("stories_id"))


def move_to_root_media(stories: DataFrame, roots: DataFrame) -> DataFrame:
    """``stories_id, root_media_id, target_id`` for stories of duplicate media.

    The target is the story of the root medium with the same URL or guid, or the same title and day; null
    where a copy has to be made. ``roots``: media_id, root.
    """
    moved = stories.join(roots.filter("media_id <> root"), "media_id").withColumnRenamed("root", "root_media_id")
    day = F.to_date("publish_date")
    address = lambda df: df.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array(F.col("url"), F.col("guid"))))))
    titled = lambda df: df.filter("title is not null and publish_date is not null").withColumn("key", F.concat_ws("|", day.cast("string"), F.sha2("title", 256)))
    keys = lambda df, *c: address(df).select(*c, "key").union(titled(df).select(*c, "key"))
    of_root = keys(stories, F.col("media_id").alias("root_media_id"), F.col("stories_id").alias("target")).groupBy("root_media_id", "key").agg(F.min("target").alias("target"))
    found = keys(moved, "stories_id", "root_media_id").join(of_root, ["root_media_id", "key"]).groupBy("stories_id").agg(F.min("target").alias("target_id"))
    return moved.select("stories_id", "root_media_id").join(found, "stories_id", "left")


def copy_to_topic(stories: DataFrame, seeds: DataFrame, source: str) -> DataFrame:
    """Seed rows ``url, stories_id, source`` of another topic's stories whose id and URL are no seeds yet."""
    fresh = stories.join(seeds.filter("stories_id is not null").select("stories_id"), "stories_id", "left_anti")
    return fresh.join(seeds.select("url"), "url", "left_anti").select("url", "stories_id", F.lit(source).alias("source"))


def split_foreign_rss(topic_stories: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topic stories that stay, and seed rows ``url, source`` of those whose medium carries foreign feeds."""
    foreign = media.filter("foreign_rss_links").select("media_id")
    moved = topic_stories.filter(~F.col("valid_foreign_rss_story")).join(foreign, "media_id", "left_semi")
    return topic_stories.join(moved.select("stories_id"), "stories_id", "left_anti"), moved.select("url", F.lit("merge_foreign_rss_stories").alias("source"))


def link_states(links: DataFrame, matches: DataFrame, ignored: Column) -> DataFrame:
    """``url, state`` of found links before any fetch: ignored, skipped (no page), matched, or pending."""
    url = F.col("url")
    rows = links.join(matches.select("url", "stories_id"), "url", "left")
    state = F.when(~urls.is_http_url(url) | ignored, "ignored").when(urls.is_binary_url(url), "skipped").when(F.col("stories_id").isNotNull(), "story match").otherwise("pending")
    return rows.select("url", state.alias("state"))


# States of a URL that is to be fetched for a topic.
PENDING, REQUEUED, TWEET_PENDING = "pending", "requeued", "tweet pending"
IGNORED, SKIPPED, FAILED, NO_MATCH, MATCHED, ADDED = "ignored", "skipped", "request failed", "content match failed", "story match", "story added"


def advance_fetches(todo: DataFrame, failed: DataFrame, self_linked: DataFrame, matches: DataFrame, responses: DataFrame, ignored: Callable[[Column], Column], relevant: Column) -> DataFrame:
    """``url, state, code, stories_id, message``: each row of ``todo`` in the state that what is known of its URL leads to.

    ``todo``: url, state, assume_match; only pending and requeued rows move. In this order decide: the ignore rule,
    a failure of the same URL before (``failed``: url, state, code, message), a domain that links to itself too
    often (``self_linked``: domain), a story found by the URL (``matches``: url, stories_id; requeued rows are not
    matched again before the fetch), a post or user page of a platform that another job fetches, and the response
    (``responses``: url, code, success, response_url, content, message, known_id: the story that the redirect leads
    to or that exists already). A successful one whose content is ``relevant``, or whose row says assume_match,
    adds a story. Without a response a row stays as it is.
    """
    one = lambda df, *c: df.select("url", *c).dropDuplicates(["url"])
    rows = todo.join(one(failed, F.col("state").alias("f_state"), F.col("code").alias("f_code"), F.col("message").alias("f_message")), "url", "left")
    rows = rows.join(matches.groupBy("url").agg(F.min("stories_id").alias("m_id")), "url", "left")
    rows = rows.join(one(responses, F.col("code").alias("r_code"), "success", "response_url", "content", F.col("message").alias("r_message"), "known_id"), "url", "left")
    rows = rows.withColumn("domain", urls.distinctive_domain(F.col("url"))).join(self_linked.select("domain", F.lit(True).alias("self")).distinct(), "domain", "left")
    moved = F.coalesce(F.col("response_url") != F.col("url"), F.lit(False)) & F.coalesce(ignored(F.col("response_url")), F.lit(False))
    platform = F.col("url").rlike(r"(?i)^https?://(?:www\.|mobile\.|m\.)?twitter\.com/(?:[^/?#]+/status(?:es)?/\d+|[^/?#]+/?(?:[?#]|$))")
    result = lambda state, code=None, story=None, message=None: F.struct(F.lit(state).alias("state") if isinstance(state, str) else state.alias("state"), (F.lit(code) if isinstance(code, int | None) else code).cast("int").alias("code"), (F.lit(None) if story is None else story).cast("long").alias("stories_id"), (F.lit(None) if message is None else message).cast("string").alias("message"))
    to = (
        F.when(~F.col("state").isin(PENDING, REQUEUED), result(F.col("state")))
        .when(F.coalesce(ignored(F.col("url")), F.lit(False)), result(IGNORED, 403))
        .when(F.col("f_state").isNotNull(), result(F.col("f_state"), F.col("f_code"), None, F.col("f_message")))
        .when(F.col("self"), result(SKIPPED, 403))
        .when((F.col("state") == PENDING) & F.col("m_id").isNotNull(), result(MATCHED, 200, F.col("m_id")))
        .when(platform, result(TWEET_PENDING))
        .when(F.col("success").isNull(), result(F.col("state")))
        .when(moved, result(IGNORED, 403))
        .when(~F.col("success"), result(FAILED, F.col("r_code"), None, F.col("r_message")))
        .when(F.col("known_id").isNotNull(), result(MATCHED, F.col("r_code"), F.col("known_id")))
        .when(~F.coalesce(relevant, F.lit(False)) & ~F.coalesce("assume_match", F.lit(False)), result(NO_MATCH, F.col("r_code")))
        .otherwise(result(ADDED, F.col("r_code")))
    )
    return rows.select("url", to.alias("to")).select("url", "to.*")


def merge_stories(topic_stories: DataFrame, links: DataFrame, seeds: DataFrame, merges: DataFrame) -> dict[str, DataFrame]:
    """The topic's tables after stories are merged: ``topic_stories``, ``links``, ``seeds`` and ``merged_map``.

    ``merges``: stories_id, target, without cycles; a chain leads to its end. The target takes over the links of
    both directions (each once, none to itself), the seeds, and the least iteration of all that are merged into it,
    and it counts as mined; the merged stories leave the topic. The map names each with its final target.
    """
    from tidings.operators.graph import roots

    nodes = merges.select("stories_id", "target").union(merges.select(F.col("target").alias("stories_id"), F.lit(None).cast("long")))
    ends = roots(nodes.groupBy("stories_id").agg(F.min("target").alias("target")), "stories_id", "target").filter("stories_id <> root")
    ends = ends.select("stories_id", F.col("root").alias("target"))
    named = lambda df, c: df.join(ends.select(F.col("stories_id").alias(c), F.col("target").alias("_t")), c, "left").withColumn(c, F.coalesce("_t", c)).drop("_t")
    merged = ends.select("stories_id", F.lit(True).alias("gone"))
    kept = ends.select(F.col("target").alias("stories_id"), F.lit(True).alias("took")).distinct()
    rows = topic_stories.join(merged, "stories_id", "left").join(kept, "stories_id", "left")
    through = named(rows.select("stories_id", "iteration", "link_mined", "took"), "stories_id")
    stories = through.groupBy("stories_id").agg(F.min("iteration").alias("iteration"), (F.max("link_mined") | (F.count("*") > 1) | F.coalesce(F.max("took"), F.lit(False))).alias("link_mined"))
    moved = named(named(links, "stories_id"), "ref_stories_id").filter("stories_id <> ref_stories_id")
    return {"topic_stories": stories, "links": moved.dropDuplicates(["stories_id", "ref_stories_id"]).select(*links.columns), "seeds": named(seeds, "stories_id").select(*seeds.columns), "merged_map": ends}


def back_fill(found: DataFrame, known: DataFrame, start: str = "2010-01-01", end: str | None = None) -> DataFrame:
    """Stories of an archive that a medium lacks: dated in the range, and no known one by URL, by guid, or by title and day; one of each.

    ``found`` and ``known``: media_id, url, guid, title, publish_date.
    """
    rows = found.filter(F.col("publish_date") >= F.lit(start).cast("timestamp_ntz"))
    rows = rows if end is None else rows.filter(F.col("publish_date") <= F.lit(end).cast("timestamp_ntz"))
    keyed = lambda df: df.withColumn("_form", urls.normalize_url_lossy(F.col("url"))).withColumn("_day", F.to_date("publish_date")).withColumn("_title", F.sha2("title", 256))
    fresh, old = keyed(rows), keyed(known)
    for keys in (["media_id", "_form"], ["media_id", "guid"], ["media_id", "_title", "_day"]):
        fresh = fresh.join(old.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min_by(F.struct(*fresh.columns), "url").alias("s")).select("s.*") if keys[-1] != "guid" else fresh.join(old.select(*keys), keys, "left_anti")
    return fresh.select(*found.columns)


def medium_by_url(wanted: DataFrame, media: DataFrame, spidered: DataFrame) -> DataFrame:
    """``url, media_id``: the medium of the same lossy URL; not spidered first, then no duplicate, then the lower id."""
    lossy = urls.normalize_url_lossy(F.col("url")).alias("form")
    flagged = media.join(spidered.select("media_id").distinct().withColumn("spidered", F.lit(True)), "media_id", "left")
    order = F.struct(F.col("spidered").isNotNull(), F.col("dup_media_id").isNotNull(), F.col("media_id"))
    best = flagged.groupBy(lossy).agg(F.min_by("media_id", order).alias("media_id"))
    return wanted.select("url", lossy).join(best, "form").select("url", "media_id")


def dedup_media(media: DataFrame) -> DataFrame:
    """``media_id, dup_of`` of media that share a domain and a lossy URL: the medium to keep is no duplicate, then the lowest."""
    keyed = media.select("media_id", urls.distinctive_domain(F.col("url")).alias("domain"), urls.normalize_url_lossy(F.col("url")).alias("form"), F.col("dup_media_id").isNotNull().alias("dup"))
    kept = keyed.groupBy("domain", "form").agg(F.min_by("media_id", F.struct("dup", "media_id")).alias("dup_of"))
    return keyed.join(kept, ["domain", "form"]).filter("media_id <> dup_of").select("media_id", "dup_of")


#: Media that share a second-level label at most; one that more have is the name of a host of many, not of a medium.
LABEL_MEDIA = 1000


def merge_candidates(media: DataFrame, most: int = LABEL_MEDIA) -> DataFrame:
    """``media_id, candidate_id``: media whose host or name holds the other's second-level label as a word; an equi-join on words.

    A label of more than ``most`` media says nothing about any two of them and gives no candidates, so there are
    at most ``most`` for each word of a medium.
    """
    label = F.element_at(F.split(urls.distinctive_domain(F.col("url")), "\\."), 1)
    word = F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", F.translate(urls.host(F.col("url")), ".", " "), "name")), r"\s+")))
    own = media.select("media_id", label.alias("label")).filter("label <> ''")
    telling = own.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("label")
    own = own.join(telling, "label", "left_semi")
    return own.join(media.select(F.col("media_id").alias("candidate_id"), word.alias("label")), "label").filter("media_id <> candidate_id").select("media_id", "candidate_id")


def respider_flags(stories: DataFrame, old: tuple[Column, Column], new: tuple[Column, Column]) -> DataFrame:
    """``stories_id``: stories that a changed date range takes in, to be spidered again."""
    inside = lambda r: (F.col("publish_date") >= r[0]) & (F.col("publish_date") < r[1])
    return stories.filter(inside(new) & ~inside(old)).select("stories_id")


def id_chunks(rows: DataFrame, key: str, size: int = 100, block: int = 100_000) -> DataFrame:
    """``key, block, chunk``: distinct ids in chunks of at most ``size``, dealt within blocks of the id range, so no task numbers them all."""
    ids = rows.select(key).distinct().withColumn("block", F.floor(F.col(key) / block))
    place = F.row_number().over(Window.partitionBy("block").orderBy(key)) - 1
    return ids.withColumn("chunk", F.floor(place / size))


def story_text(title: Column, description: Column, extracted: Column) -> Column:
    """The extracted text, or title and description where these are longer."""
    short = F.concat_ws("\n", title, description)
    return F.when(F.length(F.coalesce(extracted, F.lit(""))) > F.length(short), extracted).otherwise(short)


def wire_sentences(sentences: DataFrame, wire: DataFrame) -> DataFrame:
    """``stories_id, dup_sentences``: long sentences of a story that the wire service's medium holds too."""
    known = wire.filter(F.length("sentence") >= WIRE_SENTENCE).select(F.md5("sentence").alias("h")).distinct()
    own = sentences.filter(F.length("sentence") >= WIRE_SENTENCE).select("stories_id", F.md5("sentence").alias("h"))
    return own.join(known, "h", "left_semi").groupBy("stories_id").agg(F.count("*").alias("dup_sentences"))


def _near(text: Column, title: Column, mark: str) -> Column:
    """Whether the mark begins within NEAR_TITLE characters of an occurrence of the title."""
    flat, title = F.regexp_replace(F.lower(text), r"\s+", " "), F.lower(title)
    window = lambda at: F.substr(flat, F.greatest(at - NEAR_TITLE + 1, F.lit(1)), F.least(at, F.lit(NEAR_TITLE)) + NEAR_TITLE - 1 + len(mark))
    pieces = F.split(flat, F.concat(F.lit(r"\Q"), title, F.lit(r"\E")))
    ends = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda n, p: n + F.length(p)) + (k - 1) * F.length(title) + 1)
    return (title != "") & (F.size(pieces) > 1) & F.exists(F.when(F.size(pieces) > 1, ends), lambda at: F.contains(window(at), F.lit(mark)))


def is_syndicated(text: Column, title: Column, language: Column, dup_sentences: Column) -> Column:
    """The decision tree for wire stories, in English or of unknown language only.

    A bracketed mark decides. With the service's name: a quoted one decides, else one to ten shared
    sentences, else nearness to the title; without these, none or many shared sentences ask for its news
    mark or for no tag. Without the name: a place before the mark for few shared sentences, many decide.
    """
    name = "associated press"
    has = lambda p: text.rlike(p)
    few, many = dup_sentences.between(1, MANY_SENTENCES), dup_sentences > MANY_SENTENCES
    named = F.when(has(rf"""(?i)["'|].{{0,8}}{name}.{{0,8}}["'|]""") | few | _near(text, title, name), True).when(many, ~has(f"(?i)<[^<>]*{name}[^<>]*>")).otherwise(has("(?i)ap news"))
    tree = F.when(has(r"(?i)\(ap\)"), True).when(has(f"(?i){name}"), named).when(few, has(r"[A-Z]+\s*\(AP\)")).otherwise(many)
    english = F.coalesce(language, F.lit("")).isin("en", "")
    return F.coalesce(english & (F.coalesce(text, F.lit("")) != "") & tree, F.lit(False))


def reliable_dates(stories: DataFrame, date_tags: DataFrame) -> DataFrame:
    """``stories_id, date_is_reliable``: a method that is relied on, or undateable without any method. ``date_tags``: stories_id, tag, tag_set."""
    seen = date_tags.groupBy("stories_id").agg(
        F.max(F.col("tag").isin(*RELIABLE_METHODS)).alias("method"), F.max(F.col("tag") == UNDATEABLE).alias("none"), F.max(F.col("tag_set") == METHOD_SET).alias("guessed")
    )
    rows = stories.select("stories_id").join(seen, "stories_id", "left")
    flag = F.col("method") | (F.col("none") & ~F.col("guessed"))
    return rows.select("stories_id", F.coalesce(flag, F.lit(False)).alias("date_is_reliable"))


def due_for_rescrape(rescraping: DataFrame, spidered: DataFrame, feeds: DataFrame, now: Column) -> DataFrame:
    """``media_id`` not disabled, never rescraped or over a year less two days ago, and not (spidered without an active feed)."""
    due = rescraping.filter(~F.col("disable") & (F.col("last_rescrape_time").isNull() | (F.col("last_rescrape_time") < now - F.expr("interval 363 days"))))
    idle = spidered.select("media_id").join(feeds.filter("active").select("media_id"), "media_id", "left_anti")
    return due.join(idle, "media_id", "left_anti").select("media_id")


def colours(values: DataFrame, column: str, stored: DataFrame, palette: list[str]) -> DataFrame:
    """``value, colour``: the stored one, else one of the palette by the value's hash; grey for null."""
    own = values.select(F.col(column).alias("value")).distinct().join(stored.select(F.col("value").alias("v"), F.col("colour").alias("known")), F.expr("value <=> v"), "left")
    pick = reduce(lambda c, k: c.when(F.pmod(F.crc32(F.col("value").cast("string")), F.lit(len(palette))) == k, palette[k]), range(1, len(palette)), F.when(F.lit(False), ""))
    return own.select("value", F.when(F.col("value").isNull(), "999999").otherwise(F.coalesce("known", pick, F.lit(palette[0]))).alias("colour"))
