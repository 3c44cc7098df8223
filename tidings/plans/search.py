"""Search, counts, facets and projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidings.functions import boolean
from tidings.functions.dates import in_period, solr_dates
from tidings.operators import search as S
from tidings.plans.registry import entity_query as query


def _hit(*words: str) -> list[str]:
    return [f"regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_]){w}')" for w in words]


THE, OF, IN, WITH = _hit("the", "of", "in", "with")


@query("search_bool_count", f"SELECT media_id, language, count(*) AS stories FROM stories WHERE {THE} AND ({OF} OR {IN}) GROUP BY 1, 2")
def _(e):
    return S.search(e.stories, "the and ( of or in )").groupBy("media_id", "language").agg(F.count("*").alias("stories"))


@query("search_adjacent_or", f"SELECT stories_id FROM stories WHERE {_hit('idiot')[0]} OR {_hit('moron')[0]}")
def _(e):
    return S.search(e.stories, "idiot moron").select("stories_id")


@query("search_plus", f"SELECT stories_id FROM stories WHERE ({THE} AND {WITH}) OR {_hit('clown')[0]}")
def _(e):
    return S.search(e.stories, "the +with clown").select("stories_id")


@query("search_phrase", f"SELECT stories_id FROM stories WHERE {_hit('of\\s+the')[0]}")
def _(e):
    return S.search(e.stories, '"of the"').select("stories_id")


@query("search_near", f"SELECT stories_id FROM stories WHERE {_hit('from')[0]} AND {WITH}")
def _(e):
    return S.search(e.stories, '"from with"~5').select("stories_id")


@query("search_not", f"SELECT stories_id FROM stories WHERE {THE} AND NOT ({OF} AND {_hit('was')[0]})")
def _(e):
    return S.search(e.stories, "the -( of and was )").select("stories_id")


@query("search_wildcard", f"SELECT language, count(*) AS stories FROM stories WHERE {_hit('licen')[0]} GROUP BY 1")
def _(e):
    return S.search(e.stories, "licen*").groupBy("language").agg(F.count("*").alias("stories"))


@query("search_field_lang", f"SELECT stories_id, media_id FROM stories WHERE language = 'en' AND media_id IN (1, 2, 3) AND {_hit('was')[0]}")
def _(e):
    return S.search(e.stories, "language:en and media_id:( 1 2 3 ) and was").select("stories_id", "media_id")


@query("search_field_title", "SELECT stories_id FROM stories WHERE regexp_matches(title, '(?i)(?:^|[^\\p{L}\\p{N}_])the')")
def _(e):
    return S.search(e.stories, "title:the").select("stories_id")


@query("search_collection", f"SELECT stories_id, media_id FROM stories WHERE media_id IN (SELECT media_id FROM media_tags WHERE tags_id IN (100, 201)) AND {OF}")
def _(e):
    return S.search(S.with_media_tags(e.stories, e.media_tags), "tags_id_media:( 100 or 201 ) and of").select("stories_id", "media_id")


@query("search_range_filter", f"SELECT stories_id, publish_date FROM stories WHERE {OF} AND publish_date >= TIMESTAMP '2024-02-01' AND publish_date <= TIMESTAMP '2024-03-01' - INTERVAL 1 SECOND")
def _(e):
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-02-01", "2024-03-01"))
    return S.search(e.stories, "of", in_period(F.col("publish_date"), start, end)).select("stories_id", "publish_date")


@query("search_keyset_page", f"SELECT stories_id FROM stories WHERE {OF} AND stories_id > 100 ORDER BY 1 LIMIT 50")
def _(e):
    return S.page_after(S.search(e.stories, "of").select("stories_id"), 100, 50)


@query("search_id_shortcut", "SELECT stories_id FROM stories WHERE stories_id IN (3, 5, 8) AND stories_id IN (5, 8, 13)")
def _(e):
    return S.search(e.stories, "stories_id:( 3 5 8 ) and stories_id:( 5 8 13 )").select("stories_id")


@query("search_media_facet", f"SELECT media_id, count(*) AS stories FROM stories WHERE {OF} GROUP BY 1")
def _(e):
    return S.search(e.stories, "of").groupBy("media_id").agg(F.count("*").alias("stories"))


@query("search_exact_count", f"SELECT count(DISTINCT stories_id) AS stories FROM stories WHERE {OF}")
def _(e):
    return S.search(e.stories, "of").agg(F.countDistinct("stories_id").alias("stories"))


@query("search_approx_count")
def _(e):
    return S.search(e.stories, "of").groupBy("language").agg(F.approx_count_distinct("stories_id").alias("stories"))


@query("search_seed_months", f"SELECT CAST(date_trunc('month', publish_date) AS DATE) AS month, count(*) AS stories FROM stories WHERE {OF} AND media_id IN (1, 2, 3, 4) AND publish_date >= TIMESTAMP '2024-01-01' AND publish_date < TIMESTAMP '2024-04-01' GROUP BY 1")
def _(e):
    months = e.spark.range(1).select(F.explode(F.expr("sequence(date'2024-01-01', date'2024-03-01', interval 1 month)")).alias("month"))
    found = S.search(e.stories, "of and media_id:( 1 2 3 4 )").withColumn("month", F.trunc("publish_date", "month"))
    return found.join(F.broadcast(months), "month", "left_semi").groupBy("month").agg(F.count("*").alias("stories"))


@query("sentences_matching", f"SELECT s.stories_id, s.sentence_number FROM sentences s JOIN stories t USING (stories_id) WHERE {' AND '.join(x.replace('text', 't.text') for x in _hit('clown', 'the'))} AND regexp_matches(s.sentence, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:clown|the)')")
def _(e):
    return S.matching_sentences(S.search(e.stories, "clown and the"), e.sentences, "clown and the").select("stories_id", "sentence_number")


@query("topic_relevance", f"SELECT stories_id FROM stories WHERE {_hit('scum')[0]} OR {_hit('scum')[0].replace('text', 'title')} OR {_hit('src12')[0]} OR regexp_matches(regexp_replace(url, '[^A-Za-z0-9]+', ' ', 'g'), '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:scum|src12)') OR {_hit('src12')[0].replace('text', 'title')}")
def _(e):
    return e.stories.filter(S.is_relevant("scum src12", F.col("title"), F.col("url"), F.col("text"))).select("stories_id")


@query("media_name_phrase", "SELECT media_id, name FROM media WHERE lower(name) = 'src1' OR regexp_matches(name, '(?i)(?:^|[^\\p{L}\\p{N}_])src1') ORDER BY name = 'src1' DESC, media_id LIMIT 3")
def _(e):
    return e.media.filter(boolean.predicate('"src1"', "name")).orderBy(F.desc(F.col("name") == "src1"), "media_id").limit(3).select("media_id", "name")


@query("tag_word_search", "SELECT tags_id, tag FROM tags WHERE tag ILIKE '%quality%' AND tag ILIKE '%high%'")
def _(e):
    return e.tags.filter(boolean.predicate("quality and high", "tag")).select("tags_id", "tag")


@query("substring_search", "SELECT media_id FROM media WHERE name ILIKE '%RC1%'")
def _(e):
    return e.media.filter(F.ilike("name", F.lit("%RC1%"))).select("media_id")


@query("in_list_filter", "SELECT stories_id, tags_id FROM story_tags WHERE tags_id IN (2, 4) AND stories_id IN (SELECT stories_id FROM stories WHERE media_id IN (1, 5, 9))")
def _(e):
    return e.story_tags.filter(F.col("tags_id").isin(2, 4)).join(e.stories.filter(F.col("media_id").isin(1, 5, 9)), "stories_id", "left_semi")


for _period in ("day", "week", "month", "year"):
    query(f"date_histogram_{_period}", f"SELECT CAST(date_trunc('{_period}', publish_date) AS DATE) AS period, count(DISTINCT stories_id) AS stories FROM stories WHERE publish_date IS NOT NULL AND {OF} GROUP BY 1")(
        lambda e, p=_period: S.date_histogram(S.search(e.stories, "of"), p)
    )


@query("tag_facet_top", f"SELECT t.tags_id, stories, tag_sets_id, tag FROM (SELECT tags_id, count(*) AS stories FROM story_tags WHERE stories_id IN (SELECT stories_id FROM stories WHERE {OF}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) t JOIN tags g ON g.tags_id = t.tags_id WHERE tag_sets_id = 2")
def _(e):
    return S.tag_facet(S.search(e.stories, "of"), e.story_tags, e.tags, 3, 2)


@query("search_documents", "SELECT s.stories_id, s.media_id, s.language, s.title, strftime(s.publish_date, '%Y-%m-%d') AS publish_day, d.text, t.tags FROM stories s LEFT JOIN (SELECT stories_id, string_agg(sentence, ' ' ORDER BY sentence_number) AS text FROM sentences GROUP BY 1) d USING (stories_id) LEFT JOIN (SELECT stories_id, string_agg(CAST(tags_id AS VARCHAR), ',' ORDER BY tags_id) AS tags FROM (SELECT DISTINCT * FROM story_tags) GROUP BY 1) t USING (stories_id)")
def _(e):
    return S.search_documents(e.stories, e.sentences, e.story_tags)


@query("search_dates", "SELECT stories_id, strftime(publish_date, '%Y-%m-%dT%H:%M:00Z') AS publish_minute, strftime(publish_date, '%Y-%m-%dT00:00:00Z') AS publish_day, strftime(date_trunc('week', publish_date), '%Y-%m-%dT00:00:00Z') AS publish_week, strftime(publish_date, '%Y-%m-01T00:00:00Z') AS publish_month, strftime(publish_date, '%Y-01-01T00:00:00Z') AS publish_year FROM stories")
def _(e):
    return e.stories.select("stories_id", *(c.alias(n) for n, c in solr_dates(F.col("publish_date")).items()))


def _story_list(e, stories):
    flagged = e.story_tags.filter("tags_id = 4").select("stories_id", F.lit(True).alias("flag"))
    rows = stories.join(e.media.select("media_id", F.col("name").alias("media_name"), F.col("url").alias("media_url")), "media_id")
    return rows.join(flagged, "stories_id", "left").select("stories_id", "title", "media_name", "media_url", F.coalesce("flag", F.lit(False)).alias("flagged"))


@query("story_list", "SELECT s.stories_id, s.title, m.name AS media_name, m.url AS media_url, coalesce(t.tags_id = 4, false) AS flagged FROM stories s JOIN media m USING (media_id) LEFT JOIN story_tags t ON t.stories_id = s.stories_id AND t.tags_id = 4 WHERE s.stories_id < 200")
def _(e):
    return _story_list(e, e.stories.filter("stories_id < 200"))


@query("story_list_all", "SELECT s.stories_id, s.title, m.name AS media_name, m.url AS media_url, coalesce(t.tags_id = 4, false) AS flagged FROM stories s JOIN media m USING (media_id) LEFT JOIN story_tags t ON t.stories_id = s.stories_id AND t.tags_id = 4")
def _(e):
    return _story_list(e, e.stories)


@query("ordered_id_list", "SELECT s.stories_id, position, s.title FROM (VALUES (9, 0), (4, 1), (7, 2)) v(stories_id, position) JOIN stories s USING (stories_id)")
def _(e):
    ids = e.spark.createDataFrame([([9, 4, 7],)], "ids array<long>").select(F.posexplode("ids").alias("position", "stories_id"))
    return e.stories.join(F.broadcast(ids), "stories_id").select("stories_id", "position", "title")


@query("attach_children", "SELECT m.media_id, coalesce(string_agg(CAST(feeds_id AS VARCHAR) || '/' || type, ';' ORDER BY feeds_id), '') AS feeds FROM media m LEFT JOIN feeds f ON f.media_id = m.media_id AND f.active GROUP BY 1")
def _(e):
    children = e.feeds.filter("active").groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("feeds_id", "type"))).alias("children"))
    shown = F.array_join(F.transform("children", lambda c: F.concat_ws("/", c["feeds_id"].cast("string"), c["type"])), ";")
    return e.media.join(children, "media_id", "left").select("media_id", F.coalesce(shown, F.lit("")).alias("feeds"))


@query("story_text", "SELECT s.stories_id, CASE WHEN full_text_rss THEN title ELSE t END AS text FROM stories s LEFT JOIN (SELECT stories_id, string_agg(sentence, '.' || chr(10) || chr(10) ORDER BY sentence_number) AS t FROM sentences GROUP BY 1) USING (stories_id)")
def _(e):
    joined = e.sentences.groupBy("stories_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_number", "sentence"))), lambda s: s["sentence"]), ".\n\n").alias("t"))
    return e.stories.join(joined, "stories_id", "left").select("stories_id", F.when(F.col("full_text_rss"), F.col("title")).otherwise(F.col("t")).alias("text"))


@query("distinct_on_first", "SELECT stories_id, sentence_number, sentence FROM (SELECT *, row_number() OVER (PARTITION BY stories_id ORDER BY sentence_number) AS k FROM sentences) WHERE k = 1")
def _(e):
    first = e.sentences.groupBy("stories_id").agg(F.min_by(F.struct("sentence_number", "sentence"), "sentence_number").alias("s"))
    return first.select("stories_id", "s.sentence_number", "s.sentence")


@query("offset_page", "SELECT stories_id, media_id FROM stories ORDER BY media_id, stories_id LIMIT 20 OFFSET 40")
def _(e):
    return e.stories.orderBy("media_id", "stories_id").offset(40).limit(20).select("stories_id", "media_id")


@query("undateable_mask", "SELECT stories_id, CASE WHEN EXISTS (SELECT 1 FROM story_tags t WHERE t.stories_id = s.stories_id AND tags_id = 4) THEN 'undateable' ELSE strftime(publish_date, '%Y-%m-%d') END AS publish_date FROM stories s")
def _(e):
    tagged = e.story_tags.filter("tags_id = 4").select("stories_id", F.lit(1).alias("t")).distinct()
    return e.stories.join(tagged, "stories_id", "left").select("stories_id", F.when(F.col("t").isNull(), F.date_format("publish_date", "yyyy-MM-dd")).otherwise("undateable").alias("publish_date"))


@query("json_projection", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def _(e):
    return e.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("pivot_counts", "SELECT user_id, count(*) FILTER (event_type = 'view') AS view_count, count(*) FILTER (event_type = 'click') AS click_count, count(*) FILTER (event_type = 'purchase') AS purchase_count FROM events GROUP BY 1")
def _(e):
    wide = e.table("events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.count(F.lit(1)))
    return wide.select("user_id", *(F.coalesce(F.col(c), F.lit(0)).alias(f"{c}_count") for c in ("view", "click", "purchase")))


@query("media_type", "SELECT m.media_id, coalesce(nullif(t.tag, 'Not Typed'), u.tag, 'Not Typed') AS media_type FROM media m LEFT JOIN (SELECT media_id, tag FROM media_tags JOIN tags USING (tags_id) WHERE tag_sets_id = 10) t USING (media_id) LEFT JOIN (SELECT media_id, tag FROM media_tags JOIN tags USING (tags_id) WHERE tag_sets_id = 20) u USING (media_id)")
def _(e):
    named = lambda s, c: e.media_tags.join(F.broadcast(e.tags.filter(F.col("tag_sets_id") == s)), "tags_id").select("media_id", F.col("tag").alias(c))
    rows = e.media.join(named(10, "own"), "media_id", "left").join(named(20, "other"), "media_id", "left")
    return rows.select("media_id", F.coalesce(F.nullif("own", F.lit("Not Typed")), "other", F.lit("Not Typed")).alias("media_type"))


@query("ignore_conflict_insert", "SELECT stories_id, tags_id FROM (SELECT * FROM story_tags UNION SELECT stories_id, 4 FROM stories WHERE media_id = 1)")
def _(e):
    from tidings.operators.tables import insert_ignore

    return insert_ignore(e.story_tags.distinct(), e.stories.filter("media_id = 1").select("stories_id", F.lit(4).cast("long").alias("tags_id")), ["stories_id", "tags_id"])


@query("first_story_per_language", "SELECT language, min(stories_id) AS stories_id FROM stories GROUP BY 1")
def _(e):
    w = Window.partitionBy("language").orderBy("stories_id")
    return e.stories.withColumn("k", F.row_number().over(w)).filter("k = 1").select("language", "stories_id")


# The stories as they are after the changes: every fifth begins anew, every seventh is deleted.
CHANGED = ", now AS (SELECT stories_id, CASE WHEN stories_id % 5 = 0 THEN 'Licence notes, with the new text: ' || text ELSE text END AS text FROM stories WHERE stories_id % 7 <> 0), tokens AS (SELECT stories_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM now)"


def _changed_index(e):
    """An index of the stories in a first batch, updates in a second, deletions in a third."""
    from tidings.operators.index import SearchIndex

    index = SearchIndex(e.spark, fan=3)
    rows = e.stories.select("stories_id", "text")
    index.add(rows, 0)
    index.add(rows.filter("stories_id % 5 = 0").withColumn("text", F.concat(F.lit("Licence notes, with the new text: "), "text")), 1)
    index.add(rows.filter("stories_id % 7 = 0").withColumn("deleted", F.lit(True)), 2)
    return index


@query("index_search_words", CHANGED + " SELECT stories_id FROM tokens WHERE (list_contains(w, 'licence') OR len(list_filter(w, lambda x: starts_with(x, 'und'))) > 0) AND NOT list_contains(w, 'that')")
def _(e):
    return _changed_index(e).search("(licence or und*) and not that")


@query("index_search_phrase", CHANGED + " SELECT stories_id FROM now WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])with\\s+the($|[^\\p{L}\\p{N}_])')")
def _(e):
    return _changed_index(e).search('"with the"')


@query("index_search_near", CHANGED + ", places AS (SELECT stories_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM tokens) SELECT DISTINCT a.stories_id FROM places a JOIN places b ON a.stories_id = b.stories_id AND abs(a.i - b.i) <= 6 WHERE a.w = 'from' AND b.w = 'with'")
def _(e):
    return _changed_index(e).search('"from with"~5')
