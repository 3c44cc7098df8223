"""Text, words, titles, URLs and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.functions import dates, text, urls
from tidings.functions.stems import stem_table
from tidings.operators import languages as L
from tidings.operators import segments as S
from tidings.operators import words as W
from tidings.operators.sentences import learn_abbreviations, split_sentences
from tidings.plans.registry import entity_query as query

CLEAN = "regexp_replace(substr(sentence, 1, 1024), 'https?://\\S+', ' ', 'g')"
WORD = "[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_''’-]*[\\p{L}\\p{N}_])?"
STOP = "(w IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS["en"]) + ")" + "".join(f" OR (language = '{lang}' AND w IN ({', '.join(repr(w) for w in own)}))" for lang, own in text.STOP_WORDS.items() if lang != "en") + ")"
GOOD = f", s AS (SELECT DISTINCT sentence, language FROM sentences), tokens AS (SELECT sentence, language, unnest(regexp_extract_all(lower({CLEAN}), '{WORD}')) AS w FROM s), good AS (SELECT * FROM tokens WHERE NOT regexp_matches(w, '^[0-9]+$') AND NOT {STOP}) SELECT w AS stem, w AS term, CAST(sum(least(c, 3)) AS BIGINT) AS count FROM (SELECT sentence, w, count(*) AS c FROM good GROUP BY 1, 2) GROUP BY 1"


@query("word_count_capped", GOOD)
def _(e):
    return W.word_counts(e.sentences, chars=W.SENTENCE_CHARS)


@query("word_list_top", GOOD + " ORDER BY 3 DESC, 1 DESC LIMIT 500")
def _(e):
    return W.word_list(e.sentences, chars=W.SENTENCE_CHARS)


@query("word_list_sampled_bigrams")
def _(e):
    return W.word_list(e.sentences, sample=1000, n=2, stemmed=True)


@query("word_list_stemmed")
def _(e):
    return W.word_list(e.sentences, stemmed=True)


@query("word_stems")
def _(e):
    return stem_table(L.distinct_words(e.stories))


@query("unspaced_words")
def _(e):
    """Titles written without spaces, cut by the words of the stories."""
    known = S.known_words(L.distinct_words(e.stories), 50_000)
    bare = F.regexp_replace(F.lower("title"), r"[^\p{L}]", "")
    return S.segmented(e.stories.select("stories_id", bare.alias("run")), known, "run", r"\p{L}").select("stories_id", F.array_join("words", " ").alias("words"))


@query("word_matrix", f", tokens AS (SELECT stories_id, language, unnest(regexp_extract_all(lower(substr(sentence, 1, 1024)), '{WORD}')) AS w FROM sentences WHERE stories_id IN (SELECT stories_id FROM stories WHERE media_id = 3)), good AS (SELECT * FROM tokens WHERE NOT regexp_matches(w, '^[0-9]+$') AND NOT {STOP}) SELECT stories_id, w AS stem, count(*) AS count FROM good GROUP BY 1, 2")
def _(e):
    return W.word_matrix(e.sentences.filter("media_id = 3"))


@query("word_matrix_all", f", tokens AS (SELECT stories_id, language, unnest(regexp_extract_all(lower(substr(sentence, 1, 1024)), '{WORD}')) AS w FROM sentences), good AS (SELECT * FROM tokens WHERE NOT regexp_matches(w, '^[0-9]+$') AND NOT {STOP}) SELECT stories_id, w AS stem, count(*) AS count FROM good GROUP BY 1, 2")
def _(e):
    return W.word_matrix(e.sentences)


@query("dedup_sentence_week", "SELECT stories_id, sentence_number, count(*) OVER g > 1 AS is_dup, row_number() OVER (g ORDER BY stories_id, sentence_number) = 1 AS kept FROM sentences WINDOW g AS (PARTITION BY media_id, date_trunc('week', publish_date), sentence)")
def _(e):
    return W.dedup_sentences_by_week(e.sentences)


@query("unique_sentences", "SELECT stories_id, sentence, min(sentence_number) AS sentence_number FROM sentences GROUP BY 1, 2")
def _(e):
    return e.sentences.groupBy("stories_id", "sentence").agg(F.min("sentence_number").alias("sentence_number"))


@query("clean_sentences", "SELECT stories_id, sentence_number FROM sentences WHERE NOT (regexp_matches(sentence, '(?:[\\[\\]{}<>]\\s*){5,}') OR (length(sentence) <= 5 AND regexp_matches(sentence, '^[\\x00-\\x7f]*$')))")
def _(e):
    return e.sentences.filter(~text.junk_sentence(F.col("sentence"))).select("stories_id", "sentence_number")


@query("language_counts", "SELECT language, count(*) AS stories FROM stories GROUP BY 1")
def _(e):
    return e.stories.groupBy("language").agg(F.count("*").alias("stories"))


@query("identify_language")
def _(e):
    profiles = L.learn(e.stories)
    return L.identify(e.stories.select("stories_id", "language", "text"), profiles).drop("text")


@query("guess_language")
def _(e):
    return e.stories.select("stories_id", "language", text.guess_language(F.col("text")).alias("guess"))


# Java's look-around marks the same places as a break put between the two groups: an end mark never begins a sentence.
SPLIT = "regexp_split_to_array(regexp_replace(regexp_replace(substr(text, 1, 1048576), '[ \\t\\r\\f]+', ' ', 'g'), '([.!?])\\s+([\\p{Lu}\\p{N}])', '\\1' || chr(10) || '\\2', 'g'), '\\n+')"


@query("sentence_split", f", parts AS (SELECT stories_id, list_filter(list_transform({SPLIT}, lambda x: trim(x)), lambda x: NOT regexp_matches(x, '(?:[\\[\\]{{}}<>]\\s*){{5,}}') AND NOT (length(x) <= 5 AND regexp_matches(x, '^[\\x00-\\x7f]*$')) AND regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS p FROM stories) SELECT stories_id, generate_subscripts(p, 1) - 1 AS sentence_number, unnest(p) AS sentence FROM parts")
def _(e):
    return e.stories.select("stories_id", F.posexplode(text.sentences(F.col("text"))).alias("sentence_number", "sentence"))


@query("sentence_split_learnt")
def _(e):
    found = split_sentences(e.stories.select("stories_id", "text", "language"), learn_abbreviations(e.stories))
    # the inner generator would get a filter that splits each text once more
    return found.select("stories_id", F.posexplode_outer("sentences").alias("sentence_number", "sentence")).filter("sentence_number is not null")


TITLE = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({}, '<[^<]*>', '', 'g'), '&#?[a-z0-9]*', '', 'gi')), '(?:- )|[:|]', 'SEPSEP', 'g'), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g')"


@query("title_normalize", f", t AS (SELECT stories_id, substr({TITLE.format('title')}, 1, 1023) AS p, name FROM stories JOIN media USING (media_id)), x AS (SELECT *, (SELECT q FROM (SELECT unnest(regexp_split_to_array(p, ' *SEPSEP *')) AS q, generate_subscripts(regexp_split_to_array(p, ' *SEPSEP *'), 1) AS i) ORDER BY length(q) DESC, i LIMIT 1) AS longest FROM t) SELECT stories_id, CASE WHEN longest = p OR length(longest) < 32 OR name = longest THEN p ELSE longest END AS title, md5(CASE WHEN longest = p OR length(longest) < 32 OR name = longest THEN p ELSE longest END) AS hash FROM x")
def _(e):
    rows = e.stories.join(e.media.select("media_id", "name"), "media_id")
    return rows.select("stories_id", text.normalized_title(F.col("title"), F.col("name")).alias("title"), text.title_hash(F.col("title"), F.col("name")).alias("hash"))


@query("half_md5", "SELECT stories_id, substr(md5(title), 1, 16) AS h FROM stories")
def _(e):
    return e.stories.select("stories_id", text.half_md5(F.col("title")).alias("h"))


@query("feed_checksum", "SELECT media_id, md5(string_agg(url, '|' ORDER BY stories_id)) AS checksum FROM stories GROUP BY 1")
def _(e):
    return e.stories.groupBy("media_id").agg(text.feed_checksum(F.transform(F.array_sort(F.collect_list(F.struct("stories_id", "url"))), lambda s: s["url"])).alias("checksum"))


GONE = "|".join(f"<{t}\\b[^>]*>.*?</{t}>" for t in ("script", "style", "title", "noscript", "head")) + "|<!--.*?-->"
BLOCKS = "</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|blockquote|section|article|hr)\\b[^>]*>"
STRIPPED = f"regexp_replace(regexp_replace(regexp_replace(html, '{GONE}', ' ', 'gis'), '{BLOCKS}', chr(10) || chr(10), 'gi'), '<[^>]*>', ' ', 'gs')"
for _entity, _char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'"), ("­", "''"), ("&shy;", "''")):
    STRIPPED = f"replace({STRIPPED}, '{_entity}', {_char})"
STRIPPED = f"regexp_replace(regexp_replace(regexp_replace({STRIPPED}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
METAS = ", ".join(f"nullif(regexp_extract(html, '<meta[^>]*(?:property|name)=[\"'']{m}[\"''][^>]*content=[\"'']([^\"'']*)[\"'']', 1, 'is'), '')" for m in ("og:title", "twitter:title", "dc.title"))
PAGE_TITLE = f"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({METAS}, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'), '^\\s*home(?:page)?\\s*[-:|]\\s*', '', 'i'))"


@query("html_title_strip", f"SELECT page_id, {PAGE_TITLE} AS title, length({STRIPPED}) AS chars, nullif(regexp_extract(html, '<link[^>]*rel=[\"'']canonical[\"''][^>]*href=[\"'']([^\"'']+)[\"'']', 1, 'is'), '') AS canonical, nullif(trim(regexp_extract(html, '<meta[^>]*http-equiv=[\"'']refresh[\"''][^>]*content=[\"''][^\"'']*url=([^\"'']+)[\"'']', 1, 'is')), '') AS refresh FROM pages")
def _(e):
    return e.table("pages").select("page_id", text.html_title(F.col("html")).alias("title"), F.length(text.html_strip(F.col("html"))).alias("chars"), text.canonical_link(F.col("html")).alias("canonical"), text.meta_refresh(F.col("html")).alias("refresh"))


@query("page_links", "SELECT DISTINCT page_id, CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h ELSE h END AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)(?:href|src)=[\"''](https?://[^\"''\\s>]+|/[^\"''\\s>/][^\"''\\s>]*)[\"'']', 1)) AS h FROM pages)")
def _(e):
    return e.table("pages").select("page_id", F.explode(text.page_links(F.col("html"), F.col("url"))).alias("link"))


@query("self_link_domains", "SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, sum(len(regexp_extract_all(html, '(?i)href=[\"'']/[^\"''\\s>/]'))) AS self_links FROM pages GROUP BY 1 HAVING sum(len(regexp_extract_all(html, '(?i)href=[\"'']/[^\"''\\s>/]'))) > 5")
def _(e):
    rows = e.table("pages").select(urls.host(F.col("url")).alias("host"), F.size(F.regexp_extract_all("html", F.lit("(?i)href=[\"']/[^\"'\\s>/]"), F.lit(0))).alias("n"))
    return rows.groupBy("host").agg(F.sum("n").alias("self_links")).filter("self_links > 5")


@query("url_host", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages")
def _(e):
    return e.table("pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query("url_distinctive_domain", "SELECT page_id, CASE WHEN len(p) >= 2 THEN p[-2] || '.' || p[-1] ELSE p[1] END AS domain FROM (SELECT page_id, string_split(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '.') AS p FROM pages)")
def _(e):
    return e.table("pages").select("page_id", urls.distinctive_domain(F.col("url")).alias("domain"))


@query("url_strip_tracking", "SELECT * FROM (VALUES (1, 'http://example.com/a?id=3'), (2, 'https://www.nytimes.com/x?page=2'), (3, 'http://a.com/'), (4, 'http://b.org/p?q=1')) v(id, normalized)")
def _(e):
    rows = [(1, "HTTP://Example.com:80/a?utm_source=x&id=3&_r=1#top"), (2, "https://www.nytimes.com/x?smid=tw&page=2"), (3, "http://a.com/?sort=new&ref=1"), (4, "http://b.org/p?q=1&ga_x=2&ncid=9")]
    return e.spark.createDataFrame(rows, "id int, url string").select("id", urls.normalize_url(F.col("url")).alias("normalized"))


@query("url_lossy_groups", "SELECT media_id, count(DISTINCT 'http://' || 'src' || media_id || '.example.com/news/' || stories_id) AS urls FROM stories GROUP BY 1")
def _(e):
    return e.stories.groupBy("media_id").agg(F.countDistinct(urls.normalize_url_lossy(F.col("url"))).alias("urls"))


@query("url_flags")
def _(e):
    u = F.col("url")
    return e.table("pages").select("page_id", urls.is_http_url(u).alias("http"), urls.is_homepage_url(u).alias("home"), urls.is_shortened_url(u).alias("short"), urls.is_binary_url(u).alias("binary"), urls.path(u).alias("path"), F.size(urls.url_variants(u)).alias("variants"))


@query("domain_groups", "SELECT 'example.com' AS domain, count(*) AS media FROM media HAVING count(*) > 1")
def _(e):
    return e.media.groupBy(urls.distinctive_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("media")).filter("media > 1")


@query("week_and_month_start", "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def _(e):
    return e.table("orders").select("o_orderkey", dates.week_start(F.col("o_orderdate")).alias("week"), dates.month_start(F.col("o_orderdate")).alias("month"))


@query("date_in_url", "SELECT id, CAST(d AS DATE) AS day FROM (VALUES (1, '2024-03-05'), (2, NULL), (3, '2019-12-31')) v(id, d)")
def _(e):
    rows = [(1, "http://x.com/2024/03/05/a"), (2, "http://x.com/2024/13/05/a"), (3, "http://x.com/news/20191231/")]
    return e.spark.createDataFrame(rows, "id int, url string").select("id", dates.date_in_url(F.col("url")).alias("day"))


@query("rounding_ratios", "SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice, 2) AS DECIMAL(18, 2)) AS price, greatest(l_quantity, 10.0) AS quantity FROM lineitem")
def _(e):
    return e.table("lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice"), 2).cast("decimal(18,2)").alias("price"), F.greatest("l_quantity", F.lit(10.0)).alias("quantity"))
