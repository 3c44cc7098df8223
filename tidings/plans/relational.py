"""Joins, aggregates, windows, order and set operations over the star schema and the entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidings.operators import tables
from tidings.operators.storage import materialize_sorted
from tidings.plans.registry import entity_query as query


@query("join_inner_star", "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(e):
    nations = F.broadcast(e.table("nation").join(F.broadcast(e.table("region")), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", "n_name", "r_name"))
    rows = e.table("orders").select("o_custkey", "o_totalprice").join(e.table("customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
    return rows.join(nations, F.expr("c_nationkey = n_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("join_left_coalesce", "SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(e):
    counts = e.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return e.table("customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("join_left_or_filter", "SELECT DISTINCT s.stories_id FROM topic_stories s LEFT JOIN topic_links l ON l.ref_stories_id = s.stories_id LEFT JOIN topic_stories p ON p.stories_id = l.stories_id WHERE s.publish_date < TIMESTAMP '1993-01-01' OR p.publish_date < TIMESTAMP '1993-01-01'")
def _(e):
    from tidings.operators.topics import period_stories

    return period_stories(e.topic_stories, e.topic_links, F.lit("1900-01-01").cast("timestamp_ntz"), F.lit("1993-01-01 00:00:01").cast("timestamp_ntz"))


@query("join_semi_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def _(e):
    return e.table("supplier").join(e.table("lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi").select("s_suppkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(e):
    return e.table("customer").join(e.table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("join_parenthesised", "SELECT m.media_id, t.tag FROM media m LEFT JOIN (media_tags x JOIN tags t ON t.tags_id = x.tags_id AND t.tag_sets_id = 20) ON x.media_id = m.media_id")
def _(e):
    inner = e.media_tags.join(F.broadcast(e.tags.filter("tag_sets_id = 20")), "tags_id").select("media_id", "tag")
    return e.media.select("media_id").join(inner, "media_id", "left")


@query("join_self_cotag", "SELECT b.media_id, count(*) AS shared FROM media_tags a JOIN media_tags b USING (tags_id) WHERE a.media_id = 1 AND b.media_id <> 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def _(e):
    own = e.media_tags.filter("media_id = 1").select("tags_id")
    return e.media_tags.filter("media_id <> 1").join(own, "tags_id").groupBy("media_id").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "media_id").limit(100)


@query("join_band_cosharing", "SELECT a.stories_id AS a_id, b.stories_id AS b_id, min(abs(epoch(a.publish_date) - epoch(b.publish_date))) AS seconds FROM posts a JOIN posts b ON a.author = b.author AND a.stories_id > b.stories_id AND abs(epoch(a.publish_date) - epoch(b.publish_date)) <= 3600 GROUP BY 1, 2")
def _(e):
    from tidings.operators.topics import close_shares

    return close_shares(e.posts, 3600)


@query("join_duplicates", "SELECT language, media_id, title, min(stories_id) AS first_id, count(*) AS n FROM stories WHERE length(title) > 20 GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(e):
    return e.stories.filter("length(title) > 20").groupBy("language", "media_id", "title").agg(F.min("stories_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


@query("join_theta", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 10 DAY")
def _(e):
    return e.table("lineitem").join(e.table("orders"), F.expr("l_orderkey = o_orderkey and l_shipdate between o_orderdate and o_orderdate + interval 10 days")).select("l_orderkey", "l_linenumber")


@query("join_cross_weeks", "SELECT medium, CAST(w AS DATE) AS week FROM (SELECT DISTINCT medium FROM daily), (SELECT unnest(generate_series(date_trunc('week', min(stat_date)), max(stat_date), INTERVAL 7 DAY)) AS w FROM daily)")
def _(e):
    from tidings.operators.health import media_weeks

    return media_weeks(e.daily)


@query("join_scalar_total", "SELECT media_id, round(count(*) * 1.0 / (SELECT count(*) FROM stories), 6) AS share FROM stories GROUP BY 1")
def _(e):
    total = F.broadcast(e.stories.agg(F.count("*").alias("total")))
    return e.stories.groupBy("media_id").agg(F.count("*").alias("n")).crossJoin(total).select("media_id", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("join_multi_hop", "SELECT p.post_id, s.stories_id, m.name FROM posts p JOIN stories s ON s.stories_id = p.stories_id JOIN media m ON m.media_id = s.media_id JOIN feeds f ON f.media_id = m.media_id AND f.type = 'web_page' WHERE p.channel = 'click'")
def _(e):
    rows = e.posts.filter("channel = 'click'").join(e.stories.select("stories_id", "media_id"), "stories_id")
    return rows.join(e.media, "media_id").join(F.broadcast(e.feeds.filter("type = 'web_page'").select("media_id")), "media_id").select("post_id", "stories_id", "name")


@query("cross_media_links", "SELECT DISTINCT l.stories_id, l.ref_stories_id FROM topic_links l JOIN topic_stories a ON a.stories_id = l.stories_id JOIN topic_stories b ON b.stories_id = l.ref_stories_id WHERE a.media_id <> b.media_id")
def _(e):
    from tidings.operators.topics import cross_media_links

    return cross_media_links(e.topic_links, e.topic_stories)


@query("join_hash_text", "SELECT a.stories_id AS a_id, count(*) AS shared FROM (SELECT DISTINCT stories_id, sentence FROM sentences WHERE length(sentence) > 32) a JOIN (SELECT DISTINCT sentence FROM sentences WHERE media_id = 1 AND length(sentence) > 32) b USING (sentence) GROUP BY 1")
def _(e):
    long = e.sentences.filter("length(sentence) > 32")
    wire = long.filter("media_id = 1").select(F.xxhash64("sentence").alias("h"), "sentence").distinct()
    own = long.select("stories_id", F.xxhash64("sentence").alias("h"), "sentence").distinct()
    return own.join(wire, ["h", "sentence"], "left_semi").groupBy(F.col("stories_id").alias("a_id")).agg(F.count("*").alias("shared"))


@query("recursive_dup_root", "SELECT media_id, CASE media_id % 4 WHEN 3 THEN media_id - 2 WHEN 2 THEN media_id - 1 ELSE media_id END AS root FROM media")
def _(e):
    from tidings.operators.graph import roots

    return roots(e.media, "media_id", "dup_media_id")


@query("update_from_join", "SELECT p.post_id, coalesce(m.media_id, p.stories_id) AS target FROM posts p LEFT JOIN media m ON m.media_id = p.stories_id")
def _(e):
    return e.posts.join(e.media.select(F.col("media_id").alias("stories_id"), "media_id"), "stories_id", "left").select("post_id", F.coalesce("media_id", "stories_id").alias("target"))


@query("fallback_lookup", "SELECT s.stories_id, coalesce(a.media_id, b.media_id) AS media_id FROM (SELECT stories_id, CASE WHEN stories_id % 2 = 0 THEN url ELSE 'x' END AS u, 'SRC' || media_id AS n FROM stories) s LEFT JOIN media a ON s.u LIKE a.url || '%' LEFT JOIN media b ON b.name = lower(s.n)")
def _(e):
    from tidings.functions.urls import medium_url

    keyed = e.stories.select("stories_id", medium_url(F.when(F.col("stories_id") % 2 == 0, F.col("url")).otherwise("x")).alias("u"), F.lower(F.concat(F.lit("SRC"), F.col("media_id").cast("string"))).alias("n"))
    by_url = e.media.select(F.col("url").alias("u"), F.col("media_id").alias("a"))
    by_name = e.media.select(F.col("name").alias("n"), F.col("media_id").alias("b"))
    return keyed.join(by_url, "u", "left").join(by_name, "n", "left").select("stories_id", F.coalesce("a", "b").alias("media_id"))


@query("agg_group_count", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(e):
    return e.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("agg_count_distinct", "SELECT channel, count(DISTINCT author) AS authors, count(DISTINCT stories_id) AS stories FROM posts GROUP BY 1")
def _(e):
    return e.posts.groupBy("channel").agg(F.countDistinct("author").alias("authors"), F.countDistinct("stories_id").alias("stories"))


@query("agg_having", "SELECT author, count(*) AS posts FROM posts GROUP BY 1 HAVING count(*) >= 70")
def _(e):
    return e.posts.groupBy("author").agg(F.count("*").alias("posts")).filter("posts >= 70")


@query("agg_string_agg", "SELECT media_id, string_agg(CAST(feeds_id AS VARCHAR), '|' ORDER BY feeds_id DESC) AS feeds FROM feeds GROUP BY 1")
def _(e):
    e.feeds.createOrReplaceTempView("tidings_feeds")
    return e.spark.sql("select media_id, listagg(cast(feeds_id as string), '|') within group (order by feeds_id desc) as feeds from tidings_feeds group by media_id")


@query("agg_collect_set", "SELECT media_id, string_agg(l, ',' ORDER BY l) AS languages FROM (SELECT DISTINCT media_id, language AS l FROM stories) GROUP BY 1")
def _(e):
    return e.stories.groupBy("media_id").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


@query("agg_bool_and", "SELECT media_id, bool_and(active) AS all_active, bool_or(active) AS any_active FROM feeds GROUP BY 1")
def _(e):
    return e.feeds.groupBy("media_id").agg(F.bool_and("active").alias("all_active"), F.bool_or("active").alias("any_active"))


@query("agg_argmax", "SELECT media_id, arg_max(stories_id, (n, -stories_id)) AS stories_id FROM (SELECT media_id, stories_id, count(*) AS n FROM sentences GROUP BY 1, 2) GROUP BY 1")
def _(e):
    counts = e.sentences.groupBy("media_id", "stories_id").agg(F.count("*").alias("n"))
    return counts.groupBy("media_id").agg(F.max_by("stories_id", F.struct("n", -F.col("stories_id"))).alias("stories_id"))


@query("agg_majority_share", "SELECT m AS media_id, coalesce(max(language) FILTER (n * 2 > total), 'none') AS primary_language FROM (SELECT media_id AS m, language, count(*) AS n, sum(count(*)) OVER (PARTITION BY media_id) AS total FROM stories GROUP BY 1, 2) GROUP BY 1")
def _(e):
    from tidings.operators.health import primary_language

    return primary_language(e.stories)


@query("agg_majority_tag", "SELECT media_id, tags_id FROM (SELECT media_id, tags_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY media_id) AS total FROM story_tags JOIN stories USING (stories_id) WHERE tags_id IN (3, 4) GROUP BY 1, 2) WHERE n * 2 > total")
def _(e):
    rows = e.story_tags.filter("tags_id in (3, 4)").join(e.stories.select("stories_id", "media_id"), "stories_id").groupBy("media_id", "tags_id").agg(F.count("*").alias("n"))
    return rows.withColumn("total", F.sum("n").over(Window.partitionBy("media_id"))).filter("n * 2 > total").select("media_id", "tags_id")


@query("agg_boolean_key", "SELECT o_orderstatus = 'F' AS finished, count(*) AS n FROM orders GROUP BY 1")
def _(e):
    return e.table("orders").groupBy((F.col("o_orderstatus") == "F").alias("finished")).agg(F.count("*").alias("n"))


@query("agg_min_max", "SELECT medium, min(stat_date) AS first_day, max(stat_date) AS last_day FROM daily GROUP BY 1")
def _(e):
    return e.daily.groupBy("medium").agg(F.min("stat_date").alias("first_day"), F.max("stat_date").alias("last_day"))


@query("agg_average_of_top", "SELECT medium, round(avg(num_stories), 2) AS expected FROM (SELECT *, row_number() OVER (PARTITION BY medium ORDER BY num_stories DESC, stat_date) AS k FROM daily) WHERE k <= 20 GROUP BY 1")
def _(e):
    w = Window.partitionBy("medium").orderBy(F.desc("num_stories"), "stat_date")
    return e.daily.withColumn("k", F.row_number().over(w)).filter("k <= 20").groupBy("medium").agg(F.round(F.avg("num_stories"), 2).alias("expected"))


@query("agg_sparse_average", "SELECT medium, round(sum(num_stories) / 90.0, 2) AS per_day FROM daily GROUP BY 1")
def _(e):
    return e.daily.groupBy("medium").agg(F.round(F.sum("num_stories") / F.lit(90.0), 2).alias("per_day"))


@query("agg_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS deviation FROM lineitem")
def _(e):
    return e.table("lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.avg("l_quantity"), 4).alias("mean"), F.round(F.stddev_pop("l_quantity"), 4).alias("deviation"))


@query("agg_duplicate_sentences", "SELECT stories_id, CASE WHEN n = 0 THEN 0 WHEN n <= 10 THEN 1 ELSE 2 END AS level FROM (SELECT s.stories_id, count(w.sentence) AS n FROM stories s LEFT JOIN (SELECT DISTINCT stories_id, sentence FROM sentences WHERE length(sentence) >= 32) x USING (stories_id) LEFT JOIN (SELECT DISTINCT sentence FROM sentences WHERE media_id = 2 AND length(sentence) >= 32) w ON w.sentence = x.sentence GROUP BY 1)")
def _(e):
    long = e.sentences.filter("length(sentence) >= 32").select("stories_id", "media_id", "sentence")
    shared = long.select("stories_id", "sentence").distinct().join(long.filter("media_id = 2").select("sentence").distinct(), "sentence", "left_semi").groupBy("stories_id").agg(F.count("*").alias("n"))
    return e.stories.select("stories_id").join(shared, "stories_id", "left").select("stories_id", F.when(F.col("n").isNull(), 0).when(F.col("n") <= 10, 1).otherwise(2).alias("level"))


@query("agg_usage_sums", "SELECT author, count(*) AS requests, sum(stories_id) AS items FROM posts WHERE publish_date >= (SELECT max(publish_date) FROM posts) - INTERVAL 7 DAY GROUP BY 1")
def _(e):
    last = F.broadcast(e.posts.agg((F.max("publish_date") - F.expr("interval 7 days")).alias("since")))
    return e.posts.crossJoin(last).filter("publish_date >= since").groupBy("author").agg(F.count("*").alias("requests"), F.sum("stories_id").alias("items"))


@query("agg_user_summary", "SELECT author, count(*) AS requests FROM posts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def _(e):
    return e.posts.groupBy("author").agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), "author").limit(25)


@query("agg_system_stats", "SELECT (SELECT count(*) FROM stories WHERE publish_date >= TIMESTAMP '2024-04-01') AS daily_stories, (SELECT count(*) FROM feeds WHERE active) AS active_feeds, (SELECT count(DISTINCT media_id) FROM feeds WHERE active) AS active_media")
def _(e):
    stories = e.stories.filter(F.col("publish_date") >= F.lit("2024-04-01").cast("timestamp_ntz")).agg(F.count("*").alias("daily_stories"))
    return stories.crossJoin(F.broadcast(e.feeds.filter("active").agg(F.count("*").alias("active_feeds"), F.countDistinct("media_id").alias("active_media"))))


@query("agg_job_groups", "SELECT channel, count(*) AS jobs, min(publish_date) AS first_date, max(publish_date) AS last_date FROM (SELECT *, rank() OVER (PARTITION BY channel, author ORDER BY publish_date DESC) AS k FROM posts) WHERE k = 1 GROUP BY 1")
def _(e):
    w = Window.partitionBy("channel", "author").orderBy(F.desc("publish_date"))
    latest = e.posts.withColumn("k", F.rank().over(w)).filter("k = 1")
    return latest.groupBy("channel").agg(F.count("*").alias("jobs"), F.min("publish_date").alias("first_date"), F.max("publish_date").alias("last_date"))


@query("win_row_number_host", "SELECT media_id, stories_id FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY language, stories_id DESC) AS k FROM stories) WHERE k = 1")
def _(e):
    from tidings.operators.topics import one_per_host

    return one_per_host(e.stories, "media_id", [F.col("language"), F.desc_nulls_last("stories_id")]).select("media_id", "stories_id")


@query("win_rank_latest", "SELECT author, post_id FROM (SELECT *, rank() OVER (PARTITION BY author ORDER BY publish_date DESC) AS k FROM posts) WHERE k = 1")
def _(e):
    w = Window.partitionBy("author").orderBy(F.desc("publish_date"))
    return e.posts.withColumn("k", F.rank().over(w)).filter("k = 1").select("author", "post_id")


@query("win_count_author_filter", "SELECT post_id FROM (SELECT *, count(*) OVER (PARTITION BY author, channel) AS a, count(*) OVER (PARTITION BY channel) AS c FROM posts) WHERE a < greatest(14, 0.01 * c)")
def _(e):
    from tidings.operators.topics import drop_prolific

    return drop_prolific(e.posts, "channel", least=14).select("post_id")


@query("win_top_links", "SELECT stories_id, ref_stories_id FROM (SELECT *, row_number() OVER (PARTITION BY stories_id ORDER BY n DESC, ref_stories_id) AS k FROM topic_links JOIN (SELECT ref_stories_id, count(*) AS n FROM topic_links GROUP BY 1) USING (ref_stories_id)) WHERE k <= 2")
def _(e):
    inlinks = e.topic_links.groupBy("ref_stories_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stories_id").orderBy(F.desc("n"), "ref_stories_id")
    return e.topic_links.join(inlinks, "ref_stories_id").withColumn("k", F.row_number().over(w)).filter("k <= 2").select("stories_id", "ref_stories_id")


@query("top_stories_nulls_last", "SELECT stories_id, md5(CAST(stories_id AS VARCHAR)) AS tie FROM topic_stories ORDER BY publish_date DESC NULLS LAST, tie DESC LIMIT 50")
def _(e):
    return e.topic_stories.select("stories_id", F.md5(F.col("stories_id").cast("string")).alias("tie"), "publish_date").orderBy(F.desc_nulls_last("publish_date"), F.desc("tie")).limit(50).select("stories_id", "tie")


@query("top_media_md5_tie", "SELECT media_id, count(*) AS n FROM topic_stories GROUP BY 1 ORDER BY 2 DESC NULLS LAST, md5(CAST(media_id AS VARCHAR)) LIMIT 10")
def _(e):
    return e.topic_stories.groupBy("media_id").agg(F.count("*").alias("n")).orderBy(F.desc_nulls_last("n"), F.md5(F.col("media_id").cast("string"))).limit(10)


@query("top_ten_percent_cut", "WITH m AS (SELECT ref_stories_id AS stories_id, count(DISTINCT s.media_id) AS media_inlinks, count(*) AS inlinks FROM topic_links l JOIN topic_stories s ON s.stories_id = l.stories_id GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY media_inlinks DESC, stories_id) AS k, ceil(count(*) OVER () * 0.1) AS n FROM m) SELECT stories_id FROM r WHERE k <= n AND inlinks > (SELECT inlinks FROM r WHERE k = n + 1) - 1".replace("WITH m AS", ", m AS"))
def _(e):
    from tidings.operators.topics import top_tenth

    counts = e.topic_links.join(e.topic_stories.select("stories_id", "media_id"), "stories_id").groupBy(F.col("ref_stories_id").alias("stories_id")).agg(F.countDistinct("media_id").alias("media_inlinks"), F.count("*").alias("inlinks"))
    return top_tenth(counts)


@query("random_order_sample")
def _(e):
    return e.sentences.select("stories_id", "sentence_number").orderBy(F.rand(7)).limit(100)


@query("bernoulli_sample")
def _(e):
    return e.stories.select("stories_id").filter(F.rand(7) * 100 < 22)


@query("boolean_sort_keys", "SELECT media_id, dup_media_id FROM media ORDER BY dup_media_id IS NOT NULL DESC, foreign_rss_links DESC, media_id LIMIT 8")
def _(e):
    return e.media.orderBy(F.desc(F.col("dup_media_id").isNotNull()), F.desc("foreign_rss_links"), "media_id").limit(8).select("media_id", "dup_media_id")


@query("scalar_subquery_sort", "SELECT m.media_id, (SELECT count(*) FROM stories s WHERE s.media_id = m.media_id AND publish_date > TIMESTAMP '2024-02-01') AS recent FROM media m ORDER BY 2 DESC, 1 LIMIT 10")
def _(e):
    recent = e.stories.filter(F.col("publish_date") > F.lit("2024-02-01").cast("timestamp_ntz")).groupBy("media_id").agg(F.count("*").alias("n"))
    return e.media.select("media_id").join(recent, "media_id", "left").select("media_id", F.coalesce("n", F.lit(0)).alias("recent")).orderBy(F.desc("recent"), "media_id").limit(10)


@query("set_union", "SELECT stories_id FROM topic_links UNION SELECT ref_stories_id FROM topic_links")
def _(e):
    return e.topic_links.select("stories_id").union(e.topic_links.select("ref_stories_id")).distinct()


@query("set_union_all", "SELECT 'source' AS side, count(*) AS n FROM topic_links UNION ALL SELECT 'target', count(DISTINCT ref_stories_id) FROM topic_links")
def _(e):
    return e.topic_links.agg(F.count("*").alias("n")).select(F.lit("source").alias("side"), "n").unionByName(e.topic_links.agg(F.countDistinct("ref_stories_id").alias("n")).select(F.lit("target").alias("side"), "n"))


@query("set_except", "SELECT stories_id FROM topic_stories EXCEPT SELECT ref_stories_id FROM topic_links")
def _(e):
    return e.topic_stories.select("stories_id").subtract(e.topic_links.select("ref_stories_id"))


@query("set_intersect", "SELECT stories_id FROM topic_links INTERSECT SELECT ref_stories_id FROM topic_links")
def _(e):
    return e.topic_links.select("stories_id").intersect(e.topic_links.select("ref_stories_id"))


@query("set_diff_report", "SELECT feeds_id, CASE WHEN feeds_id % 7 = 0 THEN 'deleted' WHEN feeds_id % 5 = 0 THEN 'modified' END AS change FROM feeds WHERE feeds_id % 7 = 0 OR feeds_id % 5 = 0 UNION ALL SELECT feeds_id + 100000, 'added' FROM feeds WHERE feeds_id % 11 = 0")
def _(e):
    new = e.feeds.filter("feeds_id % 7 <> 0").withColumn("active", F.when(F.col("feeds_id") % 5 == 0, ~F.col("active")).otherwise(F.col("active")))
    return tables.diff(e.feeds, new.union(e.feeds.filter("feeds_id % 11 = 0").withColumn("feeds_id", F.col("feeds_id") + 100000)), "feeds_id", ["media_id", "type", "active"])


@query("upsert_add", "SELECT medium, stat_date, CAST(num_stories * CASE WHEN dayofmonth(stat_date) = 3 THEN 2 ELSE 1 END AS BIGINT) AS num_stories FROM daily")
def _(e):
    rows = e.daily.select("medium", "stat_date", "num_stories")
    return tables.upsert_add(rows, rows.filter("day(stat_date) = 3"), ["medium", "stat_date"], ["num_stories"])


@query("referential_check", "SELECT DISTINCT stories_id FROM posts WHERE stories_id NOT IN (SELECT media_id FROM media)")
def _(e):
    return tables.missing_keys(e.posts, "stories_id", e.media, "media_id")


@query("join_co_located", "SELECT s.media_id, count(*) AS links FROM topic_links JOIN topic_stories s USING (stories_id) GROUP BY 1")
def _(e):
    links = materialize_sorted(e.topic_links, "links", ["stories_id"])
    stories = materialize_sorted(e.topic_stories.select("stories_id", "media_id"), "stories", ["stories_id"])
    return links.join(stories.hint("merge"), "stories_id").groupBy("media_id").agg(F.count("*").alias("links"))
