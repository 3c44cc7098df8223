"""Confidence models of a topic's snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators import models as M
from tidings.operators import topics as T
from tidings.operators.storage import materialize
from tidings.plans.registry import entity_query as query
from tidings.plans.topics import CROSS

PERIOD = ("1995-01-01", "1995-07-01")


def _roll(what: str) -> str:
    return f"(CAST('0x' || substr(md5(stories_id || '|' || run || '|{what}'), 1, 8) AS BIGINT) / 4294967296.0)"


TWEAKED = f", {CROSS}, rated AS (SELECT *, stories_id % 3 <> 0 AS guessed, stories_id % 10 = 0 AS undateable FROM topic_stories), tried AS (SELECT CAST(run AS BIGINT) AS run, * FROM rated, range(1, 11) r(run)), shifts AS (SELECT *, CASE WHEN {_roll('past')} < 0.5 THEN -1 ELSE 1 END * CASE WHEN {_roll('how')} < 0.25 THEN CASE WHEN {_roll('days')} < 0.5 THEN 2 ELSE 3 END ELSE 8 + floor({_roll('days')} * 53) END AS days FROM tried), tweaked AS (SELECT run, stories_id, media_id, CASE WHEN guessed AND NOT undateable AND {_roll('moved')} < 0.22 THEN publish_date + to_days(CAST(days AS INTEGER)) ELSE publish_date END AS publish_date, (undateable AND {_roll('dateable')} >= 0.3) OR (guessed AND {_roll('undated')} < 0.13) AS undateable FROM shifts)"


def _counts_sql(name: str, source: str) -> str:
    return f", {name}_own AS (SELECT run, stories_id FROM {source} WHERE NOT undateable AND publish_date >= TIMESTAMP '{PERIOD[0]}' AND publish_date < TIMESTAMP '{PERIOD[1]}'), {name}_in AS (SELECT run, stories_id, media_id FROM (SELECT * FROM {name}_own UNION SELECT run, ref_stories_id FROM cross_links JOIN {name}_own USING (stories_id)) JOIN {source} USING (run, stories_id)), {name} AS (SELECT i.run, i.media_id, coalesce(m, 0) AS media_inlink_count, coalesce(n, 0) AS inlink_count FROM (SELECT DISTINCT run, media_id FROM {name}_in) i LEFT JOIN (SELECT a.run, b.media_id, count(DISTINCT a.media_id) AS m, count(*) AS n FROM cross_links c JOIN {name}_in a ON a.stories_id = c.stories_id JOIN {name}_in b ON b.stories_id = c.ref_stories_id AND b.run = a.run GROUP BY 1, 2) x ON x.run = i.run AND x.media_id = i.media_id)"


def _top_sql(name: str, counts: str, factor: int) -> str:
    return f", {name}_k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY media_inlink_count DESC, media_id) AS k, count(*) OVER (PARTITION BY run) AS total FROM {counts}), {name} AS (SELECT a.run, a.media_id, row_number() OVER (PARTITION BY a.run ORDER BY a.k) - 1 AS place FROM {name}_k a JOIN {name}_k b ON b.run = a.run AND b.k = least(CAST(ceil(b.total * 0.1) AS BIGINT) * {factor} + 1, b.total) WHERE a.k < b.k AND a.inlink_count > b.inlink_count + 1)"


COUNTED = TWEAKED + _counts_sql("counted", "tweaked")
TOPS = COUNTED + ", plain AS (SELECT CAST(0 AS BIGINT) AS run, * FROM rated)" + _counts_sql("clean_counts", "plain") + _top_sql("clean", "clean_counts", 1) + _top_sql("models", "counted", 2)


def _stories(e):
    return e.topic_stories.withColumn("guessed", F.col("stories_id") % 3 != 0).withColumn("undateable", F.col("stories_id") % 10 == 0)


def _counts(e, stories):
    start, end = (F.lit(d).cast("timestamp_ntz") for d in PERIOD)
    links = materialize(T.cross_media_links(e.topic_links, e.topic_stories), "links")  # read twice by each count
    return M.media_counts(stories, links, start, end)


@query("model_dates", TWEAKED + " SELECT run, stories_id, publish_date, undateable FROM tweaked")
def _(e):
    return M.tweaked_dates(_stories(e)).select("run", "stories_id", "publish_date", "undateable")


@query("model_media_counts", COUNTED + " SELECT * FROM counted")
def _(e):
    return _counts(e, M.tweaked_dates(_stories(e)))


@query("model_top_media", TOPS + " SELECT * FROM models")
def _(e):
    return M.top_media(_counts(e, M.tweaked_dates(_stories(e))), 2)


@query("model_correlation", TOPS + ", pairs AS (SELECT r.run, c.place AS x, coalesce(m.place, s.n + 1, 1) AS y FROM clean c CROSS JOIN range(1, 11) r(run) LEFT JOIN models m ON m.run = r.run AND m.media_id = c.media_id LEFT JOIN (SELECT run, count(*) AS n FROM models GROUP BY 1) s ON s.run = r.run), each_run AS (SELECT run, count(*) AS media, corr(x, y) AS r FROM pairs GROUP BY 1) SELECT coalesce(max(media), 0) AS num_media, avg(r * r) FILTER (NOT isnan(r)) AS r2_mean, stddev_pop(r * r) FILTER (NOT isnan(r)) AS r2_stddev FROM each_run")
def _(e):
    plain = _stories(e).withColumn("run", F.lit(0).cast("long"))
    counts = materialize(_counts(e, plain.unionByName(M.tweaked_dates(_stories(e)))), "counts")  # a row for each medium and run
    return M.rank_correlation(M.top_media(counts.filter("run = 0")), M.top_media(counts.filter("run > 0"), 2))
