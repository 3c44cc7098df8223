"""Media networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators import communities as C
from tidings.operators import graph as G
from tidings.operators import topics as T
from tidings.plans.registry import entity_query as query
from tidings.plans.topics import CROSS

EDGES = f", {CROSS}, edges AS (SELECT from_media AS source_media_id, to_media AS ref_media_id, count(*) AS link_count FROM cross_links WHERE from_media NOT IN (1, 2) AND to_media NOT IN (1, 2) GROUP BY 1, 2), inlinks AS (SELECT ref_media_id AS media_id, CAST(sum(link_count) AS BIGINT) AS inlinks FROM edges GROUP BY 1) "


def _edges(e):
    """Links between media, without platforms (two ids stand for them)."""
    links = T.medium_links(T.cross_media_links(e.topic_links, e.topic_stories, e.link_parts), e.topic_stories, e.link_parts)
    return links.filter(~F.col("source_media_id").isin(1, 2) & ~F.col("ref_media_id").isin(1, 2))


def _inlinks(edges):
    return edges.groupBy(F.col("ref_media_id").alias("media_id")).agg(F.sum("link_count").alias("inlinks"))


@query("media_network", EDGES + "SELECT * FROM edges")
def _(e):
    return _edges(e)


@query("giant_component", ", RECURSIVE_NONE AS (SELECT 1), links AS (SELECT media_id AS a, dup_media_id AS b FROM media WHERE dup_media_id IS NOT NULL) SELECT a, b FROM links WHERE a // 4 = (SELECT min(a // 4) FROM links WHERE (a // 4) IN (SELECT a // 4 FROM links GROUP BY 1 HAVING count(*) = 2))")
def _(e):
    edges = e.media.filter("dup_media_id is not null").select(F.col("media_id").alias("a"), F.col("dup_media_id").alias("b"))
    return G.giant_component(edges, "a", "b")


@query("top_nodes", EDGES + "SELECT * FROM inlinks ORDER BY inlinks DESC, media_id LIMIT 5")
def _(e):
    return G.top_nodes(_inlinks(_edges(e)), "inlinks", 5)


@query("ranked_edges", EDGES + "SELECT source_media_id, ref_media_id, link_count FROM (SELECT e.*, row_number() OVER (PARTITION BY source_media_id ORDER BY link_count DESC, inlinks DESC, ref_media_id) AS k FROM edges e JOIN inlinks i ON i.media_id = e.ref_media_id) WHERE k <= 3")
def _(e):
    edges = _edges(e)
    return G.ranked_edges(edges, _inlinks(edges), "source_media_id", "ref_media_id", 3).select("source_media_id", "ref_media_id", "link_count")


@query("scaled_nodes", EDGES + "SELECT media_id, inlinks, round(4 + 16 * inlinks / max(inlinks) OVER (), 6) AS size FROM inlinks")
def _(e):
    return G.scaled(_inlinks(_edges(e)), "inlinks", 4, 20).withColumn("size", F.round("size", 6))


@query("distance_prune", ", p AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) * 100 AS y FROM customer WHERE c_custkey <= 500), d AS (SELECT id, sqrt((x - avg(x) OVER ()) ** 2 + (y - avg(y) OVER ()) ** 2) AS far FROM p) SELECT id FROM d WHERE far <= 1.2 * (SELECT far FROM d ORDER BY far LIMIT 1 OFFSET (SELECT count(*) // 2 FROM d))")
def _(e):
    nodes = e.table("customer").filter("c_custkey <= 500").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey").cast("double") * 100).alias("y"))
    return G.near_centre(nodes, 1.2).select("id")


def _propagation(rounds: int) -> str:
    """Common table expressions of label propagation, one for each round."""
    out = EDGES + ", both_ways AS (SELECT source_media_id AS a, ref_media_id AS b, link_count AS w FROM edges UNION ALL SELECT ref_media_id, source_media_id, link_count FROM edges), labels0 AS (SELECT DISTINCT a AS node, a AS community FROM both_ways)"
    for k in range(rounds):
        out += f", labels{k + 1} AS MATERIALIZED (SELECT node, arg_min(community, (-w, community)) AS community FROM (SELECT a AS node, community, sum(w) AS w FROM both_ways JOIN labels{k} l ON l.node = b GROUP BY 1, 2) GROUP BY 1)"
    return f"{out} SELECT * FROM labels{rounds}"


@query("communities", _propagation(5))
def _(e):
    return G.communities(_edges(e), "source_media_id", "ref_media_id", "link_count")


@query("communities_louvain")
def _(e):
    return C.louvain(_edges(e), "source_media_id", "ref_media_id", "link_count")


@query("community_modularity", EDGES + """, both_ways AS (SELECT source_media_id AS a, ref_media_id AS b, link_count AS w FROM edges UNION ALL SELECT ref_media_id, source_media_id, link_count FROM edges),
parts AS (SELECT a % 5 AS community, CAST(sum(w) FILTER (a % 5 = b % 5) AS DOUBLE) AS inside, CAST(sum(w) AS DOUBLE) AS total FROM both_ways GROUP BY 1)
SELECT community, coalesce(inside, 0) AS inside, total, round(coalesce(inside, 0) / (SELECT sum(w) FROM both_ways) - 1.5 * (total / (SELECT sum(w) FROM both_ways)) ** 2, 9) AS part FROM parts""")
def _(e):
    edges = _edges(e)
    both = C.both_ways(edges, "source_media_id", "ref_media_id", "link_count")
    return C.modularity(both, both.select(F.col("a").alias("node"), (F.col("a") % 5).alias("community")).distinct()).withColumn("part", F.round("part", 9))
