"""Writers: snapshots, dumps, graph files."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most nodes of a graph file; it is written by the driver.
GRAPH_NODES = 1000


def snapshot_copy(df: DataFrame, path: str, key: str, value: int) -> bool:
    """Write a table under its snapshot's key; false where that key is there already."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={value}/_SUCCESS")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return False
    df.write.mode("overwrite").parquet(f"{path}/{key}={value}")
    return True


def csv_dump(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_dump(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def daily_urls(stories: DataFrame, day: str, path: str) -> None:
    """URLs of a day's stories, latest first."""
    rows = stories.filter(F.to_date("publish_date") == F.lit(day).cast("date"))
    rows.orderBy(F.desc("publish_date"), F.desc("stories_id")).select("url").write.mode("overwrite").text(path)


def gexf(nodes: DataFrame, edges: DataFrame) -> str:
    """A GEXF graph of at most GRAPH_NODES nodes (``id, label, size``) and their edges (``source, target, weight``)."""
    kept = nodes.orderBy(F.desc("size"), "id").limit(GRAPH_NODES)
    inside = edges.join(F.broadcast(kept.select(F.col("id").alias("source"))), "source", "left_semi").join(F.broadcast(kept.select(F.col("id").alias("target"))), "target", "left_semi")
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" xmlns:viz="http://www.gexf.net/1.2draft/viz" version="1.2"><graph mode="static" defaultedgetype="directed"><nodes>']
    out += [f'<node id={quoteattr(str(n.id))} label={quoteattr(str(n.label))}><viz:size value="{n.size}"/></node>' for n in kept.collect()]
    out.append("</nodes><edges>")
    out += [f'<edge id="{k}" source={quoteattr(str(e.source))} target={quoteattr(str(e.target))} weight="{e.weight}"/>' for k, e in enumerate(inside.orderBy("source", "target").collect())]
    return "".join(out) + "</edges></graph></gexf>"
