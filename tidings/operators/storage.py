"""Shared intermediate tables: the only way the library cuts a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Only a session
    without that setting (local tests) gets a temporary folder of this machine.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tidings.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidings-")
        spark.conf.set("tidings.shared.dir", named)
    return named.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table."""
    return f"{shared_dir(spark)}/tidings-{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a short lineage that outlives executors.

    The write also counts the rows and sums their hashes; see ``rows_and_sum``.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*(f"`{c}`" for c in df.columns)).cast("decimal(38,0)")).alias("sum")).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidings_path, out._tidings_seen = path, seen
    return out


def materialize_sorted(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Write ``df`` to the shared folder as a table dealt into buckets by ``keys`` and sorted in each.

    There are as many buckets as shuffle partitions, so a join by the keys reads the table as it lies,
    without an exchange; one that is shuffled by the keys already is written one file a bucket.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._tidings_path, out._tidings_table = path, table
    return out


def rows_and_sum(table: DataFrame) -> tuple[int, object]:
    """Of a table made by ``materialize``: its row count and a checksum of its rows in any order."""
    got = table._tidings_seen.get
    return got["rows"], got["sum"]


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table made by ``materialize`` or ``materialize_sorted`` that no later step reads."""
    path = getattr(df, "_tidings_path", None)
    if table := getattr(df, "_tidings_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS `{table}`")
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
