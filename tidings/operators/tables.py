"""Changes of tables as functions: Parquet has no MERGE, so each returns the table's next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``ON CONFLICT DO NOTHING``: rows whose key is new, one of each key."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


find_or_create = insert_ignore


def upsert_add(table: DataFrame, rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """``ON CONFLICT DO UPDATE`` that adds counts."""
    return table.unionByName(rows).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def update_where(table: DataFrame, condition: Column, **values) -> DataFrame:
    """Set columns where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.filter(~F.coalesce(condition, F.lit(False)))


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == value)


def require(table: DataFrame, key: str, value):
    """The row of a key; an error where there is none."""
    row = lookup(table, key, value).first()
    if row is None:
        raise LookupError(f"no row with {key} = {value}")
    return row


def diff(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``key, change``: added, deleted or modified."""
    a, b = old.select(key, F.struct(*values).alias("old")), new.select(key, F.struct(*values).alias("new"))
    both = a.join(b, key, "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select(key, change.alias("change")).filter("change is not null")


def missing_keys(table: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values of a foreign key that the parent lacks."""
    return table.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti").select(column).distinct()
