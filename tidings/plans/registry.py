"""The registry of queries: a function from (spark, sf_dir) to a DataFrame, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tidings.sources.entities import ENTITIES_SQL, Entities


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``."""

    def add(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, sql)
        return run

    return add


def entity_query(name: str, sql: str | None = None):
    """Register a query over the entities; its SQL names them as tables."""

    def add(run: Callable[[Entities], DataFrame]):
        query(name, sql and ENTITIES_SQL + sql)(lambda spark, sf_dir: run(Entities(spark, sf_dir)))
        return run

    return add
