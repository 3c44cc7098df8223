"""Export of a part of the tables that holds all it refers to: from seed rows to every referenced row, until nothing is added."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.operators.storage import materialize, rows_and_sum


class Reference(NamedTuple):
    """``table.column`` names a row of ``parent`` by its key; ``pulls``: rows that name a kept parent are kept too."""

    table: str
    column: str
    parent: str
    pulls: bool = False


def closed_subset(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], seeds: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of each table that the seeds need: no reference of theirs dangles that did not dangle before.

    ``keys``: the key column of each table; ``seeds``: for some tables, DataFrames with that column. Parents of
    kept rows are kept, and so are children along references that pull. Each round works on the keys that the
    round before has added, by semi and anti joins on keys; the driver sees counts. Null references name nothing.
    """
    kept: dict[str, list[DataFrame]] = {t: [] for t in tables}
    fresh: dict[str, DataFrame] = {}

    def add(name: str, found: list[DataFrame]) -> DataFrame | None:
        rows = found[0]
        for f in found[1:]:
            rows = rows.union(f)
        rows = rows.filter(F.col("k").isNotNull()).distinct()
        for old in kept[name]:
            rows = rows.join(old, "k", "left_anti")
        rows = materialize(rows, "closed")
        if not rows_and_sum(rows)[0]:
            return None
        kept[name].append(rows)
        return rows

    key = {t: tables[t].select(F.col(keys[t]).alias("k")) for t in tables}
    for name, rows in seeds.items():
        if (new := add(name, [key[name].join(rows.select(F.col(keys[name]).alias("k")), "k", "left_semi")])) is not None:
            fresh[name] = new
    while fresh:
        found: dict[str, list[DataFrame]] = {}
        for r in references:
            own = tables[r.table].select(F.col(keys[r.table]).alias("k"), F.col(r.column).alias("up"))
            if r.table in fresh:
                named = own.join(fresh[r.table], "k", "left_semi").select(F.col("up").alias("k"))
                found.setdefault(r.parent, []).append(key[r.parent].join(named, "k", "left_semi"))
            if r.pulls and r.parent in fresh:
                found.setdefault(r.table, []).append(own.join(fresh[r.parent].select(F.col("k").alias("up")), "up", "left_semi").select("k"))
        fresh = {t: new for t, f in found.items() if (new := add(t, f)) is not None}

    def whole(name: str) -> DataFrame:
        if not kept[name]:
            return tables[name].limit(0)
        rows = kept[name][0]
        for more in kept[name][1:]:
            rows = rows.union(more)
        return tables[name].join(rows.select(F.col("k").alias(keys[name])), keys[name], "left_semi")

    return {t: whole(t) for t in tables}
