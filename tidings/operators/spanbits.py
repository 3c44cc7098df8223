"""Timespans as bits: those of one kind are numbered, and a story's are a few words of 64 bits, so joins meet words and not timespans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 64
#: Kinds of timespans, by their place.
PERIODS = ["overall", "weekly", "monthly", "custom"]


def kind_of(period: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PERIODS)), period).cast("int") - 1


def period_of(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PERIODS)), kind + 1)


def number_of(kind: Column, start: Column) -> Column:
    """Weeks from Monday 1970-01-05, months from the year 0, days of custom starts; 0 for the overall timespan."""
    day = F.unix_date(start)
    return F.when(kind == 1, (day - 4) / 7).when(kind == 2, F.year(start) * 12 + F.month(start) - 1).when(kind == 3, day).otherwise(0).cast("int")


def start_of(kind: Column, number: Column) -> Column:
    year = F.floor(number / 12).cast("int")
    return F.when(kind == 1, F.date_from_unix_date(number * 7 + 4)).when(kind == 2, F.make_date(year, number - year * 12 + 1, F.lit(1))).when(kind == 3, F.date_from_unix_date(number))


def words(number: str) -> list[Column]:
    """``word, bits`` of a number; negative ones too."""
    return [F.expr(f"shiftright({number}, 6)").alias("word"), F.expr(f"shiftleft(1L, {number} & 63)").alias("bits")]


def has(bits: str, k: int) -> Column:
    """1 where bit ``k`` is set, else 0."""
    return F.shiftrightunsigned(bits, k).bitwiseAND(F.lit(1).cast("long"))


def bit_counts(name: str, bits: str = "bits") -> list[Column]:
    """For an aggregate: how many rows have each bit, as ``name_0`` and so on; no row is made for a bit."""
    return [F.sum(has(bits, k)).alias(f"{name}_{k}") for k in range(WIDTH)]


def by_number(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``keys, number, names``: a row for each bit whose first count is not 0."""
    each = [F.struct((F.col("word") * WIDTH + k).alias("number"), *(F.col(f"{n}_{k}").alias(n) for n in names)) for k in range(WIDTH)]
    return df.select(*keys, F.inline(F.array(*each))).filter(f"{names[0]} > 0")
