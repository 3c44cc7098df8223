"""Date functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(d: Column) -> Column:
    """The Monday of a date's week."""
    return F.date_trunc("week", d).cast("date")


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def solr_dates(d: Column) -> dict[str, Column]:
    """ISO texts of a date cut to the minute, day, week, month and year, as the search documents hold them."""
    return {f"publish_{p}": F.date_format(F.date_trunc(p, d), "yyyy-MM-dd'T'HH:mm:ss'Z'") for p in ("minute", "day", "week", "month", "year")}


def in_period(d: Column, start: Column, end: Column) -> Column:
    """From ``start`` to one second before ``end``."""
    return (d >= start) & (d <= end - F.expr("interval 1 second"))


def date_in_url(url: Column) -> Column:
    """A date that a URL's path states, or null."""
    found = [F.regexp_extract(url, r"/((?:19|20)\d\d)[/-]?(0[1-9]|1[0-2])[/-]?(0[1-9]|[12]\d|3[01])(?:\D|$)", k) for k in (1, 2, 3)]
    return F.try_to_date(F.when(found[0] != "", F.concat_ws("-", *found)), "yyyy-MM-dd")


# Metas that state a page's date, by how far they are relied on, and the months of English texts.
META_DATES = "article:published_time datePublished pubdate dc.date.issued dc.date date parsely-pub-date sailthru.date".split()
MONTHS = "january february march april may june july august september october november december".split()


def _iso_day(text: Column) -> Column:
    """The day that a text like ``2024-03-05T10:00``, ``2024/3/5`` or ``20240305`` begins with, or null.

    Without marks between, month and day have two digits each; so no digit of one is read as the other.
    """
    month, day = r"0[1-9]|1[0-2]", r"0[1-9]|[12]\d|3[01]"
    pattern = rf"^\s*((?:19|20)\d\d)(?:[-/.]({month}|[1-9])[-/.]({day}|[1-9])|({month})({day}))(?:\D|$)"
    part = lambda *at: F.concat(*(F.regexp_extract(text, pattern, k) for k in at))
    return F.try_to_date(F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2, 4), 2, "0"), F.lpad(part(3, 5), 2, "0"))), "yyyy-MM-dd")


def _written_day(text: Column) -> Column:
    """The first day that a text writes out: ``March 5, 2024`` or ``5 March 2024``."""
    names = "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in MONTHS)
    months = F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m[:3], f"{k:02d}")))

    def day(pattern: str, d: int, m: int, y: int) -> Column:
        part = lambda k: F.regexp_extract(text, pattern, k)
        return F.try_to_date(F.when(part(y) != "", F.concat_ws("-", part(y), F.try_element_at(months, F.lower(F.left(part(m), F.lit(3)))), F.lpad(part(d), 2, "0"))), "yyyy-MM-dd")

    return F.coalesce(day(rf"(?i)\b({names})\.? +([0-3]?\d)(?:st|nd|rd|th)?,? +((?:19|20)\d\d)\b", 2, 1, 3), day(rf"(?i)\b([0-3]?\d)(?:st|nd|rd|th)? +({names})\.? +((?:19|20)\d\d)\b", 1, 2, 3))


def guess_date(url: Column, html: Column) -> Column:
    """``day, method`` of a page by the best evidence that it has; null, ``undateable`` without any.

    In this order: a meta that states the publication, the URL's path, a ``time`` element, then a day that is
    written out behind ``published``, ``posted`` or ``updated``. A date that does not exist is no evidence.
    """
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    found = []
    for name in META_DATES:
        either = [rf"""(?is)<meta[^>]*(?:property|name|itemprop)=["']{name}["'][^>]*content=["']([^"']*)["']""", rf"""(?is)<meta[^>]*content=["']([^"']*)["'][^>]*(?:property|name|itemprop)=["']{name}["']"""]
        found += [(f"guess_by_meta_{name}", once(F.regexp_extract(html, p, 1), _iso_day)) for p in either]
    found.append(("guess_by_url", date_in_url(url)))
    found.append(("guess_by_time_tag", once(F.regexp_extract(html, r"""(?is)<time[^>]*datetime=["']([^"']*)["']""", 1), _iso_day)))
    found.append(("guess_by_text", once(F.regexp_extract(F.regexp_replace(html, r"<[^>]*>", " "), r"(?is)\b(?:published|posted|updated)\b(.{0,60})", 1), _written_day)))
    none = F.struct(F.lit(None).cast("date").alias("day"), F.lit("undateable").alias("method"))

    def as_evidence(method: str):
        return lambda d: F.when(d.isNotNull(), F.struct(d.alias("day"), F.lit(method).alias("method")))

    return F.coalesce(*(once(day, as_evidence(method)) for method, day in found), none)
