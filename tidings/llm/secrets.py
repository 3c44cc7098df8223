"""Secret scan through a trigram inverted index, by DataFrame functions only.

Each rule's regex yields a Boolean query of trigrams that any match must hold (an OR of
ANDs, after Cox 2012), on lower-cased text. The index lists, for each trigram of any
query, the texts that hold it. Postings of a conjunction are intersected; the texts
that are left are candidates, and only they are searched with the rule's regex. Rules
whose regex implies no trigram search every text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import KEY, text_key
from tidings.operators.storage import materialize


class Rule(NamedTuple):
    kind: str
    regex: str
    #: The group that must have at least ``least`` characters; shorter matches are dropped, not retried.
    group: int = 0
    least: int = 0


#: The base kinds. A run of 24 or more hex digits is the same as a run of hex digits that has 24.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Kinds that the scan adds: key blocks and the public formats of some services' tokens.
MORE = [
    Rule("key_block", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
]
#: Sets of strings or of characters larger than this are given up in favour of what is known so far.
MANY = 48

Query = frozenset  # of conjunctions, each a frozenset of trigrams; one with an empty conjunction holds everywhere
ANY: Query = frozenset([frozenset()])


def _absorbed(q: set) -> Query:
    return frozenset(a for a in q if not any(b < a for b in q))


def _and(p: Query, q: Query) -> Query:
    return _absorbed({a | b for a in p for b in q})


def _of_strings(strings: set[str]) -> Query:
    return _absorbed({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _strings(op, arg) -> set[str] | None:
    """All strings that a node of a parsed regex matches, lower-cased, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        out = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < MANY:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if name == "SUBPATTERN":
        return _all(arg[3])
    if name == "BRANCH":
        parts = [_all(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if name == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1:
        inner = _all(arg[2])
        return None if inner is None else inner | {""}
    return None


def _all(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        part = _strings(op, arg)
        if part is None or len(out) * len(part) > MANY:
            return None
        out = {a + b for a in out for b in part}
    return out


def _query(nodes) -> Query:
    known, run = ANY, {""}
    for op, arg in nodes:
        part = _strings(op, arg)
        if part is not None and len(run) * len(part) <= MANY:
            run = {a + b for a in run for b in part}
            continue
        known, run = _and(known, _of_strings(run)), {""}
        name = str(op)
        if part is not None:
            run = part
        elif name == "SUBPATTERN":
            known = _and(known, _query(arg[3]))
        elif name == "BRANCH":
            known = _and(known, _absorbed(set().union(*(_query(x) for x in arg[1]))))
        elif name == "MAX_REPEAT" and arg[0] > 0:
            known = _and(known, _query(arg[2]))
    return _and(known, _of_strings(run))


def trigram_query(regex: str) -> Query | None:
    """An OR of ANDs of trigrams, one of which every match holds; None where the regex implies none."""
    found = _query(re._parser.parse(regex))
    return None if frozenset() in found else found


def build_index(df: DataFrame, trigrams: list[str], text: Column) -> DataFrame:
    """Postings ``trigram, text key`` of the trigrams that some rule asks for, as a table partitioned by trigram."""
    low = df.select(*text_key(text), F.lower(text).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    return materialize(low.select(*KEY, F.explode(held).alias("trigram")), "postings", ["trigram"])


def candidates(df: DataFrame, rules: list[Rule], text: Column) -> DataFrame | None:
    """``text key, _tidings_kinds``: the texts that satisfy a rule's trigram query, with the kinds of such rules."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not None}
    trigrams = sorted({t for q in queries.values() for a in q for t in a})
    if not trigrams:
        return None
    place = {t: i for i, t in enumerate(trigrams)}
    terms = [(place[t], kind, k, 1 << i, (1 << len(a)) - 1) for kind, q in queries.items() for k, a in enumerate(sorted(q, key=sorted)) for i, t in enumerate(sorted(a))]
    # one row for each trigram of each conjunction: as many as the rules' text has letters
    wanted = F.broadcast(df.sparkSession.createDataFrame(terms, "trigram int, kind string, part int, bit long, full long"))
    found = build_index(df, trigrams, text).join(wanted, "trigram").groupBy(*KEY, "kind", "part").agg(F.bit_or("bit").alias("bits"), F.first("full").alias("full"))
    return materialize(found.filter("bits = full").groupBy(*KEY).agg(F.collect_set("kind").alias("_tidings_kinds")), "candidates")


#: Values that are summed one by one; a longer array is summed in stretches of so many, so its cost stays near its length.
STRETCH = 128


def _running(values: Column) -> Column:
    """Running sums of an array of numbers that is not empty."""
    append = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    summed = lambda a: F.aggregate(a, F.array(F.lit(0)), append)
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRETCH).cast("int"))
    inner = F.transform(starts, lambda k: summed(F.slice(values, k * STRETCH + 1, STRETCH)))  # each with a 0 before it

    def placed(parts: Column) -> Column:
        before = summed(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), F.slice(before, 1, F.size(parts)).alias("before")), lambda z: F.transform(F.slice(z["part"], 2, F.size(z["part"]) - 1), lambda v: v + z["before"])))

    return F.element_at(F.transform(F.array(inner), placed), 1)  # the sums of the stretches are made once


def _spans(text: Column, rule: Rule, order: int, matches: Column, values: Column) -> Column:
    """Spans of the leftmost matches, from the running lengths of what lies between and of the matches."""
    gaps = F.slice(F.split(text, rule.regex), F.lit(1), F.size(matches))
    ends = _running(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m)))
    kind = "array<struct<start: int, place: int, kind: string, end: int>>"
    good = F.filter(F.arrays_zip(ends.alias("end"), matches.alias("match"), values.alias("value")), lambda s: F.length(s["value"]) >= rule.least)
    spans = F.transform(good, lambda s: F.struct((s["end"] - F.length(s["match"])).alias("start"), F.lit(order).alias("place"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")))
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(kind))


def find_secrets(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """All columns and ``secrets``: spans ``start, place, kind, end`` in code points, by start, then kind as listed.

    Matches of a rule are leftmost and do not overlap; those of different rules may. A null text counts as
    empty. Texts are named by content, so null and repeated ids, repeated rows and any further columns do
    not matter (a column called ``secrets`` is replaced); an empty table gives an empty one. Very long texts
    are read whole, and many matches in one cost near their number.
    """
    rules = BASE + MORE if rules is None else rules
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = [c for c in df.columns if c != "secrets"]
    indexed = {r.kind for r in rules if trigram_query(r.regex) is not None}
    hits = candidates(df, rules, text)
    rows = df.select(*columns, *text_key(text))
    rows = rows.withColumn("_tidings_kinds", F.array().cast("array<string>")) if hits is None else rows.join(hits, KEY, "left")
    rows = rows.withColumn("_tidings_text", text)
    found = []
    for r in rules:
        may = F.array_contains("_tidings_kinds", r.kind) if r.kind in indexed else F.lit(True)
        none = F.array().cast("array<string>")
        for name, group in (("m", 0), ("v", r.group)):
            rows = rows.withColumn(f"_tidings_{name}_{r.kind}", F.when(may, F.regexp_extract_all("_tidings_text", F.lit(r.regex), F.lit(group))).otherwise(none))
    for k, r in enumerate(rules):
        found.append(_spans(F.col("_tidings_text"), r, k, F.col(f"_tidings_m_{r.kind}"), F.col(f"_tidings_v_{r.kind}")))
    return rows.select(*columns, F.array_sort(F.concat(*found)).alias("secrets"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _only(place: int):
    return lambda p: F.when(p == place, p)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("secrets", lambda s: s["place"] < len(BASE))
    places = F.transform("secrets", lambda s: s["place"])
    counts = [F.size(F.array_compact(F.transform(places, _only(k)))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return found.select(id_col, *counts, F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
