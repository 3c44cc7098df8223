"""The boolean query language of story search, turned into Column predicates.

Words side by side mean OR; a negated one after a clause means AND NOT; ``+`` means AND,
a leading one nothing. AND and OR have no precedence: they fold from left to right.
A term matches at the start of a word, in either case.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'"[^"]*"(?:~\d+)?|[()+!-]|[^\s()"+!-][^\s()"+!]*')
_START, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


class QueryError(ValueError):
    """The text is no query, or nothing of it is left."""


class Node(NamedTuple):
    """``op``: term, phrase, near, and, or, not, field, noop."""

    op: str
    args: tuple
    #: Of a near clause: words that may stand between.
    distance: int = 0


NOOP = Node("noop", ())


def straight_quotes(query: str) -> str:
    return query.translate({0x201C: '"', 0x201D: '"', 0x2018: "'", 0x2019: "'"})


def upper_booleans(query: str) -> str:
    """``and``, ``or``, ``not`` outside quotes in upper case."""
    return "".join(p if p.startswith('"') else re.sub(r"\b(and|or|not)\b", lambda m: m[0].upper(), p) for p in re.split(r'("[^"]*")', query))


def tokens(query: str) -> list[str]:
    text = re.sub(r"\{![^}]*\}", " ", straight_quotes(query).lower()).replace("'", " ")
    text = re.sub(r"\+?[a-z_]+:\[[^\]]*\]", " __noop__ ", text)
    if re.search(r"(?:^|[\s(])\*", text) or "/" in text:
        raise QueryError(f"wildcards go at the end of a term, and slashes nowhere: {query}")
    return _TOKEN.findall(text)


def _join(op: str, a: Node, b: Node) -> Node:
    return Node(op, (*(a.args if a.op == op else (a,)), *(b.args if b.op == op else (b,))))


def _leaf(token: str) -> Node:
    if token == "__noop__":
        return NOOP
    if token.startswith('"'):
        words = tuple(re.findall(r"[^\s\"!-/:-@\[-^`{-~]+", token.rpartition('"')[0]))
        near = token.rpartition('"')[2]
        return NOOP if not words else Node("near", words, int(near[1:])) if near else Node("phrase", words)
    return Node("term", (token.rstrip("*"), token.endswith("*")))


def parse(query: str) -> Node:
    """The tree of a query."""
    todo = tokens(query)
    todo.reverse()

    def clause() -> Node:
        while todo and todo[-1] == "+":
            todo.pop()
        token = todo.pop() if todo else None
        if token is None or token in ("and", "or", ")"):
            raise QueryError(f"a clause is missing in {query}")
        if token in ("not", "-", "!"):
            return Node("not", (clause(),))
        if token == "(":
            inner = group()
            if not todo or todo.pop() != ")":
                raise QueryError(f"a bracket is open in {query}")
            return inner
        if ":" in token:
            name, _, value = token.partition(":")
            return Node("field", (name, _leaf(value) if value else clause()))
        return _leaf(token)

    def group() -> Node:
        left = clause()
        while todo and todo[-1] != ")":
            op = "or"
            if todo[-1] in ("and", "or"):
                op = todo.pop()
            elif todo[-1] in ("+", "not", "-", "!"):
                op = "and"
            left = _join(op, left, clause())
        return left

    out = group()
    if todo:
        raise QueryError(f"too many brackets in {query}")
    return out


def only(node: Node, keep: Callable[[Node], bool]) -> Node | None:
    """The tree without the nodes that ``keep`` refuses, and without what is empty then."""
    if node.op == "noop" or not keep(node):
        return None
    if node.op in ("and", "or"):
        parts = [p for a in node.args if (p := only(a, keep)) is not None]
        return None if not parts else parts[0] if len(parts) == 1 else Node(node.op, tuple(parts))
    if node.op == "not":
        inner = only(node.args[0], keep)
        return None if inner is None else Node("not", (inner,))
    if node.op == "field":
        inner = only(node.args[1], keep)
        return None if inner is None else Node("field", (node.args[0], inner))
    return node


def text_part(query: str) -> Node:
    """The part of a query that is about the text: other fields and ranges are left out; nothing left is an error."""
    found = only(parse(query), lambda n: n.op != "field" or n.args[0] == "text")
    if found is None:
        raise QueryError(f"no text clause in {query}")
    return found


def tsquery(query: str) -> str:
    """The text part in the notation of text search queries: ``a & b``, ``a | b``, ``!a``, ``a:*``."""

    def show(n: Node) -> str:
        if n.op == "term":
            return n.args[0] + (":*" if n.args[1] else "")
        if n.op in ("phrase", "near"):
            return f"( {' & '.join(n.args)} )" if len(n.args) > 1 else n.args[0]
        if n.op == "not":
            return "!" + show(n.args[0])
        if n.op == "field":
            return show(n.args[1])
        return f"( {(' & ' if n.op == 'and' else ' | ').join(map(show, n.args))} )"

    return show(text_part(query))


def pattern(node: Node, boundary: bool = True, exact: bool = False) -> str:
    """Regex of a term or phrase; an exact one ends where its word ends, unless the term has a star."""
    words = node.args[:1] if node.op == "term" else node.args
    end = _END if exact and not (node.op == "term" and node.args[1]) else ""
    return "(?iu)" + (_START if boundary else "") + r"\s+".join(map(re.escape, words)) + end


def within(text: Column, words: tuple, distance: int) -> Column:
    """Whether all words stand in some stretch of the text's words that has ``distance`` more than they are."""
    own = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    starts = F.filter(F.transform(own, lambda w, i: F.when(w.isin(*words), i + 1)), lambda i: i.isNotNull())
    hit = lambda i: F.forall(F.array(*map(F.lit, sorted(set(words)))), lambda w: F.array_contains(F.slice(own, i, len(words) + distance), w))
    return F.exists(starts, hit)


def matches(node: Node, text: Column, fields: dict[str, Callable[[str], Column]] | None = None, exact: bool = False) -> Column:
    """The predicate: ``fields`` makes one from a value of a named field; a field it lacks is an error."""
    if node.op == "and" or node.op == "or":
        parts = [matches(a, text, fields, exact) for a in node.args if a.op != "noop"] or [F.lit(True)]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.op == "and" else out | p
        return out
    if node.op == "not":
        return ~matches(node.args[0], text, fields, exact)
    if node.op == "field":
        name, inner = node.args
        if name == "text":
            return matches(inner, text, fields, exact)
        if name not in (fields or {}):
            raise QueryError(f"no field {name}")
        return _of_field(inner, fields[name])
    if node.op == "noop":
        return F.lit(True)
    if node.op == "near":
        out = F.lit(True)
        for w in node.args:
            out = out & text.rlike(pattern(Node("term", (w, False)), exact=exact))
        return out & within(text, node.args, node.distance) if exact else out
    return text.rlike(pattern(node, exact=exact))


def _of_field(node: Node, make: Callable[[str], Column]) -> Column:
    if node.op == "not":
        return ~_of_field(node.args[0], make)
    if node.op in ("and", "or"):
        out = _of_field(node.args[0], make)
        for a in node.args[1:]:
            part = _of_field(a, make)
            out = out & part if node.op == "and" else out | part
        return out
    return make(" ".join(node.args) if node.op == "phrase" else node.args[0])


def predicate(query: str, text: str | Column = "text", fields: dict[str, Callable[[str], Column]] | None = None, exact: bool = False) -> Column:
    """The Column for a whole query, fields included; ``exact`` asks for whole words and counts the distance of near clauses."""
    return matches(parse(query), F.col(text) if isinstance(text, str) else text, fields, exact)


def any_term(query: str, text: str | Column = "text", logograms: bool = False) -> Column:
    """Whether any positive term or phrase of the query occurs: for sentences of stories that match it.

    Languages without spaces (``logograms``) have no word starts, so none are asked for.
    """
    found: list[str] = []

    def collect(n: Node) -> None:
        if n.op in ("term", "phrase"):
            found.append(pattern(n, not logograms))
        elif n.op == "near":
            found.extend(pattern(Node("term", (w, False)), not logograms) for w in n.args)
        elif n.op == "field":
            collect(n.args[1])
        elif n.op != "not":
            for a in n.args:
                collect(a)

    collect(text_part(query))
    return (F.col(text) if isinstance(text, str) else text).rlike("|".join(f"(?:{p})" for p in found))
