"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is cut into k + 1 pieces: a text within k edits
of it holds at least one piece unchanged. An Aho-Corasick automaton finds exact piece
hits in one pass over each whole text; the window around a hit is verified by Myers'
bit-parallel edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import KEY, add_columns, map_texts, text_key, texts
from tidings.operators.storage import materialize

#: Edits allowed for each character of an item.
ERRORS = 0.06
#: Pieces shorter than this would hit by chance, so the budget of a short item is lowered to keep them longer.
LEAST_PIECE = 12
#: Items and characters of a block at most; each block is searched in all texts. A longer item is a block of its own.
BLOCK, BLOCK_CHARS = 20_000, 4_000_000

_between = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Lower case; each run of other characters than letters and digits is one space."""
    return _between.sub(" ", text.lower()).strip()


def budget(item: str, errors: float = ERRORS) -> int:
    return max(0, min(int(len(item) * errors), len(item) // LEAST_PIECE - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(item: str, window: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to any substring of ``window``, and the first end of such a one (Myers 1999)."""
    size = len(item)
    high, masks = 1 << (size - 1), {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    everything = (1 << size) - 1
    up, down, score = everything, 0, size
    best = (size, 0)
    for end, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        gain = down | ~(diagonal | up) & everything
        loss = up & diagonal
        if gain & high:
            score += 1
        elif loss & high:
            score -= 1
        gain, loss = gain << 1 & everything, loss << 1 & everything
        up = (loss | ~(diagonal | gain)) & everything
        down = gain & diagonal
        if score < best[0]:
            best = (score, end)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], errors: float):
        self.items, found = {}, {}
        for item_id, item in items:
            k = budget(item, errors)
            self.items[item_id] = item, k
            for at, piece in pieces(item, k):
                found.setdefault(piece, []).append((item_id, at))
        self.automaton = ahocorasick.Automaton()
        for piece, of in found.items():
            self.automaton.add_word(piece, (len(piece), of))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int]]:
        """``(item, distance)`` of each item within its budget of some part of ``text``."""
        windows: dict[int, list] = {}
        for end, (size, of) in self.automaton.iter(text) if len(self.automaton) else ():
            for item_id, at in of:
                windows.setdefault(item_id, []).append(end + 1 - size - at)  # where the item would begin
        out = []
        for item_id, starts in windows.items():
            item, k = self.items[item_id]
            spans: list[list[int]] = []
            for start in sorted(set(starts)):
                if spans and start - k <= spans[-1][1]:
                    spans[-1][1] = start + len(item) + k
                else:
                    spans.append([start - k, start + len(item) + k])
            best = k + 1
            for left, right in spans:  # no letter is compared twice
                window = text[max(0, left) : right]
                best = 0 if item in window else min(best, best_match(item, window)[0])
                if best == 0:
                    break
            if best <= k:
                out.append((item_id, best))
        return out


def _pieces_of(benchmark: DataFrame, text_col: str) -> DataFrame:
    """``item_id, text, piece``: items normalised and without repeats; a piece is what a task has in a row, within a block's bounds."""
    from pyspark import TaskContext

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")

    def plain(ids: list, batch: list) -> dict:
        return {"item_id": ids, "text": [normal(t) for t in batch]}

    items = map_texts(rows, plain, "item_id long, text string").filter("text <> ''").distinct()
    now = {"piece": -1, "items": 0, "chars": 0}

    def numbered(batch: list) -> dict:
        out = []
        for text in batch:
            if now["piece"] < 0 or now["items"] == BLOCK or now["chars"] + len(text) > BLOCK_CHARS:
                now.update(piece=now["piece"] + 1, items=0, chars=0)
            now.update(items=now["items"] + 1, chars=now["chars"] + len(text))
            out.append((TaskContext.get().partitionId() << 32) + now["piece"])
        return {"piece": out}

    return materialize(add_columns(items, ["text"], numbered, "piece long"), "items")


def _blocks(benchmark: DataFrame, text_col: str) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks the items make, and the blocks, each read when it is asked for: pieces in a row within the bounds."""
    items = _pieces_of(benchmark, text_col)
    ranges: list[list[int]] = []
    for r in sorted(items.groupBy("piece").agg(F.count("*").alias("items"), F.sum(F.length("text")).alias("chars")).collect()):
        if ranges and ranges[-1][2] + r["items"] <= BLOCK and ranges[-1][3] + r["chars"] <= BLOCK_CHARS:
            ranges[-1] = [ranges[-1][0], r["piece"], ranges[-1][2] + r["items"], ranges[-1][3] + r["chars"]]
        else:
            ranges.append([r["piece"], r["piece"], r["items"], r["chars"]])
    return len(ranges), ([(r["item_id"], r["text"]) for r in items.filter(F.col("piece").between(lo, hi)).collect()] for lo, hi, _, _ in ranges)


def _with_hits(df: DataFrame, shared: Broadcast, errors: float, text_col: str) -> DataFrame:
    """``df`` and ``_tidings_hits``: item, distance and budget of each item of the block ``shared`` that the text holds."""
    made: list[Matcher] = []

    def per_batch(batch: list) -> dict:
        if not made:  # an id may repeat with other texts, so the matcher knows items by their place in the block
            made.append(Matcher([(i, n) for i, (_, n) in enumerate(shared.value)], errors))
        names, matcher = shared.value, made[0]
        return {"_tidings_hits": [[{"item_id": names[i][0], "distance": d, "budget": matcher.items[i][1]} for i, d in matcher.matches(normal(t or ""))] for t in batch]}

    return add_columns(df, [text_col], per_batch, "_tidings_hits array<struct<item_id: long, distance: int, budget: int>>")


def _each_block(df: DataFrame, count: int, blocks: Iterator[list[tuple[int, str]]], errors: float, text_col: str, chosen: Callable[[DataFrame], DataFrame]) -> Iterator[DataFrame]:
    """What is ``chosen`` of the rows with hits, block by block; of several blocks each is released once its rows are written."""
    for block in blocks:
        shared = df.sparkSession.sparkContext.broadcast(block)
        rows = chosen(_with_hits(df, shared, errors, text_col).filter("size(_tidings_hits) > 0"))
        if count > 1:
            rows = materialize(rows, "hits")
            shared.destroy()
        yield rows


def find_leaks(df: DataFrame, benchmark: DataFrame, errors: float = ERRORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, distance, budget`` for each test item that a document holds within the error budget.

    Both texts are normalised (lower case, letters and digits, single spaces). Items that are null or
    have no letter or digit match nothing; items or documents that repeat an id count as one, of which the
    nearest is told, null ids included. Null and empty documents match nothing. The benchmark is read in
    blocks of at most BLOCK items and BLOCK_CHARS characters, an item longer than that as one of its own.
    Driver and tasks hold one block at a time, so what they hold is bounded by that or by the longest item.
    """
    count, blocks = _blocks(benchmark, text_col)
    rows = None
    for hits in _each_block(texts(df, id_col, text_col), count, blocks, errors, "text", lambda hit: hit.select("doc_id", F.inline("_tidings_hits"))):
        rows = hits if rows is None else rows.union(hits)
    if rows is None:
        return df.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, budget int")
    return rows.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("budget").alias("budget"))


def drop_leaks(df: DataFrame, benchmark: DataFrame, errors: float = ERRORS, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no test item, with all their columns; null texts stay."""
    count, blocks = _blocks(benchmark, text_col)
    if count == 1:
        shared = df.sparkSession.sparkContext.broadcast(next(blocks))
        return _with_hits(df, shared, errors, text_col).filter("size(_tidings_hits) = 0").drop("_tidings_hits")
    text, gone = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), None
    for keys in _each_block(df.select(text.alias("text")), count, blocks, errors, "text", lambda hit: hit.select(*text_key(F.col("text")))):
        gone = keys if gone is None else gone.union(keys)
    if gone is None:
        return df
    return df.select("*", *text_key(text)).join(gone.distinct(), KEY, "left_anti").select(*(f"`{c}`" for c in df.columns))
