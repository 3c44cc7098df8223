"""A positional full-text index kept as sorted runs that are merged level by level.

Each batch of changes becomes a run: its words with their places, sorted by word, and the stories that it
touches. A story counts in the newest run that touches it; so an update hides the postings of older runs, and a
deletion is a run without any. FAN runs of a level are merged into one of the next, which drops what is hidden.
A search reads the postings of its words only; phrases and distances are decided by places, no text is read.

Postings stay in the task that makes them: it sorts them in stretches, whose pages a search tells by their words.
So neither texts nor postings are shuffled to write or to merge a run, and disk holds little but the runs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions.boolean import Node, QueryError, text_part
from tidings.operators.storage import materialize, rows_and_sum, table_path

#: Runs of a level that are merged into one of the next.
FAN = 4
#: Postings that a task sorts at once, and how many it hands on at once.
STRETCH, HANDED_ON = 2_000_000, 50_000
#: Stories that are broadcast at once, and parts of them that a merge goes through one by one; still more are told by a join that shuffles.
HELD, PASSES = 2_000_000, 16
#: White space and marks between two words where it is not white space alone.
_MARKS = r"\s*[^\p{L}\p{N}_\s][^\p{L}\p{N}_]*"
#: Stands for such a gap in texts that go to Python; a mark itself, so no word has it.
_MARK = "\x01"
_POSTING = pa.schema([("stories_id", pa.int64()), ("word", pa.string()), ("place", pa.int32())])
#: How postings are written: numbers as differences to the one before, which are small in the order of words and stories.
_PACKED = {"parquet.writer.version": "v2", "parquet.enable.dictionary#stories_id": "false", "compression": "zstd"}


class Run(NamedTuple):
    number: int  #: of the newest batch in it
    level: int
    postings: str
    touched: str


def words_with_places(rows: DataFrame) -> DataFrame:
    """``stories_id, word, place``: twice the word's number in the text, one more where only white space parts it from the word before.

    Each task hands on its postings in stretches of some STRETCH, sorted by word and story.
    """
    marked = F.regexp_replace(F.lower("text"), _MARKS, _MARK)  # Spark's letters, not Python's, which are of another Unicode
    return rows.select(F.col("stories_id").cast("long"), marked).mapInArrow(_postings_of_texts, "stories_id long, word string, place int")


def _in_order(stories: np.ndarray, codes: np.ndarray, places: np.ndarray, words: list[str]) -> Iterator[pa.RecordBatch]:
    """Postings by word, as Spark compares them, and story; ``codes`` number the words, of which none stands twice."""
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    ids, story = np.unique(stories, return_inverse=True)
    ranks, names = rank[codes], pa.array([words[k] for k in order], pa.string())
    by = np.argsort(ranks * len(ids) + story, kind="stable")
    for at in range(0, len(by), HANDED_ON):
        some = by[at : at + HANDED_ON]
        yield pa.RecordBatch.from_arrays([pa.array(stories[some]), names.take(pa.array(ranks[some])), pa.array(places[some])], schema=_POSTING)


def _postings_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes: defaultdict[str, int] = defaultdict()  # of words, and apart from them of words behind a mark
    codes.default_factory = codes.__len__
    held: list[tuple[int, np.ndarray]] = []

    def sorted_ones() -> Iterator[pa.RecordBatch]:
        bare: defaultdict[str, int] = defaultdict()
        bare.default_factory = bare.__len__
        word_of = np.array([bare[w.removeprefix(_MARK)] for w in codes], np.int64)
        joined = np.array([not w.startswith(_MARK) for w in codes], np.int32)
        sizes = [len(own) for _, own in held]
        found = np.concatenate([own for _, own in held])
        places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) * np.int32(2) + joined[found]
        stories = np.repeat(np.array([story for story, _ in held], np.int64), sizes)
        yield from _in_order(stories, word_of[found], places, list(bare))
        codes.clear()
        held.clear()

    waiting = 0
    for batch in batches:
        for story, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            words = text.replace(_MARK, f" {_MARK}").split()
            if words and words[-1] == _MARK:  # marks at the end
                words.pop()
            if not words:
                continue
            if not text[0].isspace() and text[0] != _MARK:
                words[0] = _MARK + words[0]
            held.append((story, np.fromiter(map(codes.__getitem__, words), np.int32, len(words))))
            waiting += len(words)
            if waiting >= STRETCH:
                yield from sorted_ones()
                waiting = 0
    if held:
        yield from sorted_ones()


def _sorted_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of several stretches in the order of longer ones."""
    held: list[pa.RecordBatch] = []

    def sorted_ones() -> Iterator[pa.RecordBatch]:
        stories, words, places = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        held.clear()
        coded = words.dictionary_encode()
        yield from _in_order(stories.to_numpy(), coded.indices.to_numpy(), places.to_numpy(), coded.dictionary.to_pylist())

    waiting = 0
    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        if waiting >= STRETCH:
            yield from sorted_ones()
            waiting = 0
    if waiting:
        yield from sorted_ones()


class _Leaf(NamedTuple):
    words: tuple[str, ...]
    prefix: bool = False
    near: int = -1  #: words that may stand between; -1: a phrase


class _Plan:
    """What a query's tree asks of the index: its leaves, their words, and the predicate over a story's places."""

    def __init__(self, node: Node, exact: bool):
        self.exact, self.leaves = exact, []
        self.test = self._of(node)
        self.words = sorted({(w, leaf.prefix) for leaf in self.leaves for w in leaf.words})

    def _leaf(self, leaf: _Leaf):
        self.leaves.append(leaf)
        return lambda found: found(leaf)

    def _of(self, n: Node):
        if n.op in ("and", "or"):
            parts = [self._of(a) for a in n.args if a.op != "noop"]

            def joined(found):
                out = parts[0](found)
                for p in parts[1:]:
                    out = out & p(found) if n.op == "and" else out | p(found)
                return out

            return joined
        if n.op == "not":
            inner = self._of(n.args[0])
            return lambda found: ~inner(found)
        if n.op == "field":
            return self._of(n.args[1])
        if n.op == "term":
            parts = re.findall(r"\w+", n.args[0])
            if not parts:
                raise QueryError(f"no word in {n.args[0]}")
            return self._leaf(_Leaf(tuple(parts), (n.args[1] or not self.exact) and len(parts) == 1))
        if n.op == "near":
            return self._leaf(_Leaf(n.args, not self.exact, n.distance))
        return self._leaf(_Leaf(n.args, not self.exact and len(n.args) == 1))

    def wanted(self) -> Column:
        """Which postings the search reads: equal words and beginnings, which are pushed to the scan."""
        out = F.lit(False)
        for w, prefix in self.words:
            out = out | (F.col("word").startswith(w) if prefix else F.col("word") == w)
        return out

    def places(self) -> list[Column]:
        """For each word an aggregate: the story's places of it."""
        own = lambda w, prefix: F.col("word").startswith(w) if prefix else F.col("word") == w
        return [F.collect_list(F.when(own(*w), F.col("place"))).alias(f"w{k}") for k, w in enumerate(self.words)]

    def holds(self) -> Column:
        at = {w: F.coalesce(F.col(f"w{k}"), F.array().cast("array<int>")) for k, w in enumerate(self.words)}
        number = lambda p: F.shiftright(p, 1)

        def found(leaf: _Leaf) -> Column:
            own = [at[w, leaf.prefix] for w in leaf.words]
            if leaf.near >= 0:
                every = F.forall(F.array(*(F.size(o) > 0 for o in own)), lambda x: x)
                if not self.exact:  # the plain language asks for all words, at any distance
                    return every
                reach = len(leaf.words) + leaf.near
                inside = lambda p: F.forall(F.array(*own), lambda o: F.exists(o, lambda q: (number(q) >= number(p)) & (number(q) < number(p) + reach)))
                return every & F.exists(F.flatten(F.array(*own)), inside)
            if len(own) == 1:
                return F.size(own[0]) > 0
            # after its first word, a word of a phrase stands next and behind white space
            follows = lambda p: F.forall(F.transform(F.array(*own[1:]), lambda o, i: F.array_contains(o, p - p % 2 + 2 * (i + 1) + 1)), lambda x: x)
            return F.exists(own[0], follows)

        return self.test(found)

    def true_of_nothing(self) -> bool:
        class _Bit(NamedTuple):
            v: bool

            def __and__(self, o):
                return _Bit(self.v and o.v)

            def __or__(self, o):
                return _Bit(self.v or o.v)

            def __invert__(self):
                return _Bit(not self.v)

        return self.test(lambda leaf: _Bit(False)).v


class SearchIndex:
    """The index in a shared folder. ``SearchIndex(spark)`` makes a new one, with ``path`` it goes on from the last manifest there."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan: int = FAN):
        self.spark, self.fan, self.runs, self.batches, self.version = spark, fan, [], set(), 0
        self.path = path or table_path(spark, "index")
        if path:
            rows = spark.read.parquet(f"{self.path}/manifest")
            self.version = rows.agg(F.max("version")).first()[0]
            last = rows.filter(F.col("version") == self.version).collect()
            self.runs = sorted(Run(r.number, r.level, r.postings, r.touched) for r in last if r.postings)
            self.batches = {b for r in last for b in r.batches}

    def _save(self) -> None:
        """Append a manifest; runs are complete when it names them, so a job that is lost before leaves the index as it was."""
        self.version += 1
        rows = [(*r, sorted(self.batches), self.version) for r in self.runs]
        schema = "number int, level int, postings string, touched string, batches array<long>, version int"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _write(self, postings: list[DataFrame], touched: str, number: int, level: int) -> Run:
        run = Run(number, level, table_path(self.spark, "postings"), touched)
        for part in postings:
            part.write.mode("append").options(**_PACKED).parquet(run.postings)
        return run

    def _write_touched(self, touched: DataFrame) -> str:
        path = table_path(self.spark, "touched")
        touched.write.parquet(path)
        return path

    def _newest(self, rows: DataFrame, touched: str) -> DataFrame:
        """``stories_id, text`` of the newest rows of a batch that do not delete.

        A text stays where it is: older rows are told by what repeats, which is broadcast. Texts are grouped by
        their story only if very many stories repeat, or newest rows share their ``changed`` (the greatest text counts).
        """
        repeated = self.spark.read.parquet(touched).filter("rows > 1")
        seen = repeated.agg(F.count(F.lit(1)).alias("stories"), F.count_if(F.col("tied") & ~F.col("deleted")).alias("ties")).first()
        if seen.stories == 0:
            return rows.filter("not deleted").select("stories_id", "text")
        if seen.ties == 0 and seen.stories <= HELD:
            last = F.broadcast(repeated.select(F.col("stories_id").alias("_id"), F.col("changed").alias("_changed"), F.col("deleted").alias("_deleted")))
            found = rows.join(last, F.col("stories_id") == F.col("_id"), "left")
            newest = F.col("_id").isNull() | (F.col("changed").eqNullSafe(F.col("_changed")) & ~F.col("_deleted"))
            return found.filter(~F.col("deleted") & newest).select("stories_id", "text")
        last = rows.groupBy("stories_id").agg(F.max(F.struct("changed", "deleted", "text")).alias("d"))
        return last.select("stories_id", "d.text", "d.deleted").filter("not deleted")

    def add(self, changes: DataFrame, batch: int | None = None) -> None:
        """Index a batch ``stories_id, text[, deleted][, changed]``; the newest row by ``changed`` counts for a story.

        A null text holds no word. Rows without an id are left out. With a ``batch`` number, one that has been
        added already changes nothing, so a stream may redo its batches.
        """
        if batch is not None and batch in self.batches:
            return
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in changes.columns else F.lit(False)
        changed = F.col("changed") if "changed" in changes.columns else F.lit(0)
        rows = changes.filter("stories_id is not null").select("stories_id", F.coalesce("text", F.lit("")).alias("text"), deleted.alias("deleted"), changed.alias("changed"))
        # without the texts: the newest change of a story, whether others are as new, and how many rows it has
        each = rows.groupBy("stories_id", "changed", "deleted").agg(F.count(F.lit(1)).alias("n"))
        last = each.groupBy("stories_id").agg(F.max(F.struct("changed", "deleted", "n")).alias("d"), F.sum("n").alias("rows"))
        touched = self._write_touched(last.select("stories_id", "d.changed", "d.deleted", (F.col("d.n") > 1).alias("tied"), "rows"))
        number = max([r.number for r in self.runs], default=0) + 1
        self.runs.append(self._write([words_with_places(self._newest(rows, touched))], touched, number, 0))
        if batch is not None:
            self.batches.add(batch)
        self._merge()
        self._save()

    def _live(self, runs: list[Run], postings: DataFrame) -> DataFrame:
        """Of postings with their ``run``, those of the newest run that touches their story."""
        if len(runs) == 1:
            return postings
        newest = self._touched(runs).groupBy("stories_id").agg(F.max("run").alias("run"))
        return postings.join(newest, ["stories_id", "run"], "left_semi")

    def _merged(self, runs: list[Run]) -> list[DataFrame]:
        """The postings that stay when runs are merged, in one part or several.

        What newer runs hide is broadcast, so no posting is shuffled. Each HELD hidden stories are a part of their own,
        which reads the runs once more, until PASSES of them would cost more than a join.
        """
        each = self._touched(runs).groupBy("stories_id").agg(F.collect_list("run").alias("runs")).filter("size(runs) > 1")
        hidden = materialize(each.select("stories_id", F.explode(F.filter("runs", lambda r: r < F.array_max("runs"))).alias("run")), "hidden")
        parts = -(-rows_and_sum(hidden)[0] // HELD) or 1
        if parts > PASSES:
            live = [self._live(runs, self._postings(runs, F.lit(True)))]
        else:
            own = lambda df, k: df.filter(F.pmod(F.xxhash64("stories_id"), F.lit(parts)) == k) if parts > 1 else df
            of = lambda r, k: F.broadcast(own(hidden.filter(F.col("run") == r.number).select("stories_id"), k))
            live = [_union([own(self._postings([r], F.lit(True)), k).join(of(r, k), "stories_id", "left_anti") for r in runs]) for k in range(parts)]
        return [part.select("stories_id", "word", "place").mapInArrow(_sorted_again, "stories_id long, word string, place int") for part in live]

    def _touched(self, runs: list[Run]) -> DataFrame:
        out = [self.spark.read.schema("stories_id long, deleted boolean").parquet(r.touched).withColumn("run", F.lit(r.number)) for r in runs]
        return _union(out)

    def _postings(self, runs: list[Run], wanted: Column) -> DataFrame:
        out = [self.spark.read.schema("stories_id long, word string, place int").parquet(r.postings).filter(wanted).withColumn("run", F.lit(r.number)) for r in runs]
        return _union(out)

    def _merge(self) -> None:
        while True:
            by_level: dict[int, list[Run]] = {}
            for r in self.runs:
                by_level.setdefault(r.level, []).append(r)
            full = next((sorted(rs) for _, rs in sorted(by_level.items()) if len(rs) >= self.fan), None)
            if full is None:
                return
            touched = self._touched(full).groupBy("stories_id").agg(F.max_by("deleted", "run").alias("deleted"))
            if full[0].number == min(r.number for r in self.runs):  # nothing older is left to hide
                touched = touched.filter("not deleted")
            merged = self._write(self._merged(full), self._write_touched(touched), full[-1].number, full[0].level + 1)
            self.runs = sorted([r for r in self.runs if r not in full] + [merged])

    def search(self, query: str, exact: bool = True) -> DataFrame:
        """``stories_id`` of the stories whose text matches; other fields of the query are left out.

        By default words are whole unless they have a star, and distances count (``exact``). A term of several
        words with marks between, such as ``well-known``, asks for them side by side behind white space.
        """
        plan = _Plan(text_part(query), exact)
        if not self.runs:
            return self.spark.createDataFrame([], "stories_id long")
        hits = self._live(self.runs, self._postings(self.runs, plan.wanted()))
        places = hits.groupBy("stories_id").agg(*plan.places())
        if plan.true_of_nothing():
            alive = self._touched(self.runs).groupBy("stories_id").agg(F.max_by("deleted", "run").alias("deleted")).filter("not deleted").select("stories_id")
            places = alive.join(places, "stories_id", "left")
        return places.filter(plan.holds()).select("stories_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
