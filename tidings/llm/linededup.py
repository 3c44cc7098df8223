"""Line deduplication over levelled sorted runs of line hashes.

The index is a list of levels; each level holds a few runs, each run a table of line
hashes with document counts, dealt into buckets and sorted by hash. A new batch of lines
is counted and merge-anti-joined run by run with the lines that are settled (known to be
frequent, which need no more counting), and its own counts become a run of level 0. A
level that is full is merged into one run of the next.
"""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import KEY, add_columns, text_key
from tidings.operators.storage import discard, materialize, materialize_sorted

#: A level with more runs than this is merged into one run of the next level.
FANOUT = 3
#: Batches that a whole table is dealt into.
BATCHES = 4


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z lower-cased: what the two bytes methods do."""
    return line.strip().lower()


def _hash(key: bytes) -> tuple[int, int]:
    """96 bits: the chance that any two of 10^12 lines meet is about 10^-5."""
    h = xxhash.xxh3_128_intdigest(key)
    return (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), (h >> 64 & 0xFFFFFFFF) - (1 << 31)


class LineIndex:
    """Levelled runs of ``h, g, n, seen``: a line's hash, its documents in the run, and in all batches up to the run's last.

    ``settle`` is the count from which a line is settled. Runs are dealt out and sorted by hash alike, so a
    batch meets each of them in a merge join that moves and regroups none of the runs.
    """

    def __init__(self, spark: SparkSession, settle: int):
        self.spark, self.settle, self.levels = spark, settle, []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def counts(self) -> DataFrame | None:
        """All runs merged: one row ``h, g, n`` per line hash."""
        return _merged(self.runs()).drop("seen") if self.runs() else None

    def settled(self) -> DataFrame | None:
        """``h, g`` of settled lines. No batch counts a settled line again, so only one run holds it as such."""
        known = [run.filter(F.col("seen") >= self.settle).select("h", "g") for run in self.runs()]
        return reduce(DataFrame.union, known) if known else None

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` (with ``h, g``) that no run has."""
        for run in self.runs():
            lines = lines.join(run.select("h", "g").hint("merge"), ["h", "g"], "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Add a batch: one row of ``h, g`` for each line of each document, a line once a document.

        Level by level the batch is merge-joined with the runs; a line that one has settled goes (the
        anti-join), any other takes along how often it was seen.
        """
        own = lines.groupBy("h", "g").agg(F.count("*").alias("n")).withColumn("seen", F.lit(0).cast("long"))
        for run in self.runs():
            before = run.select("h", "g", F.col("seen").alias("before")).hint("merge")
            own = own.join(before, ["h", "g"], "left").filter(F.col("before").isNull() | (F.col("before") < self.settle))
            own = own.select("h", "g", "n", F.greatest("seen", "before").alias("seen"))
        self._push(0, own.withColumn("seen", F.col("seen") + F.col("n")))

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(materialize_sorted(run, f"run{level}", ["h", "g"]))
        if len(self.levels[level]) > FANOUT:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, _merged(full))
            for old in full:
                discard(old)

    def drop(self) -> None:
        """Delete the runs."""
        for run in self.runs():
            discard(run)
        self.levels = []


def _merged(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, runs).groupBy("h", "g").agg(F.sum("n").alias("n"), F.max("seen").alias("seen"))


def dedup_lines(df: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Drop each line whose key is found in at least ``min_docs`` documents; the others stay, joined by newlines.

    Returns all columns with the text replaced, and ``n_lines, n_dropped``. Each row is a document,
    whatever its id, so null and repeated ids and repeated rows need no rule of their own. A null text
    counts as empty: one empty line. Keys shorter than ``min_chars`` code points are never dropped, so
    blank lines stay with the default. Very long texts and lines are read whole, in slices of rows of bounded
    bytes. An empty table gives an empty table. Columns of the input named ``n_lines`` or ``n_dropped`` are
    replaced.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = df.select(*text_key(text), F.pmod(F.xxhash64(text), F.lit(batches)).cast("int").alias("batch"), text.alias("text"))

    def keys(batch: list) -> dict:
        out = []
        for t in batch:
            found = {line_key(line) for line in t.encode().split(b"\n")}
            out.append([dict(zip("hg", _hash(k))) for k in found if k and (min_chars <= 1 or len(k.decode()) >= min_chars)])
        return {"lines": out}

    hashed = add_columns(source, ["text"], keys, "lines array<struct<h: long, g: int>>").drop("text")
    hashed = materialize(hashed, "lines", ["batch"])
    index = LineIndex(spark, min_docs)
    for k in range(batches):
        index.add(hashed.filter(F.col("batch") == k).select(F.inline("lines")))
    frequent = materialize(index.settled(), "frequent")
    index.drop()
    hits = hashed.select(*KEY, F.inline("lines")).join(frequent, ["h", "g"], "left_semi")
    # a table of its own, so that both sides of the join below are plain exchanges that can be split where many copies meet
    drops = materialize(hits.groupBy(*KEY).agg(F.collect_set(F.struct("h", "g")).alias("_tidings_drop")), "drops")

    def cut(batch: list, drop: list) -> dict:
        texts, n_lines, n_dropped = [], [], []
        for t, out in zip(batch, drop):
            lines = (t or "").encode().split(b"\n")
            n_lines.append(len(lines))
            if out:
                gone = {(d["h"], d["g"]) for d in out}
                kept = [x for x in lines if not (k := line_key(x)) or _hash(k) not in gone]
                n_dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept).decode())
            else:
                n_dropped.append(0)
                texts.append(t or "")
        return {text_col: texts, "n_lines": n_lines, "n_dropped": n_dropped}

    joined = df.select("*", *text_key(text)).join(drops, KEY, "left")
    order = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    done = add_columns(joined, [text_col, "_tidings_drop"], cut, f"`{text_col}` string, n_lines long, n_dropped long")
    return done.select(*order, "n_lines", "n_dropped")


def digests(cleaned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return cleaned.select(id_col, "n_lines", "n_dropped", F.sha2(F.encode(text_col, "UTF-8"), 256).alias("kept_sha256"))
