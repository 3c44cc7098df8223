"""Packing of tokenised documents into windows by non-negative least squares over a histogram of lengths.

A document gives full windows and a rest. Lengths are counted in units (UNITS of them make a window);
shallow combinations of unit lengths that can fill a window are enumerated, and least squares finds how
often each is repeated so that together they use up the histogram. The rounded repeats are made exact
from the histogram of true lengths, and what is left over is packed greedily. One rest in FILLERS is cut
into powers of two, which fill the gaps; so is what would stay in sequences with a wide gap, as powers of
two fill windows of their own.

All of this sees the histogram only, whose size is the window's. A piece gets its place by arithmetic:
its number among the pieces of its length tells which repeat of which pattern it belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidings.llm.bpe import WORDS, PrefixEncoder, load_tokenizer
from tidings.llm.common import _slices, texts
from tidings.operators.storage import materialize

#: Units of a window, and pieces of a combination at most.
UNITS, DEPTH = 64, 4
#: One rest in so many, in the order of lengths, is cut into powers of two.
FILLERS = 16
#: Part of a window that may stay open; wider gaps are avoided by cutting.
OPEN = 32


class Encoder:
    """Token ids of texts, by a fast library; a text on which its pattern gives up goes by the trie encoder."""

    def __init__(self, spec: dict):
        import tiktoken

        merged = [spec["vocab"][a + b] for a, b in spec["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids do not follow the order of the merges")
        self.spec, self.slow, self.special = spec, None, set(spec["added"])
        self.fast = tiktoken.Encoding("public", pat_str=WORDS, mergeable_ranks=spec["vocab"], special_tokens=spec["added"])

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.special)
        except ValueError:  # runs of very many white spaces
            self.slow = self.slow or PrefixEncoder(self.spec)
            return np.frombuffer(self.slow.encode_batch([text])[0], dtype="<u4")


_ENCODERS: dict[int, Encoder] = {}


def powers(length: int) -> list[int]:
    """The powers of two that ``length`` is the sum of, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str, text_col: str, ids: bool) -> DataFrame:
    """One row for each full window and rest; ``part`` and ``k`` number those of one length, ``cuts`` has the digests of a rest's powers of two."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_tokenizer(spark, tokenizer_path))
    key = shared._jbroadcast.id()
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, cuts array<long>, part int, k long" + ", ids array<int>" * ids
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shared.value)
        encode, part = _ENCODERS[key], TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for some in _slices(batch, 512):
                out = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    found = np.append(encode(text), end_id).astype("<u4")
                    for start in range(0, len(found), window):
                        own = found[start : start + window]
                        n, at, cuts = len(own), 0, []
                        for size in powers(n) if n < window else ():
                            cuts.append(crc32(own[at : at + size].tobytes()))
                            at += size
                        k = seen[n] = seen.get(n, -1) + 1
                        out.append((doc_id, start, n, crc32(own.tobytes()), len(found), cuts, part, k) + ((own,) if ids else ()))
                cols = zip(*out) if out else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def combinations(units: int = UNITS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Unit lengths, at most ``depth`` of them, whose pieces can add up to a window: a piece of u units has over u - 1 and at most u."""
    out = []
    for n in range(1, depth + 1):
        for head in combinations_with_replacement(range(1, units + 1), n - 1):
            low = units - sum(head)
            out += [(*head, last) for last in range(max(low, head[-1] if head else 1), low + n) if last <= units]
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``x >= 0`` with the least ``|a x - b|``, by the active-set method: at most as many entries are not 0 as ``b`` has."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * len(b)):
        slope = np.where(used, -np.inf, a.T @ (b - a @ x))
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            y = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (y > 0).all():
                x[:] = 0
                x[at] = y
                break
            down = y <= 0
            step = (x[at][down] / np.maximum(x[at][down] - y[down], 1e-300)).min()
            x[at] += step * (y - x[at])
            used[at[x[at] <= 1e-12 * max(1.0, np.abs(b).max())]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


class Plan:
    """Patterns for a histogram of lengths, and the places that they give to the pieces of each.

    A bin is a length, or a negative power of two: a piece of that size cut from a rest. ``places`` has, for
    each bin, from which number on its pieces go where: to a first sequence and an offset there, so many in
    each, or (sequence -1 - c) to the cut ``c``, whose ``cuts`` say which number the powers begin with.
    """

    def __init__(self, counts: dict[int, int], window: int):
        self.window, self.sequences, self.places, self.cuts, self.taken = window, 0, {}, [], {}
        self.whole, self.fill, self.made = np.zeros(window + 1, np.int64), np.zeros(window + 1, np.int64), np.zeros(window + 1, np.int64)
        for n, many in counts.items():
            self.whole[n] = many
        if full := int(self.whole[window]):
            self._emit({window: 1}, full)
        self.whole[window] = 0
        share = np.cumsum(self.whole) // FILLERS
        for n in np.flatnonzero(np.diff(share, prepend=0)).tolist():
            self.whole[n] -= (many := int(share[n] - share[n - 1]))
            self._cut(n, many)
        self._solve()
        while self.whole.any():
            slots, most, gap = self._fit(self.window, self.whole, 1)
            self._take(slots, most)
            self.open.append((gap, most, slots))
        self._close(self.window // OPEN)
        self._close(self.window)
        self._powers()
        self.places = {name: tuple(np.array(c, np.int64) for c in zip(*rows)) for name, rows in self.places.items()}
        self.cuts = np.array(self.cuts, np.int64).reshape(-1, self.window.bit_length())

    def _next(self, name: int, many: int) -> int:
        first = self.taken.get(name, 0)
        self.taken[name] = first + many
        return first

    def _emit(self, slots: dict[int, int], repeats: int) -> None:
        offset = 0
        for name, many in slots.items():
            self.places.setdefault(name, []).append((self._next(name, many * repeats), self.sequences, offset, many))
            offset += many * abs(name)
        self.sequences += repeats

    def _cut(self, n: int, many: int) -> None:
        """The next ``many`` pieces of length ``n`` become powers of two."""
        self.places.setdefault(n, []).append((self._next(n, many), -1 - len(self.cuts), 0, 1))
        self.cuts.append([int(self.made[1 << b]) for b in range(self.window.bit_length())])
        self.made[powers(n)] += many
        self.fill[powers(n)] += many

    def _solve(self) -> None:
        """Repeats of the combinations, made of true lengths: of those there are, the ones that fill a window best."""
        self.open: list[tuple[int, int, dict[int, int]]] = []  # gap, repeats, how many of each bin
        unit = -(-self.window // UNITS)
        size = -(-np.arange(self.window + 1) // unit)
        have = np.bincount(size, weights=self.whole, minlength=UNITS + 1)[1:]
        ways = [c for c in combinations() if have[[u - 1 for u in c]].all()]
        if not ways:
            return
        a = np.zeros((UNITS, len(ways)))
        for k, c in enumerate(ways):
            np.add.at(a[:, k], [u - 1 for u in c], 1)
        weight = np.arange(1, UNITS + 1) / UNITS  # what is left over costs by its length
        repeats = np.rint(non_negative_least_squares(a * weight[:, None], have * weight))
        for k in np.argsort(-repeats, kind="stable"):
            left = int(repeats[k])
            while left > 0 and (found := self._lengths(ways[k], unit)):
                slots, most, gap = found
                most = min(most, left)
                self._take(slots, most)
                left -= most
                self.open.append((gap, most, slots))

    def _lengths(self, way: tuple[int, ...], unit: int) -> tuple[dict[int, int], int, int] | None:
        there = [u * unit - unit + 1 + np.flatnonzero(self.whole[u * unit - unit + 1 : u * unit + 1]) for u in way]
        if not all(map(len, there)):
            return None
        total = sum(x.reshape([-1 if i == k else 1 for i in range(len(way))]) for k, x in enumerate(there))
        gap = np.where(total <= self.window, self.window - total, self.window).ravel()
        for at in self._least(gap):
            if gap[at] == self.window:
                return None
            where = np.unravel_index(at, total.shape)
            lengths, many = np.unique([x[i] for x, i in zip(there, where)], return_counts=True)
            if most := int((self.whole[lengths] // many).min()):
                return dict(zip(lengths[::-1].tolist(), many[::-1].tolist())), most, int(gap[at])
        return None

    @staticmethod
    def _least(gap: np.ndarray) -> Iterator[int]:
        """Places in order of their gaps; all but a few are only sorted if those few will not do."""
        few = np.argpartition(gap, 31)[:32] if len(gap) > 32 else np.arange(len(gap))
        yield from few[np.lexsort((few, gap[few]))]
        yield from np.argsort(gap, kind="stable")

    def _take(self, slots: dict[int, int], repeats: int) -> None:
        for name, many in slots.items():
            (self.fill if name < 0 else self.whole)[abs(name)] -= many * repeats

    @staticmethod
    def _fit(gap: int, counts: np.ndarray, sign: int) -> tuple[dict[int, int], int, int]:
        """Pieces for a gap, the largest first; how often there are so many; what stays open."""
        slots, most, n = {}, 0, gap + 1
        while len(below := np.flatnonzero(counts[: min(gap + 1, n)])) and below[-1]:
            n = int(below[-1])
            many = min(gap // n, int(counts[n]))
            slots[sign * n] = many
            gap -= n * many
            most = min(most or int(counts[n]), int(counts[n]) // many)
        return slots, most, gap

    def _close(self, widest: int) -> None:
        """Fill the gaps, the least first. What then has a gap wider than ``widest`` is cut; without any wider than that, all is emitted."""
        todo, self.open, final = sorted(self.open, key=lambda p: p[0]), [], widest >= self.window
        for gap, repeats, slots in todo:
            while repeats:
                more, most, left = self._fit(gap, self.fill, -1)
                most = min(most or repeats, repeats)
                self._take(more, most)
                repeats -= most
                merged = dict(slots)
                for name, many in more.items():
                    merged[name] = merged.get(name, 0) + many
                length = self.window - left
                if not final and left > widest and length & (length - 1):
                    for name, many in merged.items():
                        if name > 0:
                            self._cut(name, many * most)
                        else:
                            self.fill[-name] += many * most
                elif final:
                    self._emit(merged, most)
                else:
                    self.open.append((left, most, merged))

    def _powers(self) -> None:
        """Powers of two that no gap needed: whole windows of them, and at last sequences of a power of two each."""
        room = self.window
        while room:
            slots, most, gap = self._fit(room, self.fill, -1)
            if gap:
                room //= 2
            else:
                self._take(slots, most)
                self._emit(slots, most)

    def place(self, names: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these bins and numbers; for pieces to be cut, -1 - the cut and their number in it."""
        sequence, offset = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        for name in np.unique(names):
            rows = np.flatnonzero(names == name)
            first, base, at, many = self.places[int(name)]
            slot = np.searchsorted(first, ranks[rows], side="right") - 1
            within = ranks[rows] - first[slot]
            whole = base[slot] >= 0
            repeat, nth = np.divmod(within, many[slot])
            sequence[rows] = np.where(whole, base[slot] + repeat, base[slot])
            offset[rows] = np.where(whole, at[slot] + nth * abs(int(name)), within)
        return sequence, offset

    def pieces(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each piece its row, its start in that row's, its length, its place among the row's cuts (-1: all of it), sequence and offset."""
        sequence, offset = self.place(lengths, ranks)
        rows = np.flatnonzero(sequence >= 0)
        nothing = np.zeros(len(rows), np.int64)
        found = [(rows, nothing, lengths[rows], nothing - 1, sequence[rows], offset[rows])]
        cut = np.flatnonzero(sequence < 0)
        start, nth = np.zeros(len(cut), np.int64), np.zeros(len(cut), np.int64)
        for b in range(self.window.bit_length() - 1, -1, -1):
            has = np.flatnonzero(lengths[cut] >> b & 1)
            rows, size = cut[has], np.full(len(has), 1 << b)
            if len(has):
                found.append((rows, start[has], size, nth[has], *self.place(-size, self.cuts[-1 - sequence[rows], b] + offset[rows])))
            start[has] += 1 << b
            nth[has] += 1
        out = tuple(np.concatenate(c) for c in zip(*found))
        order = np.lexsort((out[1], out[0]))
        return tuple(c[order] for c in out)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for each piece, with ``ids`` also its token ids.

    ``window`` is a power of two. Every token of every text, and ``end_id`` after it, lies in one piece; a
    sequence has at most ``window`` tokens, without gaps from offset 0. Only sequences whose length is no power
    of two need padding, of 1 / OPEN of the window at most. A null text counts as empty (one token); null and repeated ids and repeated rows are
    documents each; a very long text is cut into windows like any other, and ties in length are told apart by
    the order in which a task reads them. An empty table gives no rows. Columns other than the two named are
    not read.
    """
    if window < 64 or window & (window - 1):
        raise ValueError("the window must be a power of two, 64 at least")
    spark = docs.sparkSession
    pieces = materialize(cut_documents(docs, tokenizer_path, window, end_id, id_col, text_col, ids), "pieces")
    many = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    # one row for each length
    shared = spark.sparkContext.broadcast(Plan({r.length: r.n for r in many.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = many.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("k")).drop("first", "k", "part")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            row, at, length, nth, sequence, offset = shared.value.pieces(col("length").to_numpy().astype(np.int64), col("rank").to_numpy())
            cuts = col("cuts")
            crc, parts, ends = col("ids_crc32").to_numpy()[row], cuts.values.to_numpy(), cuts.offsets.to_numpy()
            cut = np.flatnonzero(nth >= 0)
            crc[cut] = parts[ends[row[cut]] + nth[cut]]
            out = [col("doc_id").take(pa.array(row)), pa.array(col("start").to_numpy()[row] + at), *map(pa.array, (length, crc, col("doc_tokens").to_numpy()[row], sequence, offset))]
            if ids:
                values, begin = col("ids").values.to_numpy(), col("ids").offsets.to_numpy()[row] + at
                out.append(pa.array([values[a : a + n] for a, n in zip(begin, length)], type=arrow.field("ids").type))
            yield pa.RecordBatch.from_arrays(out, schema=arrow)

    return ranked.mapInArrow(run, schema)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids, starts``: the padded token ids of each sequence, and where its pieces begin; from ``pack_documents(..., ids=True)``."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids, n = F.flatten("p.ids"), F.size(F.flatten("p.ids"))
    power = F.bit_count(n) == 1
    return rows.select("sequence_id", F.when(power, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(window) - n))).alias("ids"), F.col("p.offset").alias("starts"))
