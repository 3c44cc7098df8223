"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last WINDOW bytes sets chunk borders, so an insertion moves
only the borders near it. Chunks are compared by digest. Chunks in a row that are found
elsewhere too are a run; what stands beside its ends is compared with what stands beside the
same chunks elsewhere, which moves the ends to the true edges of the passage. It counts
when it has LEAST_WORDS words or more; a character of a script without spaces counts as a word.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import add_columns, texts
from tidings.operators.storage import materialize

#: Bytes that decide on a border, least bytes of a chunk, mean bytes from there to the next border, most bytes of a chunk.
WINDOW, LEAST, GAP, MOST = 16, 16, 24, 256
#: Words of a repeated passage, and words that its whole chunks must cover to be looked at.
LEAST_WORDS, LEAST_INNER = 50, 6
#: Code points beside a run that are compared: more than a chunk has.
BESIDE = 300

_gear = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def borders(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a UTF-8 text; never inside a character."""
    size = len(data)
    if not size:
        return []
    h = _gear[data]
    for k in (1, 2, 4, 8):  # sums over 2, 4, 8, 16 bytes; each older byte is shifted by one more bit
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    whole = np.empty(size, bool)
    whole[:-1], whole[-1] = (data[1:] & 0xC0) != 0x80, True
    found = np.flatnonzero((h < np.uint32((1 << 32) // GAP)) & whole) + 1
    out, last = [], 0
    for at in found.tolist():
        while at - last > MOST:
            last += MOST
            while not whole[last - 1]:
                last -= 1
            out.append(last)
        if at - last >= LEAST:
            out.append(at)
            last = at
    while size - last > MOST:
        last += MOST
        while not whole[last - 1]:
            last -= 1
        out.append(last)
    if last < size:
        out.append(size)
    return out


#: Scripts that put no space between words (Thai and Lao; Burmese; Khmer; kana; Han and Yi; Han forms; rarer Han), by the first two bytes in UTF-8.
UNSPACED = [(0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE381, 0xE383), (0xE390, 0xEA93), (0xEFA4, 0xEFAB), (0xF0A0, 0xF0BF)]


def _begins(data: np.ndarray) -> np.ndarray:
    """Where words begin in UTF-8 bytes: after white space, and at each character of a script that puts none between words."""
    letter = (data != 32) & ((data < 9) | (data > 13))
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    if len(data) > 1 and (data >= 0xE0).any():
        pair = data[:-1].astype(np.int32) << 8 | data[1:]
        for low, high in UNSPACED:
            begins[:-1] |= (pair >= low) & (pair <= high)
    return begins


def _words_begun(text: str) -> int:
    return int(_begins(np.frombuffer(text.encode(), np.uint8)).sum())


def _chunked(docs: DataFrame) -> DataFrame:
    """``doc_id, k, h, ends, words``: for each chunk of a text its digest, its end in code points, and the words begun up to there."""

    def per_batch(batch: list) -> dict:
        out = {"h": [], "ends": [], "words": []}
        for text in batch:
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            ends = borders(data)
            starts = [0, *ends[:-1]] if ends else []
            out["h"].append([xxhash.xxh3_64_intdigest(raw[a:b]) - (1 << 63) for a, b in zip(starts, ends)])
            at = np.array(ends, np.int64)
            out["ends"].append(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at].astype(np.int32))
            out["words"].append(np.concatenate([[0], np.cumsum(_begins(data))])[at].astype(np.int32))
        return out

    return add_columns(docs, ["text"], per_batch, "h array<long>, ends array<int>, words array<int>", 128, drop=["text"])


def _runs(start: np.ndarray, end: np.ndarray, kept: np.ndarray, od: np.ndarray, ok: np.ndarray, ostart: np.ndarray, oend: np.ndarray, ends: np.ndarray, words: np.ndarray) -> list[dict]:
    """Runs of hit chunks of one text, cut where kept and dropped ones meet; with the places elsewhere of both ends."""
    order = np.argsort(start)
    start, end, kept, od, ok, ostart, oend = (x[order] for x in (start, end, kept, od, ok, ostart, oend))
    cut = np.flatnonzero((start[1:] != end[:-1]) | (kept[1:] != kept[:-1])) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]]) - 1
    begun = np.concatenate([[0], words])[np.searchsorted(ends, np.stack([start[lo], end[hi]])) + (np.stack([start[lo], end[hi]]) > 0)]
    n = begun[1] - begun[0]
    out = []
    for i in np.flatnonzero(n >= LEAST_INNER).tolist():
        a, b = lo[i], hi[i]
        left, right = {"od": int(od[a]), "ok": int(ok[a]), "oat": int(ostart[a])}, {"od": int(od[b]), "ok": int(ok[b]), "oat": int(oend[b])}
        out.append({"start": int(start[a]), "end": int(end[b]), "n_words": int(n[i]), "dropped": not kept[a], "left": left, "right": right})
    return out


def _common(own: str, other: str, side: int) -> int:
    """Code points that two neighbourhoods share from the run's end on."""
    if side == 0:
        own, other = own[::-1], other[::-1]
    n = min(len(own), len(other))
    if own[:n] == other[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:  # the longest common prefix by halving
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if own[:mid] == other[:mid] else (lo, mid - 1)
    return lo


def _apart(spans: list[dict], least_words: int) -> list[dict]:
    """Spans of one text that do not overlap: dropped ones go first, then longer ones; a rest counts by its share of the words."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (not s["dropped"], s["start"] - s["end"], s["start"])):
        rests = [(s["start"], s["end"])]
        for o in out:
            rests = [(a, b) for lo, hi in rests for a, b in ((lo, min(hi, o["start"])), (max(lo, o["end"]), hi)) if a < b]
        whole = s["end"] - s["start"]
        for a, b in rests:
            n = s["n_words"] if b - a == whole else s["n_words"] * (b - a) // whole
            # what is left of a place that goes anyway goes too, however short
            if n >= least_words or s["dropped"]:
                out.append({**s, "start": a, "end": b, "n_words": n})
    return out


def _extended(ends: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, k, start, side, more, more_words``: how far each end of a run goes on as it does elsewhere.

    ``ends``: doc_id, k, start, side (0 left, 1 right), at, and od, ok, oat for the place elsewhere. Each text
    that holds an end or its partner is read once and gives BESIDE code points for each.
    """
    here = ends.select("doc_id", "k", "at", "side").union(ends.select("od", "ok", "oat", "side"))
    wanted = here.groupBy("doc_id", "k").agg(F.collect_set(F.struct("at", "side")).alias("wanted"))

    def cut(batch: list, wanted: list) -> dict:
        out = []
        for t, own in zip(batch, wanted):
            out.append([{**w, "lead": t[max(0, w["at"] - 1) : w["at"]], "s": t[w["at"] : w["at"] + BESIDE] if w["side"] else t[max(0, w["at"] - BESIDE) : w["at"]]} for w in own])
        return {"found": out}

    found = add_columns(docs.join(wanted, ["doc_id", "k"]), ["text", "wanted"], cut, "found array<struct<at: int, side: int, lead: string, s: string>>", 128, drop=["text", "wanted"])
    beside = materialize(found.select("doc_id", "k", F.inline("found")).distinct(), "beside")
    other = beside.select(F.col("doc_id").alias("od"), F.col("k").alias("ok"), F.col("at").alias("oat"), "side", F.col("s").alias("other"))
    rows = ends.join(other, ["od", "ok", "oat", "side"]).select("doc_id", "k", "start", "at", "side", "other").join(beside, ["doc_id", "k", "at", "side"])

    def compare(side: list, lead: list, own: list, other: list) -> dict:
        more, more_words = [], []
        for right, before, x, y in zip(side, lead, own, other):
            n = _common(x, y, right)
            if right:  # a word that began before the end is counted there
                words = _words_begun(before + x[:n]) - _words_begun(before)
            else:  # nor does one that goes on in the run, which has not counted it, unless each character is a word
                words = _words_begun(x[len(x) - n :]) - (not x[-1].isspace() and not _words_begun("a" + x[-1]) > 1) if n else 0
            more.append(n)
            more_words.append(words)
        return {"more": more, "more_words": more_words}

    return add_columns(rows, ["side", "lead", "s", "other"], compare, "more int, more_words int", drop=["at", "lead", "s", "other"])


def repeated_passages(df: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, start, end, n_words, first_doc_id, dropped``: spans (code points) of passages found more than once.

    A passage is found in several documents or several times in one. ``dropped`` is false for its first
    place (least id, then text, then position), so one copy of each stays; ``first_doc_id`` is the id of
    that place. Rows with a null id take no part. Rows that repeat an id and a text are one; ``text_hash``
    tells several texts of one id apart. Spans of a text do not overlap; ``n_words`` of one that is cut by
    another is its share. Words are what stands between white space, and each character of a script that is
    written without it. Null and empty texts have no passage. Texts of any length are
    read whole, a slice of bounded bytes at a time; an empty table gives an empty one. Other columns are
    not read.
    """
    docs = texts(df, id_col, text_col).filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("k"), "text")
    chunks = materialize(_chunked(docs), "chunks")
    zipped = F.arrays_zip("h", F.concat(F.array(F.lit(0)), F.col("ends")).alias("start"), F.col("ends").alias("end"))
    places = chunks.select("doc_id", "k", F.explode(F.slice(zipped, 1, F.size("h"))).alias("c")).select("doc_id", "k", "c.*")
    often = places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    hits = materialize(places.join(often, "h"), "hits")
    place = F.struct("doc_id", "k", "start", "end")
    shared = hits.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("k") == F.col("first.k")) & (F.col("start") == F.col("first.start"))
    rows = hits.join(shared, "h").withColumn("kept", own).withColumn("o", F.when(own, F.col("last")).otherwise(F.col("first")))
    hit = F.struct("start", "end", F.col("kept").cast("int").alias("kept"), F.col("o.doc_id").alias("od"), F.col("o.k").alias("ok"), F.col("o.start").alias("ostart"), F.col("o.end").alias("oend"))
    of_doc = rows.groupBy("doc_id", "k").agg(F.collect_set(hit).alias("hits"))
    parts = ["start", "end", "kept", "od", "ok", "ostart", "oend"]
    rows = of_doc.select("doc_id", "k", *(F.col(f"hits.{c}").alias(c) for c in parts)).join(chunks.select("doc_id", "k", "ends", "words"), ["doc_id", "k"])

    def runs(*columns: list) -> dict:
        return {"runs": [_runs(*row) for row in zip(*columns)]}

    end = "struct<od: long, ok: long, oat: int>"
    found = add_columns(rows, [*parts, "ends", "words"], runs, f"runs array<struct<start: int, end: int, n_words: int, dropped: boolean, left: {end}, right: {end}>>", drop=[*parts, "ends", "words"])
    found = materialize(found.select("doc_id", "k", F.inline("runs")).distinct(), "runs")
    found = found.withColumn("first_doc_id", F.when(F.col("dropped"), F.col("left.od")).otherwise(F.col("doc_id")))
    side = lambda n, at, of: found.select("doc_id", "k", "start", F.lit(n).alias("side"), F.col(at).alias("at"), f"{of}.od", f"{of}.ok", f"{of}.oat")
    more = _extended(side(0, "start", "left").union(side(1, "end", "right")), docs)
    of_side = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
    more = more.groupBy("doc_id", "k", "start").agg(of_side(0, "more").alias("left"), of_side(1, "more").alias("right"), F.sum("more_words").alias("words"))
    grown = found.drop("left", "right").join(more, ["doc_id", "k", "start"]).select(
        "doc_id", "k", (F.col("start") - F.col("left")).alias("start"), (F.col("end") + F.col("right")).alias("end"), (F.col("n_words") + F.col("words")).cast("int").alias("n_words"), "first_doc_id", "dropped"
    ).filter(F.col("n_words") >= least_words)
    of_text = grown.groupBy("doc_id", "k").agg(F.collect_set(F.struct("start", "end", "n_words", "first_doc_id", "dropped")).alias("spans"))

    def settled(batch: list) -> dict:
        return {"spans": [_apart(spans, least_words) for spans in batch]}

    spans = add_columns(of_text, ["spans"], settled, "spans array<struct<start: int, end: int, n_words: int, first_doc_id: long, dropped: boolean>>")
    return spans.select("doc_id", F.col("k").alias("text_hash"), F.inline("spans"))


def drop_repeats(df: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the dropped spans cut out of its texts; null texts, column order and all other columns stay."""
    gone = passages.filter("dropped").groupBy(F.col("doc_id").alias("_tidings_id"), F.col("text_hash").alias("_tidings_k")).agg(F.collect_set(F.struct("start", "end")).alias("_tidings_spans"))

    def cut(batch: list, spans: list) -> dict:
        out = []
        for text, gone in zip(batch, spans):
            for s in sorted(gone or (), key=lambda s: -s["start"]):
                text = text[: s["start"]] + text[s["end"] :]
            out.append(text)
        return {text_col: out}

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select("*", F.col(f"`{id_col}`").cast("long").alias("_tidings_id"), F.xxhash64(text).alias("_tidings_k")).join(gone, ["_tidings_id", "_tidings_k"], "left")
    return add_columns(rows, [text_col, "_tidings_spans"], cut, f"`{text_col}` string").select(*(f"`{c}`" for c in df.columns))
