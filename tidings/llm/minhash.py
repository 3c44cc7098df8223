"""Near-duplicate documents: one-permutation MinHash with optimal densification, bands, star-shaped candidates.

Documents with one and the same shingle set are a class, named by its smallest id; only
classes are compared. The sketch of a class is one permutation's minimum in each of
``rows * bands`` bins; an empty bin borrows from the first full one in an order of its
own (optimal densification). Classes that agree in all rows of a band share a bucket.

Candidates of a bucket form a star: its smallest class against all others. That alone
could miss a link between two leaves. So where buckets still hold several components,
those that meet make a group with a second star, around the class in its middle. What is
not linked with the middle meets by what it lacks of it or adds to it: a link between two
such classes, or to one that is linked, asks for many shared differences, so they share
one of their rarest. Pairs stay near the number of members, also in a large group of
copies that lie just beyond the threshold, and no pair is dropped. Each is confirmed on
full sets.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import add_columns, map_texts, remembered, texts
from tidings.operators.components import connected_components
from tidings.operators.storage import discard, materialize, rows_and_sum

#: Rows of a band. Bands follow from the similarity: a pair at it is missed once in a million.
ROWS, MISS = 6, 1e-6
#: Parts that the leaves of a hub are dealt into, and holders of a common difference that one part compares.
SALTS, PART = 256, 2048
#: Words whose hash a worker remembers, and the name of these for its tasks.
MEMO, WORDS = 150_000, "words"


def bands_for(similarity: float) -> int:
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log1p(-(similarity**ROWS)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (multiply and shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words, of the whole sequence."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = remembered(WORDS, dict)
    if len(known) > MEMO:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    factors = _mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    if len(h) < size:
        return _mix(np.array([(h * factors[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += h[k : k + n] * factors[k]
    return np.unique(_mix(total))


def _digest(hashes: np.ndarray) -> np.ndarray:
    """Two numbers that name a shingle set."""
    return np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64)


class Sketcher:
    def __init__(self, bands: int):
        self.bands, self.bins = bands, bands * ROWS
        rng = np.random.default_rng(5)
        self.order = np.array([rng.permutation(self.bins) for _ in range(self.bins)])
        self.factors = _mix(np.arange(1, self.bins + 1, dtype=np.uint64)).reshape(bands, ROWS) | np.uint64(1)

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        """``hashes`` sorted and distinct: the first of each bin is the bin's minimum."""
        at = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        sketch, full = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        sketch[at[first]], full[at[first]] = hashes[first], True
        empty = np.flatnonzero(~full)
        if len(empty):
            order = self.order[empty]
            sketch[empty] = sketch[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
        keys = (_mix(sketch).reshape(self.bands, ROWS) * self.factors).sum(axis=1, dtype=np.uint64)
        return _mix(keys).view(np.int64)


def _sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    bands = bands_for(percent / 100)
    #: Smaller sets are linked with equal sets only: one of s and one of s + 1 shingles are s / (s + 1) similar at most.
    least = -(-percent // (100 - percent)) if percent < 100 else math.inf
    made: list[Sketcher] = []

    def per_batch(ids: list, batch: list) -> dict:
        if not made:
            made.append(Sketcher(bands))
        out = {"doc_id": ids, "n": [], "d1": [], "d2": [], "bands": []}
        for text in batch:
            hashes = shingle_set(text, size)
            digest = _digest(hashes)
            for name, value in (("n", len(hashes)), ("d1", digest[0]), ("d2", digest[1]), ("bands", made[0].band_keys(hashes) if len(hashes) >= least else np.empty(0, np.int64))):
                out[name].append(value)
        return out

    return map_texts(docs, per_batch, "doc_id long, n long, d1 long, d2 long, bands array<long>", step=WORDS)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``rep, d1, h``: the shingle hashes of each text, sorted; ``d1`` tells the texts of one id apart."""

    def per_batch(ids: list, batch: list) -> dict:
        sets = [shingle_set(t, size) for t in batch]
        return {"rep": ids, "d1": [_digest(h)[0] for h in sets], "h": [h.view(np.int64) for h in sets]}

    return map_texts(docs, per_batch, "rep long, d1 long, h array<long>", 128, WORDS)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` with 100 * intersection >= percent * union on full shingle sets.

    The set of ``a`` goes to as many places as its pairs are dealt to, so a hub of any degree is many tasks.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    hubs = pairs.select("a", "salt").distinct().join(sets.select(F.col("rep").alias("a"), F.col("h").alias("h_a")), "a")
    rows = pairs.join(sets.select(F.col("rep").alias("b"), F.col("h").alias("h_b")), "b").join(hubs, ["a", "salt"])

    def per_batch(a: list, b: list) -> dict:
        linked = []
        for x, y in zip(a, b):
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= percent * (len(x) + len(y) - both))
        return {"linked": linked}

    found = add_columns(rows.select("a", "b", "h_a", "h_b"), ["h_a", "h_b"], per_batch, "linked boolean", drop=["h_a", "h_b"])
    return found.filter("linked").select("a", "b").distinct()


def _open_classes(members: DataFrame, component: DataFrame) -> DataFrame:
    """``rep, d1, n, c, lo``: classes, their components ``c`` and the least component of each bucket that still holds several."""
    named = component.select(F.col("node").alias("rep"), "component")
    rows = members.join(named, "rep", "left").select("key", "rep", "d1", "n", F.coalesce("component", "rep").alias("c"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key", "lo")
    return rows.join(mixed, "key").select("rep", "d1", "n", "c", "lo").distinct()


def _differences(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What tells each class from the middle of its group: ``g, rep, n, c, d, open, middle, prefix``.

    The middle is the class whose shingles are the most common in the group on average. ``d`` counts the
    shingles that a class lacks of it or adds to it; ``open`` marks classes that have no link to it.
    ``prefix`` holds so many of the rarest differences, each with its place in that order, that any two
    linked classes of which one is open share one of theirs. With D = (100 - percent) / (100 + percent):
    two sets are linked if they differ in at most D * (n_a + n_b) shingles. Differences to the middle
    that both share are no differences between them, so a link asks for (d_a + d_b - D * (n_a + n_b)) / 2
    shared ones. ``d`` minus the least such number over all possible partners, plus one, is enough of them.
    """
    # rows that repeat an id and its text have one set
    elements = classes.join(sets, ["rep", "d1"]).dropDuplicates(["rep", "d1"]).select("g", "rep", "d1", "n", "c", F.explode("h").alias("h"))
    common = elements.groupBy("g", "h").agg(F.count("*").alias("f")).filter("f > 1")
    counted = elements.join(common, ["g", "h"], "left").withColumn("f", F.coalesce("f", F.lit(1)))
    own = counted.groupBy("g", "rep", "d1", "n", "c").agg(F.collect_set(F.struct("h", "f")).alias("e"), F.avg("f").alias("usual"))
    own = materialize(own.select("g", "rep", "d1", "n", "c", "usual", F.col("e.h").alias("h"), F.col("e.f").alias("f")), "elements")
    middles = own.groupBy("g").agg(F.min_by(F.struct("rep", "d1"), F.struct(-F.col("usual"), "rep", "d1")).alias("at"), F.count("*").alias("m"))
    middles = middles.select("g", F.col("at.rep").alias("rep"), F.col("at.d1").alias("d1"), "m")
    middles = middles.join(own.select("g", "rep", "d1", F.col("h").alias("h_m"), F.col("f").alias("f_m")), ["g", "rep", "d1"]).select("g", F.col("rep").alias("middle"), "m", "h_m", "f_m")
    rows = own.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    rows = rows.join(rows.select("g", "salt").distinct().join(middles, "g"), ["g", "salt"]).select("g", "rep", "n", "c", "middle", "m", "h", "f", "h_m", "f_m")
    alpha, t = (100 - percent) / (100 + percent), percent / 100

    def per_batch(m: list, hs: list, fs: list, h_ms: list, f_ms: list) -> dict:
        out = {"d": [], "open": [], "prefix": []}
        for total, h, f, h_m, f_m in zip(m, hs, fs, h_ms, f_ms):
            adds, lacks = ~np.isin(h, h_m), ~np.isin(h_m, h)
            n, n_m, d = len(h), len(h_m), int(adds.sum() + lacks.sum())
            both = n - int(adds.sum())
            apart = 100 * both < percent * (n + n_m - both)
            least = (d - alpha * (n + n_m)) / 2 if apart else (d + alpha * (n_m - n)) / 2
            least = max(1, math.ceil(max(least, d - alpha * (n + n / t)) - 1e-6))
            element, rarity = np.concatenate([h[adds], h_m[lacks]]), np.concatenate([f[adds], total - f_m[lacks]])
            order = np.lexsort((element, rarity))[: max(0, d - least + 1)]
            out["d"].append(d)
            out["open"].append(apart)
            out["prefix"].append([{"pos": p, "h": int(element[i])} for p, i in enumerate(order.tolist()) if rarity[i] > 1])
        return out

    return add_columns(rows, ["m", "h", "f", "h_m", "f_m"], per_batch, "d int, open boolean, prefix array<struct<pos: int, h: long>>", 256, drop=["m", "h", "f", "h_m", "f_m"])


def _near_pairs(differences: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components, one of them open, that share a difference early enough to be linked."""
    rows = differences.select("g", "rep", "n", "c", "d", "open", F.inline("prefix"))
    mixed = rows.groupBy("g", "h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("open").alias("any"), F.count("*").alias("cnt")).filter("lo <> hi and any")
    # a difference that very many share is dealt into parts, each of which meets all of its holders
    rows = rows.join(mixed.select("g", "h", F.ceil(F.col("cnt") / PART).cast("int").alias("parts")), ["g", "h"])
    side = lambda x: [F.col(n).alias(f"{n}_{x}") for n in ("rep", "n", "c", "d", "open", "pos")]
    a = rows.filter("open").select("g", "h", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), *side("a"))
    b = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "h", "part", *side("b"))
    more, less = 100 + percent, 100 - percent
    early = f"{2 * more} * least(d_a - pos_a, d_b - pos_b) >= {more} * (d_a + d_b) - {less} * (n_a + n_b)"
    alike = f"c_a <> c_b and (rep_a < rep_b or not open_b) and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    met = a.join(b, ["g", "h", "part"]).filter(f"{alike} and {early}")
    return met.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are what is between ASCII white space, A-Z lower-cased; a document's set holds its distinct
    shingles of ``size`` words. Documents whose sets have 100 * intersection >= percent * union are linked;
    ``component_id`` is the smallest id that links reach, ``kept`` marks that document. Null and empty
    texts are linked with nothing. Rows with a null id take no part: their component is null, and they
    are kept. Rows that repeat an id are one document with the links of all its texts: each row is
    returned, all with one component. Texts of any length are read whole, a slice of bounded bytes at a
    time; an empty table gives an empty one. Other columns, whatever their names, are not read.
    """
    source = texts(df, id_col, text_col)
    sketches = materialize(_sketches(source, size, percent), "sketches")
    known = sketches.filter("n > 0 and doc_id is not null")
    classes = known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    buckets = classes.select(F.explode("bands").alias("key"), "rep", "d1", "n")
    shared = buckets.groupBy("key").agg(F.count("*").alias("cnt"), F.min(F.struct("rep", "n")).alias("hub")).filter("cnt > 1").drop("cnt")
    members = materialize(buckets.join(shared, "key"), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(_sets(source.join(wanted, "doc_id", "left_semi"), size), "sets")
    # first star: each class against the hub of each of its buckets
    stars = members.filter(f"rep <> hub.rep and 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)").select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(_confirmed(stars, sets, percent).union(_same_id(known, classes)), "links")
    component = materialize(connected_components(links, "a", "b"), "components")
    rest = materialize(_open_classes(members, component), "open")
    discard(members)
    if rows_and_sum(rest)[0]:
        # components that still meet in a bucket are a group; its second star is around its middle
        groups = connected_components(rest.select("c", "lo"), "c", "lo").select(F.col("node").alias("c"), F.col("component").alias("g"))
        grouped = materialize(rest.select("rep", "d1", "n", "c").distinct().join(groups, "c"), "groups")
        differences = materialize(_differences(grouped, sets, percent), "differences")
        central = differences.filter("not open and rep <> middle").select(F.col("middle").alias("a"), F.col("rep").alias("b"))
        more = materialize(central.union(_confirmed(_near_pairs(differences, percent), sets, percent)), "links")
        if rows_and_sum(more)[0]:
            links = more.union(component.select(F.col("node").alias("a"), F.col("component").alias("b")))
            component = materialize(connected_components(links, "a", "b"), "components")
        for table in (rest, grouped, differences, more):
            discard(table)
    discard(sets)
    named = sketches.drop("bands").join(classes.drop("bands"), ["d1", "d2", "n"], "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    of = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between an id that names several texts and the classes of these."""
    of_id = F.struct("d1", "d2", "n")
    several = known.groupBy("doc_id").agg(F.min(of_id).alias("lo"), F.max(of_id).alias("hi")).filter("lo <> hi").select("doc_id")
    rows = known.join(several, "doc_id").join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"])
    return rows.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
