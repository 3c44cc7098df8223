from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidings.llm import packing
from tidings.llm.packing import Plan, non_negative_least_squares, pack_documents, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(texts):
    library = Tokenizer.from_file(PATH)
    return [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check(rows, texts_by_id, window):
    """All tokens once, digests right, sequences without gaps; the share of padding."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    ids = {d: np.array(i, "<u4") for d, i in zip(texts_by_id, whole(texts_by_id.values()))}
    assert docs.keys() == ids.keys()
    for d, pieces in docs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    padding = 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / sum(map(len, ids.values()))


@pytest.mark.parametrize("sf,most", [("sf0.001", 0.01), ("sf0.01", 0.005)])
def test_whole_documents(spark, sf, most):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(pack_documents(docs.repartition(3), PATH).collect(), texts, 2048) <= most


def test_hard_texts(spark):
    texts = ["", None, "a", " " * 300_000, "x " * 9_000, "<|endoftext|> ok", "日本語 é\r\n", "dup dup", "dup dup", "\n" * 70 + "x"]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, start string, bin int")
    pieces = pack_documents(df, PATH, window=64, ids=True)
    check(pieces.collect(), dict(enumerate(texts)), 64)
    assert sorted(i for r in sequences(pieces, 64, -7).collect() for i in r.ids if i != -7) == sorted(i for t in whole(texts) for i in t)
    assert all(len(r.ids) == 64 or len(r.ids) & (len(r.ids) - 1) == 0 for r in sequences(pieces, 64, -7).collect())


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two")] * 3 + [(5, "three")] * 2 + [(5, None)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sum(r.length for r in got) == sum(map(len, whole([t for _, t in rows])))
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def padding_of(counts, window=2048):
    """Places all pieces of a histogram and checks that each has its own; the share of padding, and of rests that are cut."""
    plan = Plan(counts, window)
    lengths = np.repeat(np.fromiter(counts, np.int64), list(counts.values()))
    row, at, length, nth, sequence, offset = plan.pieces(lengths, np.concatenate([np.arange(n) for n in counts.values()]))
    assert (np.bincount(row, length) == lengths).all() and (at + length <= lengths[row]).all()
    begin = np.sort(sequence * 2 * window + offset)
    order = np.lexsort((offset, sequence))
    gapless = np.where(np.diff(sequence[order], prepend=-1) > 0, 0, np.concatenate([[0], (offset + length)[order][:-1]]))
    assert (offset[order] == gapless).all() and (np.diff(begin) > 0).all()
    used = np.bincount(sequence, length).astype(np.int64)
    assert len(used) == plan.sequences and used.min() > 0 and used.max() <= window
    padding = np.where(used & (used - 1), window - used, 0)
    assert padding.max() <= window / packing.OPEN
    return padding.sum() / used.sum(), len(np.unique(row[nth >= 0])) / len(lengths)


def test_one_length_holds_a_third():
    rng = np.random.default_rng(5)
    counts = {1: 40_000, 700: 30_000, 2048: 5_000}
    for n in rng.integers(1, 2048, 60_000).tolist():
        counts[n] = counts.get(n, 0) + 1
    padded, cut = padding_of(counts)
    assert padded < 0.001 and cut < 0.25


def test_lengths_that_fill_no_window():
    assert padding_of({1100: 50_000})[0] == 0
    assert padding_of({1100: 5_000, 3: 10})[0] < 0.03
    assert padding_of({7: 1})[0] == 0
    assert padding_of({1: 3_000})[0] == 0
    assert padding_of({1: 100_000, 2047: 50_000})[0] < 0.03
    assert Plan({}, 2048).sequences == 0


def test_least_squares():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((6, 15)), rng.random(6)
        x = non_negative_least_squares(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6  # the conditions of an optimum


def test_long_white_space_goes_by_the_trie():
    spec = packing.load_tokenizer(None, PATH)
    encode = packing.Encoder(spec)
    library = Tokenizer.from_file(PATH)
    for text in (" " * 500_000 + "x", "a b <|endoftext|>", "\u0085᠎ \x1c x"):
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
