import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidings.llm.bpe import encode

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", None, "  a  b   c", " x", "x ", "a \n b", "hey there's <|endoftext|> ok <|endoftext|><|endoftext|>", "日本語 テスト 　 x", "''s 'sx we'll 12 345²", "a" * 5000, "\t \t x\r\n\r\n y", "é ﷽ 🤷🏽‍♀️  🤷", "dup", "dup"]


def test_same_as_the_library(spark):
    ids = [None, 3, 3, *range(10, 10 + len(HARD) - 3)]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, HARD)], "doc_id long, text string, ids string")
    library = Tokenizer.from_file(PATH)
    got = encode(df, PATH).collect()
    assert len(got) == len(HARD)
    for row, text in zip(got, HARD):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert row.ids == want and row.n_tokens == len(want)
        assert row.decoded == library.decode(want, skip_special_tokens=False) == (text or "")


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(PATH)
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode(docs, PATH, digests=True).collect()}
    assert got == want


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
