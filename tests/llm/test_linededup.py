from collections import Counter

from tidings.llm.linededup import LineIndex, dedup_lines, line_key


def brute(texts, least, chars=1):
    seen = Counter(k for t in texts for k in {line_key(x) for x in (t or "").encode().split(b"\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not ((k := line_key(x.encode())) and len(k.decode()) >= chars and seen[k] >= least)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def run(spark, texts, least, chars=1):
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 7, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, lines string")
    got = dedup_lines(df, least, chars)
    assert got.columns == ["doc_id", "text", "lines", "n_lines", "n_dropped"]
    return sorted((r.text, r.n_lines, r.n_dropped) for r in got.collect())


def test_against_brute_force(spark):
    texts = ["A b\n\nÉ x", " a B \t\né x", "a b\r\nother", None, "", "\n\n", "a b\na b", "one\x0b", "x" * 100_000 + "\na b", "É x", "a b\xa0", "dup", "dup", "dup"]
    for least in (2, 3, 5):
        assert run(spark, texts, least) == brute(texts, least)
    assert run(spark, texts, 2, 4) == brute(texts, 2, 4)


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in docs.collect()]
    got = sorted((r.text, r.n_lines, r.n_dropped) for r in dedup_lines(docs, 10).collect())
    assert got == brute(texts, 10)


def test_levels_and_unseen(spark):
    index = LineIndex(spark, settle=2)
    for k in range(6):
        index.add(spark.createDataFrame([(k, 0), (100, 0)], "h long, g int"))
    assert len(index.levels) == 2
    total = {r.h: r.n for r in index.counts().collect()}
    assert total == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 100: 2}  # a settled line is counted no more
    left = index.unseen(spark.createDataFrame([(5, 0), (9, 0)], "h long, g int")).collect()
    assert [r.h for r in left] == [9]


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
