from collections import Counter

import corpus_pipeline
from tests.llm.test_minhash import brute as groups
from tidings.llm.decontam import Matcher, normal
from tidings.llm.linededup import line_key


def test_stages_against_brute_force(spark, tmp_path):
    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, got = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, got[-1], where).write.parquet(str(tmp_path / name))
        got.append(spark.read.parquet(str(tmp_path / name)))
        if k < 4:
            assert got[-1].columns == columns
    rows = [{r.doc_id: r for r in df.collect()} for df in got]
    toxic = {r.doc_id for r in spark.read.parquet(f"{where}/labels.parquet").filter("toxic = 1").collect()}
    gone = rows[0].keys() - rows[1].keys()
    assert rows[1].keys() <= rows[0].keys() and len(gone - toxic) <= 0.05 * len(rows[0])
    seen = Counter(k for r in rows[1].values() for k in {line_key(x) for x in r.text.encode().split(b"\n")})
    kept = lambda t: "\n".join(x for x in t.split("\n") if not (k := line_key(x.encode())) or seen[k] < 10)
    assert {i: r.text for i, r in rows[2].items()} == {i: kept(r.text) for i, r in rows[1].items()}
    assert all(r.n_chars == len(r.text) for r in rows[2].values())
    want = {i for i, _, _, keep in groups([(i, r.text) for i, r in rows[2].items()], 5, 80) if keep}
    assert rows[3].keys() == want
    items = Matcher([(r.item_id, normal(r.text)) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()], 0.06)
    assert rows[4].keys() == {i for i, r in rows[3].items() if not items.matches(normal(r.text))}
    assert rows[5].keys() == rows[4].keys()
    final = corpus_pipeline.run(spark, where)
    assert {tuple(r) for r in final.collect()} == {tuple(r) for r in got[-1].collect()}


def test_edges_of_stages(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, repeated rows, clashing names, and an empty table."""
    bench = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion in the old tower at dawn"
    long = " ".join(f"word{i * i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (None, "no id here at all"), (None, None), (3, "one of two texts"), (3, "another of two texts"), (4, "the very same row"), (4, "the very same row"), (5, long), (6, long), (7, "intro " + bench), (8, "unlike all others")]
    rows += [(20 + i, f"own text number {i}\nthe line of ten") for i in range(10)]
    names = "doc_id long, text string, score double, predicted string, held_out int, n_lines string, n_dropped int, n_chars long, batch int"
    docs = spark.createDataFrame([(*r, 0.5, "p", 7, "l", 8, -1, 9) for r in rows], names)
    where = str(tmp_path / "tables")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    for table, name in ((docs, "docs"), (docs.limit(0), "none")):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, where).write.parquet(str(tmp_path / f"{name}{k}"))
            now = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if k < 4:
                assert now.columns == docs.columns
                assert now.filter("score <> 0.5 or predicted <> 'p' or held_out <> 7 or n_lines <> 'l' or n_dropped <> 8 or batch <> 9").count() == 0
        if name == "none":
            assert now.count() == 0
    steps = [sorted(((r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / f"docs{k}")).collect()), key=str) for k in range(4)]
    assert steps[0] == sorted(rows, key=str)
    lined = sorted(((i, t and t.removesuffix("\nthe line of ten")) for i, t in rows), key=str)
    assert steps[1] == lined
    assert steps[2] == [r for r in lined if r[0] != 6]
    assert steps[3] == [r for r in lined if r[0] not in (6, 7)]
