import re
from itertools import permutations

from tidings.llm.audit import filter_interactions


def brute(rows, labels):
    good, bad = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    docs = []
    for d, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in rows),
        }
        docs.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in bad))
    out, shapley = {}, {}
    for part in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[1]]
                failing = [x for x in own if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                out[part, order, step] = [len(alive), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, n string")
    got = filter_interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in got}
    assert len(out) == len(got)
    return out


def test_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = ["", None, "a", "A b", long, long + " $", long.upper(), "w " * 300, "é" * 50 + "A", long, "a\x0bb\xa0c", "x " * 100_000, "#", "a"]
    rows = [(i // 2 if i % 5 else i, t, [None, "en", "", "fr"][i % 4]) for i, t in enumerate(texts)]
    rows += [(None, "a", "en"), (None, long, "fr"), (30, long, "en"), (30, long, "en"), (2, "A b", "fr"), (2, "A b", "fr")]
    labels = [(i, i % 3 and 1, i % 2) for i in range(0, 14)] + [(2, None, None), (None, 1, 1), (3, 0, 1), (3, 1, 0), (30, 1, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_whole_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows, marks = [(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert run(spark, rows, marks) == brute(rows, marks)


def test_empty_table(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    assert len(run(spark, [(1, None, None)], [])) == 600
