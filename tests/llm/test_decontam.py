import random

from tidings.llm.decontam import ERRORS, best_match, budget, drop_leaks, find_leaks, normal


def distance(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(300):
        item, text = "".join(rng.choices("abc", k=rng.randint(1, 90))), "".join(rng.choices("abc", k=rng.randint(0, 120)))
        assert best_match(item, text)[0] == distance(item, text)


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(4, 30)))) for i in range(25)] + [(25, None), (26, "  "), (3, "another text for the same id, long enough")]
    docs = []
    for d in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        item = list(items[rng.randrange(25)][1].upper().replace(" ", ",  "))
        for _ in range(rng.randint(0, 9)):
            item[rng.randrange(len(item))] = rng.choice("abc ")
        docs.append((d % 50, text[: len(text) // 2] + " " + "".join(item) + text[len(text) // 2 :], "h"))
    docs += [(None, items[0][1], "h"), (90, None, "h"), (91, "", "h"), (92, "x " * 50_000 + items[1][1], "h")]
    want = {}
    for d, text, _ in docs:
        for i, item in items:
            n = normal(item or "")
            if n and text and (found := distance(n, normal(text))) <= budget(n, ERRORS):
                want[d, i] = min(found, want.get((d, i), 10**9))
    df = spark.createDataFrame(docs, "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in find_leaks(df, bench).collect()}
    assert got == want and len(want) > 20
    kept = drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for d, t, _ in docs if not any(n and t and distance(n, normal(t)) <= budget(n) for n in (normal(i or "") for _, i in items)))


def test_long_items_and_blocks(spark, monkeypatch):
    from tidings.llm import decontam

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    long = " ".join(rng.choices(words, k=4000))
    near = long[:9000] + "xy" + long[9000:15000] + long[15003:]
    items = [(1, long), (2, " ".join(rng.choices(words, k=20))), (3, " ".join(rng.choices(words, k=20))), (4, " ".join(rng.choices(words, k=20)))]
    docs = [(1, "q " + long + " z"), (2, "w " + near), (3, items[1][1]), (4, items[3][1] + " and " + items[2][1]), (5, long[:20_000]), (6, None), (7, "none"), (7, items[1][1])]
    df = spark.createDataFrame([(*d, "h") for d in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(long) > 20_000
    want = [(1, 1, 0), (2, 1, 5), (3, 2, 0), (4, 3, 0), (4, 4, 0), (7, 2, 0)]
    for block, chars in ((20_000, 4_000_000), (2, 300)):
        monkeypatch.setattr(decontam, "BLOCK", block)
        monkeypatch.setattr(decontam, "BLOCK_CHARS", chars, raising=False)
        assert sorted((r.doc_id, r.item_id, r.distance) for r in find_leaks(df, bench).collect()) == want
        kept = drop_leaks(df, bench)
        assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(5, docs[4][1]), (6, None), (7, "none")]
    sizes = [[len(n) for _, n in block] for block in decontam._blocks(bench, "text")[1]]
    assert sorted(n for block in sizes for n in block) == sorted(len(n) for _, n in items) and len(sizes) > 1
    assert all(len(block) == 1 or len(block) <= 2 and sum(block) <= 300 for block in sizes)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, bench).count() == 0 and drop_leaks(docs, bench).count() == 1
    assert find_leaks(docs.limit(0), spark.createDataFrame([(1, "some text to look for")], "item_id long, text string")).count() == 0
