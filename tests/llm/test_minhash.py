import random

from tidings.llm.minhash import near_duplicates


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, size)) for i, t in rows]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    low = {}
    for i in root:
        low[find(i)] = min(low.get(find(i), i), i)
    return sorted(((i, len(s), None if i is None else low[find(i)], i is None or i == low[find(i)]) for i, s in sets), key=str)


def run(spark, rows, size, percent):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n int, rep string")
    return sorted((tuple(r) for r in near_duplicates(df, size, percent).collect()), key=str)


def test_edges(spark):
    rows = [(5, "a b c d"), (3, "A  b\tc D"), (9, None), (8, ""), (7, " \n"), (None, "a b c d"), (4, "a b"), (2, "b a"), (1, "a b"), (6, "x"), (6, "x"), (12, "é b c d")]
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)
    assert run(spark, [(1, None)], 3, 85) == [(1, 0, 1, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_borderline_groups(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    rows = []
    for g in range(12):
        base = rng.choices(words, k=rng.choice([12, 60, 300]))
        for _ in range(rng.choice([3, 40])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((1000 - len(rows), " ".join(own)))
    rows.append((5000, " ".join(rng.choices(words, k=40_000))))
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_least_sets(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(5000)]
    rows = []
    for n in range(1, 13):
        for _ in range(20):
            own = rng.sample(words, n)
            for text in (own, [*own, rng.choice(words)], [rng.choice(words), *own]):
                rows.append((len(rows), " ".join(text)))
    for size, percent, pair in ((3, 85, 8), (5, 80, 8)):
        want = brute(rows, size, percent)
        assert run(spark, rows, size, percent) == want
        linked = {i for i, _, c, _ in want if i is not None and c != i}
        assert len(linked & set(range(60 * (pair - 1), 60 * pair))) == 40


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in near_duplicates(docs, 3, 85).collect()), key=str) == brute(rows, 3, 85)


def test_one_id_with_several_texts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    x, y, z = (" ".join(rng.sample(words, 40)) for _ in range(3))
    rows = [(5, x), (5, x), (5, y), (3, y), (7, x), (9, z), (8, z), (9, y + " end"), (11, "")]
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_group_around_the_threshold(spark):
    """Copies of one text with so many changes that a part of them is linked with nothing, and a second version with copies of its own."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(2000)]
    base = rng.choices(words, k=150)
    second = list(base)
    for at in range(0, 150, 9):
        second[at] = rng.choice(words)
    rows = []
    for i in range(600):
        own = list(base if i % 3 else second)
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(own))
            own[at : at + rng.choice([0, 1, 1, 1])] = rng.choice([[], [rng.choice(words)], [rng.choice(words[:5])]])
        rows.append((10_000 - i, " ".join(own)))
    want = brute(rows, 3, 85)
    alone = len(rows) - sum(c != i for i, _, c, _ in want) - 1
    assert 100 < alone < 500
    assert run(spark, rows, 3, 85) == want
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_full_similarity_links_equal_sets_only(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e g"), (4, "A  b c d e f"), (5, "")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=100).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
