import hashlib
import re

import numpy as np

import pytest

from tidings.llm.pii import _free, _numbers, KINDS, TAGS, Tagger, base_spans, digests, disguised, find_pii, tagged_spans, train, windows

HARD = [
    None, "", "a.b@c.de x@y a@b..c", "é🤷 +1 (984) 555-5224 and +12345", "4111 1111 1111 1111, 4111-1111-1111-1112", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.2.3.4.", "5" * 40, "x " * 30_000 + "me@mail.example.com", "dup 4111111111111111", "dup 4111111111111111",
]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0


def want(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m[0].split("."))) < 256:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
    return (*(sum(k == n for _, k, _ in out) for n in range(4)), hashlib.sha256(joined.encode()).hexdigest())


def test_hard_texts(spark):
    df = spark.createDataFrame([(i if i % 3 else None, t, "p") for i, t in enumerate(HARD)], "doc_id long, text string, pii string")
    got = digests(find_pii(df, None)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((i if i % 3 else None, *want(t)) for i, t in enumerate(HARD)), key=str)
    assert find_pii(df.limit(0), train(df.limit(0))).count() == 0


def test_gradient():
    rng = np.random.default_rng(0)
    tagger = Tagger()
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    codes, tags = rng.integers(1, 132, (3, 10)), rng.integers(0, TAGS, (3, 10))
    _, g = tagger.gradient(codes, tags)
    for name, value in tagger.p.items():
        at = (codes[0, 3], 2) if name == "embed" else tuple(rng.integers(0, n) for n in value.shape)
        old, losses = value[at], []
        for step in (1e-3, -1e-3):
            value[at] = old + step
            losses.append(tagger.gradient(codes, tags)[0])
        value[at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - g[name][at]) < 1e-4, name


def test_windows_hold_every_trigger():
    text = "a" * 100 + "7" + "b" * 300 + "@" + "c" * 10
    for at in (100, 401):
        assert any(a <= at < b for a, b in windows(text))
    assert windows("no trigger here") == [] and windows("") == []


@pytest.fixture(scope="module")
def held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return train(docs.filter("doc_id % 5 <> 0")), docs.filter("doc_id % 5 = 0")


def test_held_out_spans(held_out):
    """The tagger finds most spans of documents that it has not seen, and the query adds to the patterns' spans only."""
    tagger, docs = held_out
    rows = [r.text for r in docs.collect()]
    base, found = [set(base_spans(t)) for t in rows], [set(s) for s in tagged_spans(tagger, rows)]
    hit = sum(len(a & b) for a, b in zip(base, found))
    assert hit >= 0.6 * sum(map(len, base))
    out = digests(find_pii(docs, tagger)).collect()
    assert sorted(tuple(r)[1:6] for r in out) == sorted(want(t) for t in rows)


def test_added_spans(spark, held_out):
    """Spans in forms that the patterns miss, planted in unseen documents: most are added, and next to nothing else."""
    tagger, docs = held_out
    rng, rows, planted = np.random.default_rng(99), [], {}
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text]
    pool = [[t[a:b] for t in texts for a, k, b in base_spans(t) if k == kind] for kind in range(4)]
    clean = [t for t in texts if not base_spans(t)]
    for i, text in enumerate(clean):
        at = text.find(" ", len(text) // 2) + 1
        if i % 2 and at:
            kind = i // 2 % 4
            own = disguised(kind, pool[kind][i % len(pool[kind])], rng)
            planted[i] = (at, kind, at + len(own))
            text = text[:at] + own + " " + text[at:]
        rows.append((i, text))
    found = find_pii(spark.createDataFrame(rows, "doc_id long, text string"), tagger)
    added = {(r.doc_id, s.start, KINDS.index(s.kind), s.end) for r in found.collect() for s in r.pii if not s.base}
    right = {(i, *s) for i, s in planted.items()} & added
    assert len(right) >= 0.85 * len(planted) and len(right) >= 0.9 * len(added)
    for kind in range(4):
        assert sum(k == kind for _, _, k, _ in right) >= 0.75 * sum(k == kind for _, k, _ in planted.values())


#: Forms that the training does not make: other marks, other separators, other groupings.
UNSEEN = {
    0: lambda s: s.replace("@", " AT ").replace(".", " DOT "),
    1: lambda s: s.replace(".", " [dot] "),
    2: lambda s: "~".join(d[i : i + 4] for d in ["".join(c for c in s if c.isdigit())] for i in range(0, len(d), 4)),
    3: lambda s: (lambda d: f"{d[-10:-7]}-{d[-7:-4]} {d[-4:]}")("".join(c for c in s if c.isdigit())),
}


def test_forms_that_were_not_taught(spark, held_out):
    """Of spans in forms that the training does not make, many are found, and what is added lies on them."""
    tagger, docs = held_out
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text]
    pool = [[t[a:b] for t in texts for a, k, b in base_spans(t) if k == kind] for kind in range(4)]
    rows, planted = [], {}
    for i, text in enumerate([t for t in texts if not base_spans(t)][:400]):
        kind, at = i % 4, text.find(" ", len(text) // 3) + 1
        own = UNSEEN[kind](pool[kind][i % len(pool[kind])])
        planted[i] = (at, at + len(own))
        rows.append((i, text[:at] + own + " " + text[at:]))
    found = find_pii(spark.createDataFrame(rows, "doc_id long, text string"), tagger)
    added = [(r.doc_id, s.start, s.end) for r in found.collect() for s in r.pii if not s.base]
    on = {i for i, a, b in added if a < planted[i][1] and planted[i][0] < b}
    print("unseen forms", len(on), len(planted), len(added))
    assert len(on) >= 0.4 * len(planted)
    assert sum(a < planted[i][1] and planted[i][0] < b for i, a, b in added) >= 0.9 * len(added)


def test_no_phone_inside_a_number(spark, held_out):
    """What the tagger adds cuts no run of digits and is no part of a number that failed as a card."""
    tagger, _ = held_out
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in find_pii(docs, tagger).collect():
        for s in r.pii:
            if not s.base:
                around = r.text[max(0, s.start - 3) : s.end + 3]
                assert not (s.start and r.text[s.start - 1].isdigit() and r.text[s.start].isdigit()), around
                assert not (s.end < len(r.text) and r.text[s.end].isdigit() and r.text[s.end - 1].isdigit()), around
    for text, start, end in (("4111 1111 1111 1112 x", 0, 14), ("call 4111-1111-1111-1112", 5, 19), ("no 41111111111111111111", 3, 15)):
        assert not _free(text, start, 3, end, _numbers(text))
    assert _free("at 555-123-4567 now", 3, 3, 15, _numbers("at 555-123-4567 now"))
