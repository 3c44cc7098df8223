import random

import numpy as np

from tidings.llm.substring import LEAST, MOST, borders, drop_repeats, repeated_passages


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def test_borders_follow_content():
    rng = random.Random(1)
    text = words(rng, 4000).encode()
    cut = borders(np.frombuffer(text, np.uint8))
    sizes = np.diff([0, *cut])
    assert cut[-1] == len(text) and sizes.max() <= MOST and sizes[:-1].min() >= LEAST
    moved = b"12345" + text[:7000] + b"xyz" + text[7000:]

    def chunks(t):
        ends = borders(np.frombuffer(t, np.uint8))
        return {t[a:b] for a, b in zip([0, *ends], ends)}

    assert len(chunks(text) - chunks(moved)) <= 8
    assert borders(np.frombuffer(b"", np.uint8)) == []
    wide = ("é" * 3000 + "🤷" * 500).encode()
    for a, b in zip([0, *borders(np.frombuffer(wide, np.uint8))], borders(np.frombuffer(wide, np.uint8))):
        wide[a:b].decode()


def test_planted_passages(spark):
    rng = random.Random(2)
    passages = [words(rng, n) for n in (60, 80, 200, 55)]
    rows, held = [], {}
    for d in range(200):
        text = words(rng, rng.randint(0, 150))
        if d % 4 == 0:
            p = passages[d // 4 % 4]
            text = words(rng, 30) + " " + p + " " + text
            held[d] = p
        if d % 7 == 0:
            text += "\nthis short line is in many texts"
        rows.append((d, text, 0, "s"))
    rows += [(None, passages[0], 0, "s"), (500, None, 0, "s"), (501, "", 0, "s"), (0, rows[0][1], 0, "s"), (502, "x" * 100_000, 0, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, h string")
    spans = repeated_passages(df)
    found = {}
    for r in spans.collect():
        found.setdefault(r.doc_id, []).append(r)
    assert not set(found) - set(held)
    assert set(found) == set(held)
    text = {d: t for d, t, *_ in rows if d is not None}
    for d, own in found.items():
        for r in own:
            assert text[d][r.start : r.end] in text[r.first_doc_id] and r.dropped == (r.first_doc_id != d)
        at = text[d].index(held[d])
        assert sum(max(0, min(r.end, at + len(held[d])) - max(r.start, at)) for r in own) == len(held[d])
    cut = {r.doc_id: r.text for r in drop_repeats(df, spans).collect()}
    assert len(cut[20]) < len(text[20]) and cut[1] == text[1] and cut[500] is None
    assert repeated_passages(df.limit(0)).count() == 0


def test_against_brute_force(spark):
    """Texts with a span are those that hold a window of words which is found twice, in one text or several."""
    rng = random.Random(5)
    pool = [words(rng, rng.randint(40, 70)) for _ in range(40)]
    rows = []
    for d in range(300):
        parts = [words(rng, rng.randint(0, 60)) for _ in range(3)]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(pool))
        rows.append((d, " ".join(p for p in parts if p)))
    once = words(rng, 90)
    rows += [(400, once + " " + words(rng, 30) + " " + once), (401, words(rng, 400)), (402, ""), (403, None)]

    def repeated(n):
        seen, out = {}, set()
        for d, t in rows:
            w = (t or "").split()
            for i in range(len(w) - n + 1):
                seen.setdefault(tuple(w[i : i + n]), set()).add((d, i))
        for places in seen.values():
            if len(places) > 1:
                out |= {d for d, _ in places}
        return out

    spans = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found, text = {r.doc_id for r in spans}, dict(rows)
    assert repeated(51) <= found <= repeated(48) and len(repeated(51)) > 50
    own = sorted((r.start, r.dropped) for r in spans if r.doc_id == 400)
    assert [d for _, d in own] == [False, True]
    for r in spans:
        assert abs(len(text[r.doc_id][r.start : r.end].split()) - r.n_words) <= 1 + r.n_words // 10


def test_texts_without_spaces(spark):
    """Scripts without spaces: each character counts as a word, in whole texts and where scripts mix."""
    rng = random.Random(9)
    script = lambda low, high, n: "".join(chr(rng.randint(low, high)) for _ in range(n))
    passages = [script(0x4E00, 0x9FA0, 70), script(0x3041, 0x3096, 120), script(0x0E01, 0x0E2E, 200), script(0x4E00, 0x9FA0, 40) + " " + words(rng, 30), script(0x4E00, 0x9FA0, 45)]
    rows = []
    for i, p in enumerate(passages):
        for k in range(3):
            rows.append((10 * i + k, script(0x4E00, 0x9FA0, rng.randint(20, 200)) + p + script(0xAC00, 0xAD00, 1) + script(0x4E00, 0x9FA0, rng.randint(20, 200))))
    rows.append((100, script(0x4E00, 0x9FA0, 2000)))
    rows.append((101, rows[-1][1]))
    text = dict(rows)
    found = {}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append(r)
        assert text[r.doc_id][r.start : r.end] in text[r.first_doc_id] and r.n_words >= 50
    assert set(found) == {10 * i + k for i in range(4) for k in range(3)} | {100, 101}  # the last passage has 45 words
    for i, p in enumerate(passages[:4]):
        for k in range(3):
            (r,) = found[10 * i + k]
            assert p in text[10 * i + k][r.start : r.end] and r.end - r.start <= len(p) + 2
    assert (found[101][0].start, found[101][0].end, found[101][0].n_words) == (0, 2000, 2000)
