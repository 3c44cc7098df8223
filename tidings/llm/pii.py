"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF that adds spans.

The tagger is trained in numpy on spans labelled by the patterns in a bounded sample: as they
stand, in forms that the patterns miss (spelled-out at signs, other separators, no plus), beside
a second span that a greedy pattern runs into, and replaced by numbers that are no personal data.
Texts are read in overlapping windows. Where windows overlap, each character takes its
scores from the window in which it stands nearest to the middle, and one Viterbi pass
over the joined stretch decodes it as a whole, so no window's edge cuts a span.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import add_columns, texts

#: Kinds in the order that ties of spans go by.
KINDS = ["email", "ip", "card", "phone"]
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Characters of a window, and how far the next one begins.
WINDOW, STEP = 64, 32
#: Training: documents looked at (as many as have a hash under a threshold, so about), windows kept of each kind and form, passes, and the state of each direction.
SAMPLE, PER_KIND, PASSES, STATE, EMBED = 4000, 150, 12, 16, 12
#: A span of the tagger must score this much better than no span there.
MARGIN = 4.0

# Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _holds(kind: str, text: str) -> bool:
    digits = [c for c in text if "0" <= c <= "9"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn("".join(digits))
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the patterns' matches, leftmost and without overlap by kind; failing ones are dropped, not retried."""
    out = []
    for k, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        out += [(m.start(), k, m.end()) for m in PATTERNS[kind].finditer(text) if _holds(kind, m[0])]
    return sorted(out)


def _codes(text: str) -> np.ndarray:
    """0 pads; ASCII by its code; other letters, digits and the rest have one code each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = points.astype(np.int64) + 1
    for at in np.flatnonzero(points >= 128):
        c = chr(points[at])
        out[at] = 129 if c.isalpha() else 130 if c.isdigit() else 131
    return out


CODES = 132
_trigger = re.compile(r"(?i)[0-9@]|[\[(]\s?(?:at|dot)\s?[\])]|\sdot\s")


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of ``text`` to decode: overlapping windows that hold a digit, an at sign or a spelled-out mark, as every span of the kinds does.

    Windows lie at multiples of STEP; those that follow each other are one stretch, with a window's half on each side.
    """
    if not text:
        return []
    out: list[list[int]] = []
    for m in _trigger.finditer(text):
        a, b = max(0, (m.start() // STEP - 1) * STEP), min(len(text), (m.start() // STEP + 2) * STEP)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, an LSTM each way, a linear layer to tag scores, and CRF transitions. All arrays are float32."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": init(CODES, EMBED), "out": init(2 * STATE, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        for way in "fb":
            self.p[f"wx_{way}"], self.p[f"wh_{way}"] = init(EMBED, 4 * STATE), init(STATE, 4 * STATE)
            self.p[f"b_{way}"] = np.concatenate([np.ones(STATE), np.zeros(3 * STATE)]).astype(np.float32)

    def _lstm(self, x: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """``x``: time, batch, EMBED. Gates in order forget, input, output, cell."""
        wx, wh, b = (self.p[f"{n}_{way}"] for n in ("wx", "wh", "b"))
        pre, h, c = x @ wx + b, np.zeros((x.shape[1], STATE), np.float32), np.zeros((x.shape[1], STATE), np.float32)
        out, kept = np.empty((*x.shape[:2], STATE), np.float32), []
        for t in range(len(x)):
            z = pre[t] + h @ wh
            gates, cell = _sigmoid(z[:, : 3 * STATE]), np.tanh(z[:, 3 * STATE :])
            before, h_before = c, h
            c = gates[:, :STATE] * c + gates[:, STATE : 2 * STATE] * cell
            squashed = np.tanh(c)
            h = gates[:, 2 * STATE :] * squashed
            out[t] = h
            kept.append((gates, cell, before, h_before, squashed))
        return out, kept

    def scores(self, codes: np.ndarray, keep: bool = False):
        """``codes``: batch, time. Scores: time, batch, TAGS."""
        x = self.p["embed"][codes.T]
        f, kept_f = self._lstm(x, "f")
        b, kept_b = self._lstm(x[::-1], "b")
        both = np.concatenate([f, b[::-1]], axis=2)
        out = both @ self.p["out"] + self.p["bias"]
        return (out, (x, both, kept_f, kept_b)) if keep else out

    def _back(self, grad: np.ndarray, x: np.ndarray, kept: list, way: str, g: dict) -> np.ndarray:
        wx, wh = self.p[f"wx_{way}"], self.p[f"wh_{way}"]
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        dz_all = np.empty((*grad.shape[:2], 4 * STATE), np.float32)
        for t in range(len(x) - 1, -1, -1):
            gates, cell, before, h_before, squashed = kept[t]
            forget, enter, leave = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
            dh = dh + grad[t]
            dc = dc + dh * leave * (1 - squashed**2)
            dz = np.concatenate([dc * before * forget * (1 - forget), dc * cell * enter * (1 - enter), dh * squashed * leave * (1 - leave), dc * enter * (1 - cell**2)], axis=1)
            dz_all[t] = dz
            g[f"wh_{way}"] += h_before.T @ dz
            dh, dc = dz @ wh.T, dc * forget
        flat = dz_all.reshape(-1, 4 * STATE)
        g[f"wx_{way}"] += x.reshape(-1, EMBED).T @ flat
        g[f"b_{way}"] += flat.sum(0)
        return dz_all @ wx.T

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the CRF over a batch of full windows, and its gradient."""
        emit, (x, both, kept_f, kept_b) = self.scores(codes, keep=True)
        emit = emit.astype(np.float64)
        move, (steps, rows) = self.p["move"].astype(np.float64), emit.shape[:2]
        logsum = lambda a, axis: (m := a.max(axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis))
        ahead, behind = np.empty_like(emit), np.zeros_like(emit)
        ahead[0] = emit[0]
        for t in range(1, steps):
            ahead[t] = logsum(ahead[t - 1][:, :, None] + move, 1) + emit[t]
        for t in range(steps - 2, -1, -1):
            behind[t] = logsum(move[None] + (emit[t + 1] + behind[t + 1])[:, None, :], 2)
        total, tags, row = logsum(ahead[-1], 1), tags.T, np.arange(rows)
        d_emit = np.exp(ahead + behind - total[None, :, None])
        d_move = np.zeros_like(move)
        gold = emit[np.arange(steps)[:, None], row[None], tags].sum(0)
        for t in range(1, steps):
            d_move += np.exp(ahead[t - 1][:, :, None] + move + (emit[t] + behind[t])[:, None, :] - total[:, None, None]).sum(0)
            np.add.at(d_move, (tags[t - 1], tags[t]), -1)
            gold += move[tags[t - 1], tags[t]]
        np.add.at(d_emit, (np.arange(steps)[:, None], row[None], tags), -1)
        d_emit = (d_emit / rows).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["move"] = (d_move / rows).astype(np.float32)
        g["out"], g["bias"] = both.reshape(-1, 2 * STATE).T @ d_emit.reshape(-1, TAGS), d_emit.sum((0, 1))
        d_both = d_emit @ self.p["out"].T
        d_x = self._back(np.ascontiguousarray(d_both[:, :, :STATE]), x, kept_f, "f", g)
        d_x = d_x + self._back(np.ascontiguousarray(d_both[::-1, :, STATE:]), x[::-1], kept_b, "b", g)[::-1]
        np.add.at(g["embed"], codes.T, d_x)
        return float((total - gold).mean()), g

    def fit(self, codes: np.ndarray, tags: np.ndarray, passes: int = PASSES, batch: int = 64) -> float:
        """Adam over shuffled batches; returns the last pass's mean loss."""
        rng, first, second, t = np.random.default_rng(2), {}, {}, 0
        loss = 0.0
        for _ in range(passes):
            order, losses = rng.permutation(len(codes)), []
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                loss, g = self.gradient(codes[part], tags[part])
                losses.append(loss)
                t += 1
                for k, v in g.items():
                    v = np.clip(v, -5, 5)
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * v
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * v * v
                    self.p[k] = (self.p[k] - 0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss


def _tags(spans: list[tuple[int, int, int]], size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for start, kind, end in sorted(spans, key=lambda s: -s[1]):
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def _allowed() -> np.ndarray:
    """Moves that make no sense cost a lot: inside a kind comes after begin or inside of that kind."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        bad = [t for t in range(TAGS) if t not in (1 + 2 * k, 2 + 2 * k)]
        out[bad, 2 + 2 * k] = -1e4
    return out


def _pick(rng: np.random.Generator, of: list):
    return of[int(rng.integers(len(of)))]


def disguised(kind: int, span: str, rng: np.random.Generator) -> str:
    """A form of a span that the patterns miss."""
    if kind == 0:
        name, _, domain = span.partition("@")
        at, dot = _pick(rng, [(" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" @ ", "."), (" @ ", " . "), ("[at]", ".")])
        return name + at + domain.replace(".", dot)
    if kind == 1:
        return span.replace(".", _pick(rng, ["[.]", " . ", "(.)", " [.] ", "[dot]", " dot "]))
    digits = re.sub("[^0-9]", "", span)
    if kind == 2:
        return _pick(rng, [".", "/", "_", "  ", " - ", "--"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    land, area, a, b = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
    return _pick(rng, [f"({area}) {a}-{b}", f"({area}) {a} {b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"00{land} {area} {a} {b}", f"00{land}-{area}-{a}-{b}", f"{area}/{a}/{b}", f"{area} {a} {b}"])


def made(kind: int, rng: np.random.Generator) -> str:
    """A span of a kind, to stand beside another."""
    n = lambda size: "".join(map(str, rng.integers(0, 10, size)))
    if kind == 1:
        return ".".join(map(str, rng.integers(0, 256, 4)))
    if kind == 2:
        body = n(15)
        body += next(d for d in "0123456789" if _luhn(body + d))
        return _pick(rng, ["", " ", "-"]).join(body[i : i + 4] for i in range(0, 16, 4))
    return f"+{rng.integers(1, 99)} " + _pick(rng, [f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)} {n(3)} {n(4)}", f"{n(3)}-{n(3)}-{n(4)}"])


def decoy(rng: np.random.Generator) -> str:
    """Digits that are no personal data: dates, times, prices, versions, counts, codes, long numbers."""
    n = lambda size: "".join(map(str, rng.integers(0, 10, size)))
    return _pick(rng, [f"20{n(2)}-0{rng.integers(1, 10)}-1{n(1)} 1{n(1)}:2{n(1)}:3{n(1)}", f"{n(1)}.{n(1)}.", f"v{n(1)}.{n(2)}.{n(1)}", f"${n(1)},{n(3)}.{n(2)}", n(4), n(7), n(8), f"{n(3)}-{n(4)}", rng.bytes(20).hex(), rng.bytes(6).hex(), f"{n(2)}/{n(2)}/20{n(2)}", f"#{n(6)}", f"{n(2)} {n(2)} {n(2)}", f"{n(3)} x {n(3)}", " dot ", " (at) ", f"{n(2)}%"])


def _window(left: str, parts: list[tuple[str, int]], right: str, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of a window: some of what is on the left, the parts (a kind of -1 is no span), and what is on the right."""
    text = left[len(left) - min(len(left), int(rng.integers(0, WINDOW // 2))) :]
    spans = []
    for body, kind in parts:
        if kind >= 0:
            spans.append((len(text), kind, len(text) + len(body)))
        text += body
    text = (text + right)[:WINDOW]
    codes, tags = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
    codes[: len(text)] = _codes(text)
    tags[:] = _tags([(a, k, min(b, WINDOW)) for a, k, b in spans if a < WINDOW], WINDOW)
    return codes, tags


def examples(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of WINDOW characters, their tags and their forms: for each span as it is, disguised, beside another and replaced, and windows without one.

    Where a pattern of phones or addresses has matched what does not hold, nothing is known, and no window is taken.
    """
    found: dict[int, list] = {}
    for text in texts:
        spans = base_spans(text)
        for at, (a, kind, b) in enumerate(spans):
            rng = np.random.default_rng(zlib.crc32(text[max(0, a - 20) : b].encode()))
            lo, hi = spans[at - 1][2] if at else 0, spans[at + 1][0] if at + 1 < len(spans) else len(text)
            if lo > a or hi < b:
                continue
            left, own, right = text[max(lo, a - WINDOW) : a], text[a:b], text[b : min(hi, b + WINDOW)]
            other = int(rng.integers(1, len(KINDS)))
            beside = [(own, kind), (_pick(rng, [" ", " ", ", ", "; "]), -1), (made(other, rng), other)]
            forms = [[(own, kind)], [(disguised(kind, own, rng), kind)], beside if rng.random() < 0.5 else beside[::-1], [(decoy(rng), -1)]]
            for form, parts in enumerate(forms):
                found.setdefault(form * len(KINDS) + (kind if form < 3 else 0), []).append(_window(left, parts, right, rng))
        unknown = [m.span() for k in ("phone", "ip") for m in PATTERNS[k].finditer(text)] + [(a, b) for a, _, b in spans]
        rng = np.random.default_rng(zlib.crc32(text[:200].encode()))
        for m in list(_trigger.finditer(text))[:3]:
            a = max(0, m.start() - int(rng.integers(0, WINDOW // 2)))
            if not any(a < hi and lo < a + WINDOW for lo, hi in unknown):
                found.setdefault(4 * len(KINDS), []).append(_window("", [(text[a : a + WINDOW], -1)], "", rng))
    rows = [(codes, tags, form) for form in sorted(found) for codes, tags in found[form][: 2 * PER_KIND]]
    return tuple(np.array([r[i] for r in rows], np.int64).reshape((-1, WINDOW) if i < 2 else -1) for i in range(3))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """Fit a tagger on some SAMPLE documents that hold an at sign or two digits; None where they hold no span.

    The sample is what has a hash under a threshold that follows from their number, each text once, so no
    task gathers more than its own part of it. Texts are cut into windows where they are read.
    """
    rows = texts(df, id_col, text_col).select("text").filter(F.col("text").rlike("@|[0-9][^\\n]{0,40}[0-9]"))
    total = rows.count()
    if not total:
        return None
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    chosen = rows.withColumn("k", place).filter(F.col("k") < int(min(1.0, SAMPLE / total) * (1 << 40))).groupBy("k").agg(F.first("text").alias("text"))

    def cut(batch: list) -> dict:
        out = []
        for text in batch:
            out.append(dict(zip(("codes", "tags", "forms"), (x.astype("<i2").tobytes() for x in examples([text])))))
        return {"found": out}

    found = add_columns(chosen, ["text"], cut, "found struct<codes: binary, tags: binary, forms: binary>", 64).select("found.*")
    parts: list[list] = [[], [], []]
    for r in found.toLocalIterator():
        for part, own in zip(parts, r):
            part.append(np.frombuffer(bytes(own), "<i2"))
    codes, tags, forms = (np.concatenate(x or [np.empty(0, "<i2")]).astype(np.int64) for x in parts)
    codes, tags = codes.reshape(-1, WINDOW), tags.reshape(-1, WINDOW)
    if not tags.any():
        return None
    keep, counts = [], {}
    for i in np.lexsort(codes.T[::-1])[np.random.default_rng(4).permutation(len(codes))]:  # in an order that does not depend on how Spark dealt the rows
        form = int(forms[i])
        if counts.get(form, 0) < PER_KIND * (1 if form < 3 * len(KINDS) else 3):
            counts[form] = counts.get(form, 0) + 1
            keep.append(i)
    tagger = Tagger()
    tagger.fit(codes[keep], tags[keep])
    return tagger


def _joined_scores(tagger: Tagger, stretches: list[np.ndarray]) -> list[np.ndarray]:
    """Tag scores of each stretch from its overlapping windows: of each character, those of the window whose middle is nearest."""
    jobs, codes = [], []
    for k, s in enumerate(stretches):
        for a in range(0, max(1, len(s) - STEP), STEP):
            part = np.zeros(WINDOW, np.int64)
            own = s[a : a + WINDOW]
            part[: len(own)] = own
            jobs.append((k, a))
            codes.append(part)
    out = [np.zeros((len(s), TAGS), np.float32) for s in stretches]
    for at in range(0, len(codes), 1024):
        got = tagger.scores(np.array(codes[at : at + 1024]))
        for j, (k, a) in enumerate(jobs[at : at + 1024]):
            size = len(stretches[k])
            lo = 0 if a == 0 else STEP // 2
            hi = WINDOW if a + STEP >= size - STEP else STEP + STEP // 2
            hi = min(hi, size - a)
            out[k][a + lo : a + hi] = got[lo:hi, j]
    return out


def _viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    best, back = emit[0] + np.where(np.arange(TAGS) % 2 | (np.arange(TAGS) == 0), 0, -1e4), np.empty((len(emit), TAGS), np.int64)
    for t in range(1, len(emit)):
        ways = best[:, None] + move
        back[t] = ways.argmax(0)
        best = ways[back[t], np.arange(TAGS)] + emit[t]
    path = np.empty(len(emit), np.int64)
    path[-1] = best.argmax()
    for t in range(len(emit) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def tagged_spans(tagger: Tagger, batch: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger finds in whole texts."""
    cuts = [(d, a, b) for d, text in enumerate(batch) for a, b in windows(text)]
    codes = [_codes(batch[d][a:b]) for d, a, b in cuts]
    move = tagger.p["move"].astype(np.float64) + _allowed()
    out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    for (d, a, _), emit in zip(cuts, _joined_scores(tagger, codes)):
        if emit.argmax(1).any():
            emit = emit.astype(np.float64)
            path = _viterbi(emit, move)
            t = 0
            while t < len(path):
                if path[t] % 2:
                    kind, end = path[t] // 2, t + 1
                    while end < len(path) and path[end] == path[t] + 1:
                        end += 1
                    gain = (emit[np.arange(t, end), path[t:end]] - emit[t:end, 0]).sum()
                    if gain > MARGIN:
                        out[d].append((a + t, int(kind), a + end))
                    t = end
                else:
                    t += 1
    return out


def _plausible(kind: int, text: str) -> bool:
    """What a span of the tagger must hold besides its score."""
    numbers = re.findall("[0-9]+", text)
    digits = "".join(numbers)
    if kind == 0:
        return bool(re.search(r"(?i).(@|\bat\b).+(\.|\bdot\b).", text))
    if kind == 1:
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    if kind == 2:
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return 10 <= len(digits) <= 15 and not re.search("[A-Za-z]", text)


def _numbers(text: str) -> list[tuple[int, int]]:
    """Stretches of digits that a pattern has matched and found to be none of its kind: longer than a phone, and no card."""
    return [m.span() for m in PATTERNS["card"].finditer(text) if sum(c.isdigit() for c in m[0]) > 15 or not re.search("[ -]", m[0])]


def _free(text: str, start: int, kind: int, end: int, numbers: list[tuple[int, int]]) -> bool:
    """Whether a span cuts no run of digits, and is no phone that lies in a longer number."""
    cut = any(0 < at < len(text) and text[at - 1].isdigit() and text[at].isdigit() for at in (start, end))
    return not cut and not (kind == 3 and any(a <= start and end <= b and end - start < b - a for a, b in numbers))


def find_pii(df: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """All columns and ``pii``: spans ``start, kind, end, base`` (code points), by start, then kind as listed.

    Base spans are those of the patterns. The tagger adds spans that meet no base span and hold what
    their kind cannot lack (an at and a dot, also in words; four numbers up to 255; 14 to 19 digits that pass
    Luhn; 10 to 15 digits) and cut no number: neither a run of digits nor, for a phone, a longer number of
    several groups; without a tagger there are none. Every whole text is read, a slice of bounded
    bytes at a time; a null text counts as empty, an empty table gives an empty one.
    Ids, repeated rows and further columns do not matter (one called ``pii`` is replaced).
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger)

    def per_batch(batch: list) -> dict:
        batch = [t or "" for t in batch]
        added = tagged_spans(shared.value, batch) if shared.value else [[] for _ in batch]
        out = []
        for text, more in zip(batch, added):
            base = base_spans(text)
            numbers = _numbers(text) if more else []
            more = [s for s in more if not any(s[0] < e and b < s[2] for b, _, e in base) and _plausible(s[1], text[s[0] : s[2]]) and _free(text, *s, numbers)]
            out.append([{"start": s, "kind": KINDS[k], "end": e, "base": own} for s, k, own, e in sorted([(s, k, True, e) for s, k, e in base] + [(s, k, False, e) for s, k, e in more])])
        return {"pii": out}

    return add_columns(df, [text_col], per_batch, "pii array<struct<start: int, kind: string, end: int, base: boolean>>", 256)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("pii", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
