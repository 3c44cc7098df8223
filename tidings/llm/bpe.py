"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a word's prefix is fixed by its last token: a token t that ends the
prefix is the last one if and only if (last token before t, t) is a stable pair, that
is, if merging the bytes of the two gives the two again. So a depth-first walk over
the trie of distinct words computes each prefix's last token once, from the states of
its ancestors, and shares it among all words below. Words visited in sorted order are
that walk; the states on the stack are those of the common prefix with the word before.
"""

from __future__ import annotations

import hashlib
import json
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from tidings.llm.common import map_texts, remembered, texts

#: Fixed value: how the byte-level tokenizers of this family cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries at which the younger half of a memo becomes the older one, whose entries go if they were not met since; that costs time and nothing else.
MEMO = 100_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tokenizer(spark: SparkSession, path: str) -> dict:
    """Read a byte-level BPE file on the driver: some MB, its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    kinds = (spec["pre_tokenizer"] or {}).get("type"), spec["model"]["type"]
    if kinds != ("ByteLevel", "BPE") or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
    letters = _byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return {
        "vocab": {raw(t): i for t, i in spec["model"]["vocab"].items()},
        "merges": [(raw(a), raw(b)) for a, b in merges],
        "added": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class Memo:
    """What was met of late, in two halves: common entries stay, rare ones go."""

    def __init__(self):
        self.young, self.old = {}, {}

    def missing(self, keys: set) -> set:
        """Keys that are not known; ``young`` holds all others then."""
        if len(self.young) > MEMO:
            self.young, self.old = {}, self.young
        keys = keys - self.young.keys()
        met = keys & self.old.keys()
        self.young.update(zip(met, map(self.old.__getitem__, met)))
        return keys - met


class PrefixEncoder:
    def __init__(self, spec: dict):
        self.ids = spec["vocab"]
        self.added = spec["added"]
        size = 1 + max([*self.ids.values(), *self.added.values()])
        self.bytes_of = [b""] * size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.rank, self.made, self.rights, self.lefts = {}, {}, {}, {}
        for k, (a, b) in enumerate(spec["merges"]):
            left, right = self.ids[a], self.ids[b]
            self.rank[left << 20 | right] = k
            self.made.setdefault(self.ids[a + b], (k, left, right))
        lengths: dict[int, set] = {}
        for token in self.ids:
            lengths.setdefault(token[-1], set()).add(len(token))
        self.lengths = {b: sorted(n, reverse=True) for b, n in lengths.items()}
        self.stable: dict[int, bool] = {}
        self.guess: dict[int, int] = {}
        self.words, self.pieces = Memo(), Memo()
        self.find = regex.compile(WORDS).findall
        self.cut = regex.compile(r"(?<=\S) (?=\S)").split
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of ``token`` while it is built, each with the rank of the merge that ends it."""
        spine, ends = [], float("inf")
        while True:
            spine.append((token, ends))
            made = self.made.get(token)
            if made is None:
                return spine
            ends, token = made[0], made[1 + side]

    def _is_stable(self, first: int, second: int) -> bool:
        """Whether no merge crosses the border: one would if its rank came before those that end both its parts (the left one of equals goes first)."""
        rights, lefts = self.rights, self.lefts
        if first not in rights:
            rights[first] = self._edge(first, 1)
        if second not in lefts:
            lefts[second] = self._edge(second, 0)
        rank = self.rank
        for a, a_ends in rights[first]:
            for b, b_ends in lefts[second]:
                k = rank.get(a << 20 | b)
                if k is not None and k < a_ends and k <= b_ends:
                    return False
        return True

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each word."""
        out, before = {}, b""
        last = [-1]  # of each prefix of the word on the stack: its last token
        get, lengths, stable, guess, bytes_of = self.ids.get, self.lengths, self.stable, self.guess, self.bytes_of
        for memo in (stable, guess):
            if len(memo) > 4 * MEMO:
                memo.clear()
        for word in sorted(words):  # the order of code points is that of their bytes
            raw = word.encode()
            shared = 0
            for a, b in zip(raw, before):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                # what came of the same last token and letter before is tried first: one token at most fits
                turn = last[-1] << 8 | raw[end - 1]
                token = guess.get(turn)
                if token is not None and raw.endswith(bytes_of[token], 0, end):
                    n = len(bytes_of[token])
                    if n == end or stable.get(last[end - n] << 20 | token):
                        last.append(token)
                        continue
                for n in lengths[raw[end - 1]]:
                    if n > end or (token := get(raw[end - n : end])) is None:
                        continue
                    if n < end:
                        key = last[end - n] << 20 | token
                        fits = stable.get(key)
                        if fits is None:
                            fits = stable[key] = self._is_stable(last[end - n], token)
                        if not fits:
                            continue
                    guess[turn] = token
                    last.append(token)
                    break
            before, at, found = raw, len(raw), []
            while at:
                found.append(last[at])
                at -= len(bytes_of[last[at]])
            found.reverse()
            out[word] = pack(f"<{len(found)}I", *found)
        return out

    def _pieces(self, text: str) -> list[str]:
        """Cut at single spaces between other characters: no word of the pattern crosses such a place."""
        return text.split(" ") if "  " not in text else self.cut(text)

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        parts = [self.marks.split(t) if self.marks else [t] for t in batch]
        cut = [[p if k % 2 else self._pieces(p) for k, p in enumerate(doc)] for doc in parts]
        # a piece is known with the space before it; the first of a text has none and goes by its own name
        fresh = {p: self.find(" " + p) for p in self.pieces.missing({p for doc in cut for k, ps in enumerate(doc) if not k % 2 for p in ps[1:]})}
        heads = {ps[0] for doc in cut for k, ps in enumerate(doc) if not k % 2}
        fresh_heads = {p: self.find(p) for p in heads}
        words = {w for found in (*fresh.values(), *fresh_heads.values()) for w in found}
        coded_words = self.encode_words(self.words.missing(words))  # first: the younger half may be a new one after that
        self.words.young |= coded_words
        known = self.words.young.__getitem__
        for p, found in fresh.items():
            self.pieces.young[p] = b"".join(map(known, found))
        first = {p: b"".join(map(known, found)) for p, found in fresh_heads.items()}
        get, out = self.pieces.young.__getitem__, []
        for doc in cut:
            coded = []
            for k, ps in enumerate(doc):
                if k % 2:
                    coded.append(np.array([self.added[ps]], dtype="<u4").tobytes())
                else:
                    coded.append(first[ps[0]])
                    coded.extend(map(get, ps[1:]))
            out.append(b"".join(coded))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again; one row out for each row in.

    Returns ``doc_id, n_tokens, ids array<int>, decoded``; with ``digests`` the last two as
    ``ids_sha256, decoded_sha256``. A null text counts as empty (no ids); null and repeated ids
    are kept as they are, repeated rows are encoded each, and an empty table gives an empty one. Very long texts
    are encoded whole, in slices of rows of bounded bytes; columns other than the two named are not read. The vocabulary is read on
    the driver and broadcast (its size does not grow with the data).
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_tokenizer(spark, tokenizer_path))
    step = "bpe", shared._jbroadcast.id()

    def per_batch(ids: list, batch: list) -> dict:
        encoder = remembered(step, lambda: PrefixEncoder(shared.value))
        coded = encoder.encode_batch(batch)
        out = {"doc_id": ids, "n_tokens": [len(c) // 4 for c in coded]}
        if digests:  # a text's numbers go before the next one's are made
            decoded = (encoder.decode(np.frombuffer(c, dtype="<u4").tolist()) for c in coded)
            return out | {"ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded], "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded]}
        numbers = [np.frombuffer(c, dtype="<u4").tolist() for c in coded]
        return out | {"ids": numbers, "decoded": [encoder.decode(n) for n in numbers]}

    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return map_texts(texts(df, id_col, text_col), per_batch, f"doc_id long, n_tokens long, {more}", step=step)
