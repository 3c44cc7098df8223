import hashlib
import random

from tidings.llm.chat import conversations_as_trees, digests, format_reply_trees, read_back
from tidings.llm.queries import HARD_CONVERSATION, op10_chat

SCHEMA = "message_id string, parent_id string, conv_id long, role string, text string, score double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out, of = {}, {}
    for c, turn, role, text in rows:
        if c is not None:
            of.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    for c, turns in of.items():
        turns = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    return out


def test_conversations(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\", "\\l", "\\\\l<", "a\n[b]\\n", None, "", "é<s>\n</s>", "x" * 200_000]
    rows = [(i % 4, i // 4, ["user", "assistant", "system", "a\nb", None][i % 5], t) for i, t in enumerate(hard * 4)] + [(7, 1, "user", "r"), (7, 1, "user", "r"), (None, 1, "user", "lost"), (8, None, "assistant", "n")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(300)] + HARD_CONVERSATION
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = digests(format_reply_trees(conversations_as_trees(df))).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == brute(rows) and len(got) == len(brute(rows))
    assert digests(format_reply_trees(conversations_as_trees(df.limit(0)))).count() == 0


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + HARD_CONVERSATION
    got = op10_chat(spark, "/root/testdata/sf0.001").collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == brute(rows)


def test_best_branches(spark):
    rng = random.Random(4)
    rows, parent, score = [], {}, {}
    for i in range(200):
        name, up = f"m{i:03}", f"m{rng.randrange(i):03}" if i % 25 else None
        parent[name], score[name] = up, rng.choice([0.0, 1.0, 2.0])
        rows.append((name, up, i // 25, "user", name, score[name]))
    rows += [("x", "y", 99, "user", "", 1.0), ("y", "x", 99, "user", "", 1.0), ("z", "gone", 98, "assistant", "<z>", None)]
    parent["z"], score["z"] = None, 0.0

    def path(m):
        return [*(path(parent[m]) if parent[m] else []), m]

    leaves = [m for m in parent if m not in parent.values()]
    want = {}
    for m in leaves:
        want.setdefault(path(m)[0], []).append((-sum(score[x] for x in path(m)), m))
    want = {(m, k + 1): path(m) for found in want.values() for k, (_, m) in enumerate(sorted(found)[:2])}
    out = format_reply_trees(spark.createDataFrame(rows, SCHEMA), branches=2)
    turns = {}
    for r in read_back(out).orderBy("position").collect():
        turns.setdefault(r.leaf, []).append(r.text)
    got = {(r.leaf, r.rank): turns[r.leaf] for r in out.collect()}
    want["z", 1] = ["<z>"]
    assert got == want
