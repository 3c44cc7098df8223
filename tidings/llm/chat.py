"""Chat formatting of reply trees, by DataFrame functions only.

Self-joins of doubling length give each message its root, depth and path score, then
list the messages of each chosen root-to-leaf path; so a thread of n turns takes about
log2(n) joins each way. Branches are ranked by the sum of their messages' scores. Each
chosen path becomes one text with a loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.operators.storage import materialize

#: A turn is BEGIN role BREAK text END. Texts and roles have no bare "<" or "[" left, so no control string either.
BEGIN, BREAK, END = "<s>", "\n", "</s>"
#: Path lists are written after so many joins, to keep plans short.
JOINS = 4


def escape(text: Column) -> Column:
    """Backslash escapes for the characters that control strings begin with."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """The reverse: what stands between doubled backslashes has single escapes only."""

    def part(p: Column) -> Column:
        return F.replace(F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\n"), F.lit("\n"))

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")).otherwise(text)


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``leaf, rank, message_id, position`` of the ``branches`` best root-to-leaf paths of each tree.

    ``messages`` has unique ``message_id``, ``parent_id`` and ``score``. A parent that is null or not in
    the table makes a root; a null score counts as 0. Messages on or below a cycle of parents have no root
    and are left out. Branches are ranked by score, higher first, ties to the smaller leaf id.
    """
    nodes = messages.select("message_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    ids = nodes.select(F.col("message_id").alias("parent_id")).distinct()
    inner = nodes.join(ids, "parent_id", "left_semi").select("message_id", F.col("parent_id").alias("up"), F.col("score").alias("gain"))
    own = nodes.select("message_id", "score")
    # reach: an ancestor, how far up it is, and the scores from the message to below that ancestor
    reach = own.join(inner, "message_id", "left").select("message_id", F.coalesce("up", "message_id").alias("up"), F.col("up").isNotNull().cast("long").alias("depth"), F.coalesce("gain", F.lit(0.0)).alias("gain"))
    reach, jumps = materialize(reach, "reach"), []
    limit = max(1, int(reach.count())).bit_length() + 1
    for k in range(limit):
        jumps.append(materialize(reach.filter(F.col("depth") == 2**k).select("message_id", "up"), "jump"))
        other = reach.select(F.col("message_id").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"), F.col("gain").alias("extra"))
        reach = materialize(reach.join(other, "up").select("message_id", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("gain") + F.col("extra")).alias("gain")), "reach")
        if reach.filter(F.col("depth") >= 2 ** (k + 1)).isEmpty():
            break
    roots = own.join(inner, "message_id", "left_anti").select(F.col("message_id").alias("up"), F.col("score").alias("root_score"))
    leaves = reach.join(nodes.select(F.col("parent_id").alias("message_id")).distinct(), "message_id", "left_anti").join(roots, "up")
    order = Window.partitionBy("up").orderBy(F.desc(F.col("gain") + F.col("root_score")), "message_id")
    best = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches)
    path = best.select(F.col("message_id").alias("leaf"), "rank", "message_id", F.col("depth").alias("position"))
    for k in range(len(jumps) - 1, -1, -1):
        up = path.join(jumps[k], "message_id").filter(F.col("position") >= 2**k).select("leaf", "rank", F.col("up").alias("message_id"), (F.col("position") - 2**k).alias("position"))
        path = path.union(up)
        if k % JOINS == 0:
            path = materialize(path, "paths")
    return path


def format_reply_trees(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: ``conv_id, leaf, rank, n_turns, formatted, loss``.

    ``messages`` has ``message_id, parent_id, conv_id, role, text, score``; a null role or text counts as
    empty; a path goes by the conversation of its root. ``loss`` holds the spans (0-based code points, end exclusive) of the texts of ``loss_role`` in
    ``formatted``. A conversation is one value, so a single one must fit a row (2 GB). Other columns are
    not read; an empty table gives an empty one.
    """
    escaped_role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    content = messages.select("message_id", "conv_id", F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("learn"), escaped_role.alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    turns = chosen_paths(messages, branches).join(content, "message_id")
    turns = turns.withColumn("head", F.concat(F.lit(BEGIN), "role", F.lit(BREAK))).withColumn("size", F.length("head") + F.length("text") + len(END))
    before = Window.partitionBy("leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("learn"), F.struct(F.col("start"), (F.col("start") + F.length("text")).alias("end")))
    turn = F.struct("position", F.concat("head", "text", F.lit(END)).alias("piece"), span.alias("span"))
    rows = turns.groupBy("leaf", "rank").agg(F.min_by("conv_id", "position").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted")
    loss = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss")
    return rows.select("conv_id", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"), formatted, loss)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, leaf, position, role, text, learn``: the turns that the texts hold, and whether the mask covers them."""
    pieces = formatted.select("conv_id", "leaf", F.posexplode(F.split("formatted", END)).alias("position", "piece")).filter("piece <> ''")
    order = Window.partitionBy("leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    role = F.substring_index("piece", BREAK, 1)
    pieces = pieces.withColumn("start", (F.coalesce(F.sum(F.length("piece") + len(END)).over(order), F.lit(0)) + F.length(role) + len(BREAK)).cast("long"))
    spans = formatted.select("leaf", F.inline("loss")).withColumn("learn", F.lit(True))
    found = pieces.join(spans, ["leaf", "start"], "left")
    head = F.length(role) + len(BREAK)
    text = F.when(F.col("end").isNull() | (F.col("end") - F.col("start") == F.length("piece") - head), F.expr(f"substring(piece, length(substring_index(piece, '\\n', 1)) + {len(BREAK) + 1})"))
    return found.select("conv_id", "leaf", "position", unescape(F.substring(role, len(BEGIN) + 1, 1 << 30)).alias("role"), unescape(text).alias("text"), F.coalesce("learn", F.lit(False)).alias("learn"))


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` as messages that each answer the turn before.

    Rows of one turn follow each other by role, then text; rows with a null conversation belong to none
    and are left out; null turns come first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.filter("conv_id is not null").withColumn("n", F.row_number().over(order))
    name = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit(":"), n.cast("string"))
    return rows.select(name(F.col("n")).alias("message_id"), F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent_id"), "conv_id", "role", "text", F.lit(0.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted texts and their masks."""
    turns = read_back(formatted).groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list(F.struct("position", "role", "text", "learn"))).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["text"]), "")
    out = turns.select("leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(F.encode(learnt, "UTF-8"), 256).alias("loss_sha256"))
    sizes = formatted.select("conv_id", "leaf", F.length("formatted").cast("long").alias("formatted_chars"))
    return sizes.join(out, "leaf").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
