"""How filters of documents interact, in every order that they may be applied in.

Which filters a document fails is a mask of bits. Documents of a part that share a mask are one cell, so
the evaluation runs over cells: each is unpivoted against the steps of each order, a running bit-or over
the steps before tells what an earlier filter has removed, and conditional sums and totals by filter give
the figures. Its size follows the parts and the masks, not the documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.common import KEY, text_key

#: Fixed value: white space that parts words.
SPACE = r"[\x20\x09-\x0D]+"
#: The letter of the filter of repeated texts, which is no condition on one row.
REPEATED = "E"


def with_failures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``mask``: bit 0 for filter A, and so on to D."""
    text = F.col(text_col)
    words = docs.withColumn("_words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    many, kinds = F.size("_words"), F.size(F.array_distinct("_words"))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = {"A": many < 200, "B": 100 * kinds < 50 * many, "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}
    mask = F.lit(0)
    for k, failed in enumerate(fails.values()):
        mask = mask.bitwiseOR(F.when(failed, 1 << k).otherwise(0))
    return words.withColumn("mask", mask).drop("_words")


def cells(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, mask, n, good, toxic``: counts of documents by the filters that they fail (bit 4: repeated text).

    A text is repeated if a row of a smaller id has the same; so of each text all rows fail but those of its
    least id. Rows without an id are never repeated nor make others so. A document is good or toxic if any row
    of ``labels`` with its id says 1; labels that are null say nothing.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # rows without an id meet no label; they are dealt out so that they do not fill one task
    dealt = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 10))).otherwise(0)
    rows = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = with_failures(rows).select("part", "doc_id", "mask", *text_key(F.col("text")), dealt.alias("_dealt"))
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(says("quality"), says("toxic")).withColumn("_dealt", F.lit(0).cast("long"))
    marked = rows.join(marks, ["doc_id", "_dealt"], "left").fillna(False, ["quality", "toxic"])
    same = [*KEY, "part", "mask", "quality", "toxic"]
    by_id = marked.groupBy("doc_id", "_dealt", *same).agg(F.count("*").alias("n"))  # dealt by id already
    has_id = F.col("doc_id").isNotNull()
    groups = by_id.groupBy(*same).agg(F.sum("n").alias("n"), F.sum(F.when(~has_id, F.col("n")).otherwise(0)).alias("unnamed"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"))
    # a text has one mask, so this window holds a row for each part and label at most
    least = F.min("first.doc_id").over(Window.partitionBy(*KEY))
    groups = groups.withColumn("new", F.col("unnamed") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    twice = F.lit(1 << 4)
    both = F.array(F.struct(F.col("mask"), F.col("new").alias("n")), F.struct(F.col("mask").bitwiseOR(twice).alias("mask"), (F.col("n") - F.col("new")).alias("n")))
    each = groups.select("part", "quality", "toxic", F.inline(both)).filter("n > 0")
    where = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), where("quality").alias("good"), where("toxic"))


def audit(cells: DataFrame, filters: str = "ABCD" + REPEATED) -> DataFrame:
    """``part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``cells``: ``part, mask, n, good, toxic``; bit k of a mask is the k-th letter of ``filters``. One row for each
    part, order and step, zeros included; a part without cells has no rows.
    """
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    bits = F.create_map(*(F.lit(x) for k, name in enumerate(filters) for x in (name, 1 << k)))
    long = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    long = long.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1))).withColumn("bit", F.element_at(bits, F.col("filter")))
    long = long.withColumn("hit", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("hit").over(before), F.lit(0)))
    fails, gone = F.col("hit") != 0, F.col("earlier") != 0
    total = lambda what, when: F.sum(F.when(when, F.col(what)).otherwise(0)).alias(what)
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total("n", ~gone & ~fails).alias("kept"),
        total("n", ~gone & fails).alias("removed"),
        total("n", gone & fails).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", ~gone & fails).alias("good_lost"),
        total("toxic", ~gone & fails).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def filter_interactions(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """The audit of the five filters over whole texts; see ``cells`` and ``audit``.

    Null texts count as empty, null parts as the empty part, together with empty ones. Repeated rows count each;
    rows of one id and one text are none the other's repeat. Very long texts are counted whole. An empty table
    gives no rows; other columns are not read, whatever their names.
    """
    return audit(cells(docs, labels, part_col))
