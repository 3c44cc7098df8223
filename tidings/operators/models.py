"""Confidence models of a snapshot: how far the ranks of its top media hold if guessed dates are wrong as often as they are known to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions.dates import in_period

# Shares of guessed dates that are wrong, of undateable stories that have a date, of dated ones that have none.
MISDATED, DATEABLE, UNDATED = 0.22, 0.30, 0.13
# The share of wrong dates that are off by two or three days; others are off by eight to sixty.
NEAR_SHARE, RUNS, TOP_SHARE = 0.25, 10, 0.1
#: Runs that one number holds as its bits.
BITS = 60


def _roll(what: str) -> Column:
    """A number from 0 to 1 that a story, a run and a name decide, so that lost tasks make the same model again."""
    key = F.md5(F.concat_ws("|", F.col("stories_id").cast("string"), F.col("run").cast("string"), F.lit(what)))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 2**32


def tweaked_dates(stories: DataFrame, runs: int = RUNS) -> DataFrame:
    """``run`` and the columns of ``stories`` with other dates: ``publish_date, guessed, undateable`` are those of a model.

    A share of the guessed dates moves forth or back, some undateable stories get their date, some guessed
    ones lose it. All runs are one table.
    """
    tried = stories.withColumn("run", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(runs).cast("long"))))
    days = F.when(_roll("how") < NEAR_SHARE, F.when(_roll("days") < 0.5, 2).otherwise(3)).otherwise(F.lit(8) + F.floor(_roll("days") * 53).cast("int"))
    shift = F.make_dt_interval(F.when(_roll("past") < 0.5, -days).otherwise(days))
    moved = F.when(F.col("guessed") & ~F.col("undateable") & (_roll("moved") < MISDATED), F.col("publish_date") + shift).otherwise(F.col("publish_date"))
    still = F.col("undateable") & (_roll("dateable") >= DATEABLE)
    return tried.withColumn("publish_date", moved).withColumn("undateable", still | (F.col("guessed") & (_roll("undated") < UNDATED)))


def media_counts(stories: DataFrame, links: DataFrame, start: Column, end: Column) -> DataFrame:
    """``run, media_id, media_inlink_count, inlink_count`` of a period in every run.

    ``stories``: as by ``tweaked_dates``; a story without a date is in the period if one that is links to it.
    A story's runs are the bits of one number, BITS of them a block. So joins see a story and a link once for
    each block, not for each run, and links are counted by pairs of media and runs before runs are told apart.
    """
    block, bit = F.floor(F.col("run") / BITS), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("run", F.lit(BITS)).cast("int"))
    dated = ~F.col("undateable") & in_period(F.col("publish_date"), start, end)
    each = stories.groupBy("stories_id", "media_id", block.alias("block")).agg(F.bit_or(bit).alias("all"), F.bit_or(F.when(dated, bit).otherwise(0)).alias("own"))
    coming = links.join(each.filter("own <> 0").select("stories_id", "block", "own"), "stories_id")
    linked = coming.groupBy(F.col("ref_stories_id").alias("stories_id"), "block").agg(F.bit_or("own").alias("linked"))
    runs = F.col("all").bitwiseAND(F.col("own").bitwiseOR(F.coalesce("linked", F.lit(0))))
    inside = each.join(linked, ["stories_id", "block"], "left").select("block", "stories_id", "media_id", runs.alias("runs")).filter("runs <> 0")
    target = inside.select("block", F.col("stories_id").alias("ref_stories_id"), F.col("media_id").alias("to_media"), F.col("runs").alias("to_runs"))
    both = links.select("stories_id", "ref_stories_id").join(inside, "stories_id").join(target, ["block", "ref_stories_id"])
    pairs = both.groupBy("block", "media_id", "to_media", F.col("runs").bitwiseAND(F.col("to_runs")).alias("runs")).agg(F.count("*").alias("n"))
    counts = _each_run(pairs).groupBy("run", F.col("to_media").alias("media_id")).agg(F.countDistinct("media_id").alias("m"), F.sum("n").alias("n"))
    media = _each_run(inside.groupBy("block", "media_id").agg(F.bit_or("runs").alias("runs")))
    rows = media.select("run", "media_id").join(counts, ["run", "media_id"], "left")
    return rows.select("run", "media_id", F.coalesce("m", F.lit(0)).alias("media_inlink_count"), F.coalesce("n", F.lit(0)).alias("inlink_count"))


def _each_run(rows: DataFrame) -> DataFrame:
    """``rows`` once for each of their ``runs``, as ``run``."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.getbit("runs", k) == 1)
    return rows.select("*", F.explode(F.transform(bits, lambda k: F.col("block") * BITS + k)).alias("run"))


def top_media(counts: DataFrame, factor: int = 1) -> DataFrame:
    """``run, media_id, place``: in each run the first tenth (times ``factor``) by media inlinks that is clear of the first miss.

    Windows hold one row per medium and run, two numbers each.
    """
    by_run = Window.partitionBy("run")
    order = by_run.orderBy(F.desc("media_inlink_count"), "media_id")
    rows = counts.withColumn("k", F.row_number().over(order)).withColumn("total", F.count("*").over(by_run))
    miss = F.least(F.ceil(F.col("total") * TOP_SHARE) * factor + 1, F.col("total"))
    rows = rows.withColumn("miss", miss).withColumn("bar", F.max(F.when(F.col("k") == F.col("miss"), F.col("inlink_count"))).over(by_run))
    kept = rows.filter((F.col("k") < F.col("miss")) & (F.col("inlink_count") > F.col("bar") + 1))
    return kept.select("run", "media_id", (F.row_number().over(by_run.orderBy("k")) - 1).alias("place"))


def rank_correlation(clean: DataFrame, models: DataFrame, runs: int = RUNS) -> DataFrame:
    """``num_media, r2_mean, r2_stddev``: squared correlations of the clean places of top media with those in each run.

    A medium that a run's twice as long list lacks has the place after its end. Runs without a correlation
    (one medium, or all places alike) do not count.
    """
    asked = clean.select("media_id", F.col("place").alias("x"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(runs).cast("long"))).alias("run"))
    sizes = models.groupBy("run").agg((F.count("*") + 1).alias("beyond"))
    rows = asked.join(models.withColumnRenamed("place", "y"), ["run", "media_id"], "left").join(sizes, "run", "left")
    places = rows.select("run", F.col("x").cast("double").alias("x"), F.coalesce("y", "beyond", F.lit(1)).cast("double").alias("y"))
    each = places.groupBy("run").agg(F.count("*").alias("media"), F.corr("x", "y").alias("r")).withColumn("r", F.when(~F.isnan("r"), F.col("r")))
    return each.agg(F.coalesce(F.max("media"), F.lit(0)).alias("num_media"), F.avg(F.col("r") * F.col("r")).alias("r2_mean"), F.stddev_pop(F.col("r") * F.col("r")).alias("r2_stddev"))
