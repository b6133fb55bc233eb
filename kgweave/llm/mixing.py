"""Mixing sources to target weights: a time-varying curriculum (DataFrame functions only).

Training time runs from 0 to 1. A source's weight moves linearly from its first to its last value;
the integral over time is its share of the mix. A source's documents lie one behind the other in a
shuffled stream, again and again until the target is reached. The word at place x of that stream is
due when the source's cumulative demand reaches x, so inverting the integrated schedule gives each
taken document a position in training, and sorting all takes by it gives the training order.

Places in the stream are a running sum over all documents of a source, however many there are. The
sum is taken in two steps: per bucket of the shuffle order, then within each bucket. Only the table
of sources passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgweave.llm.tables import word_count

# (weight at the start, weight at the end) of the sources in code point order, repeating.
SCHEDULES = ((3.0, 3.0), (0.5, 1.5), (3.0, 1.0))
SHARE = 1.5
MOST_REPEATS = 2
BUCKET_DIGITS = 3  # 16 ** 3 buckets of each source's shuffle order


def source_targets(sizes: DataFrame, schedules=SCHEDULES, share=SHARE, repeats=MOST_REPEATS) -> DataFrame:
    """``source, source_size`` rows with ``w0, w1, weight, target``.

    Targets share ``share`` of all words by weight; none exceeds ``repeats`` times its source, and
    what that leaves over goes to the others by weight. Sources are sorted by how soon they hit
    their limit: those before the first that stays below the common level are at their limit. Capping
    one that need not be only lowers the level, so that first level is the greatest free one.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    knots = F.array(*[F.struct(F.lit(a).alias("w0"), F.lit(b).alias("w1")) for a, b in schedules])
    knot = F.element_at(knots, (F.pmod(rank, F.lit(len(schedules))) + 1).cast("int"))
    weighed = sizes.select("source", "source_size", knot.alias("k")).select(
        "source", "source_size", F.col("k.w0").alias("w0"), F.col("k.w1").alias("w1"),
        ((F.col("k.w0") + F.col("k.w1")) / 2).alias("weight"),
        (F.col("source_size") * repeats).alias("limit"),
    )
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = weighed.select(
        "*",
        ((F.sum("source_size").over(everything) * F.lit(share)
          - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after)).alias("level"),
    )
    free = F.col("level") * F.col("weight") <= F.col("limit")
    return levels.select(
        "source", "source_size", "w0", "w1", "weight",
        F.least(
            F.coalesce(F.max(F.when(free, F.col("level"))).over(everything) * F.col("weight"),
                       F.col("limit").cast("double")),
            F.col("limit").cast("double"),
        ).alias("target"),
    )


def due(place: Column, target: Column, w0: Column, w1: Column) -> Column:
    """When, from 0 to 1, a source's cumulative demand reaches ``place`` of ``target`` words."""
    demand = place / F.nullif(target, F.lit(0.0)) * (w0 + w1) / 2
    return 2 * demand / (w0 + F.sqrt(w0 * w0 + 2 * (w1 - w0) * demand))


def curriculum(docs: DataFrame, keep=(), schedules=SCHEDULES, share=SHARE, repeats=MOST_REPEATS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text, source`` and the columns in ``keep``).

    Weights must be above 0. A kept column that is named like one of the new ones is left out. Adds ``size, source_size, target, takes``: an array of ``(copy, words, position)``, one for each
    time the document comes up. The last one at the target's edge takes only the words still due.
    Null text has size 0, a null source is a source of its own and comes last. Rows with the same
    ``doc_id`` are separate documents; which of them comes first does not change the result's rows.
    Documents without words are taken 0 times. Without documents there are no rows.
    """
    new = ("size", "source_size", "target", "takes")
    keep = [c for c in keep if c not in ("doc_id", "source", *new)]
    mixed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own, none = F.coalesce("source", F.lit("")).alias("own"), F.col("source").isNull().alias("none")
    sized = docs.select(
        "doc_id", F.col("source").alias("source"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"),
        word_count(F.col("text")).alias("size"), mixed.alias("shuffled"),
        F.substring(mixed, 1, BUCKET_DIGITS).alias("bucket"),
        own, none,
    )
    slim = docs.select(
        F.col("source"), word_count(F.col("text")).alias("size"), F.substring(mixed, 1, BUCKET_DIGITS).alias("bucket"))
    parts = slim.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    sources = parts.groupBy("source").agg(F.sum("part").alias("source_size"))
    targets = source_targets(sources, schedules, share, repeats)
    earlier = Window.partitionBy("own", "none").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.select(own, none, "bucket", "part")
        .join(targets.select(own, none, "source_size", "target", "w0", "w1"), ["own", "none"])
        .select("*", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("offset")).drop("part")
    )
    running = Window.partitionBy("own", "none", "bucket").orderBy("shuffled", "doc_id", "size")
    placed = (
        sized.withColumn("inner", F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(offsets, ["own", "none", "bucket"])
        .withColumn("start", F.col("offset") + F.col("inner"))
    )
    words = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    rest = F.least(F.col("size"), F.greatest(F.lit(0), words - F.col("passes") * F.col("source_size") - F.col("start")))
    take = lambda copy, amount: F.struct(
        copy.cast("int").alias("copy"), amount.cast("long").alias("words"),
        due(copy * F.col("source_size") + F.col("start") + amount / 2, F.col("target"),
            F.col("w0"), F.col("w1")).alias("position"))
    takes = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.col("passes").cast("int")),
            lambda k: take(k, F.when(k < F.col("passes"), F.col("size")).otherwise(F.col("rest")))),
        lambda t: t["words"] > 0)
    return (
        placed.withColumn("passes", passes).withColumn("rest", rest)
        .select("doc_id", "source", *[F.col("kept")[c].alias(c) for c in keep],
                "size", "source_size", "target", takes.alias("takes"))
    )


def training_order(plan: DataFrame) -> DataFrame:
    """One row per take, range-sorted by position: part files in name order are the training order."""
    rest = [c for c in plan.columns if c != "takes"]
    return (
        plan.select(*rest, F.explode("takes").alias("take"))
        .select(*rest, "take.copy", F.col("take.words").alias("taken"), "take.position")
        .orderBy("position", "source", "doc_id", "copy")
    )
