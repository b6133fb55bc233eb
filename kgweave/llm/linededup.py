"""Line dedup: suffixes of line sequences sorted by distributed prefix doubling.

All documents' lines form one long sequence of line ids. Prefix doubling sorts its suffixes: ranks that
order them by their first h lines give, in pairs ``(rank at i, rank at i + h)``, the order by 2h lines.
Suffixes with the same rank at depth h form an interval of the suffix array whose longest common prefix
is at least h; an interval of one suffix is settled and leaves the next rounds, and so does every suffix
that meets a settled one on its way. The doubling ends at the depth of the shortest run that counts:
the intervals there hold every start of a repeated run, and a longer maximal run is the chain of such
starts one line apart.

In each interval the first suffix in document order is the original. Lines covered by the others are
later copies and are deleted.

A rank is the place of a distinct pair in a range-sorted table, so a frequent line is one row when it
is sorted. Handing ranks back to the lines joins frequent keys by broadcast (at most 1000 of them), so
that a line found in a third of all documents stays where it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgweave.llm.tables import Scratch
from kgweave.plans.skew import HEAVY_SHARE, join_counted

MIN_LINES = 3
MOST_LOST = 0.5


def _rank(rows: DataFrame, keys: list[str], scratch: Scratch, spare: list[DataFrame]) -> DataFrame:
    """``rows`` whose keys occur at least twice, with ``rank`` in key order and the key's count ``n``."""
    stored = scratch.keep(rows)
    classes = (
        stored.groupBy(*keys).agg(F.count("*").alias("n"), F.min("place").alias("original")).where(F.col("n") > 1)
        .repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("rank", F.monotonically_increasing_id())
    )
    classes = scratch.keep(classes)
    spare += [stored, classes]
    return join_counted(stored, classes, keys, max(stored.count(), HEAVY_SHARE)).drop(*keys, "n")


def repeated_runs(lines: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES) -> DataFrame:
    """``row, pos`` of each suffix whose first ``min_lines`` lines occur earlier as well.

    ``lines`` has ``place`` (a struct that orders all lines and ends in ``row, pos``), ``row``, ``pos``
    (0, 1, ... within the row), and the line's two 64-bit hashes ``h1, h2``.
    """
    spare: list[DataFrame] = []
    ranked = _rank(lines.select("place", "row", "pos", "h1", "h2"), ["h1", "h2"], scratch, spare)
    depth = 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        ahead = Window.partitionBy("row").orderBy("pos").rangeBetween(step, step)
        pairs = (
            ranked.select("place", "row", "pos", F.col("rank").alias("r1"), F.max("rank").over(ahead).alias("r2"))
            .where(F.col("r2").isNotNull())
        )
        ranked = _rank(pairs, ["r1", "r2"], scratch, spare)
        depth += step
    result = scratch.keep(ranked.where(F.col("place") != F.col("original")).select("row", "pos"))
    scratch.drop(*spare)
    return result


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` without later copies of line runs, plus ``n_lines``, ``n_removed`` and ``lost``.

    Lines are split at ``\\n``; blank ones are passed over when runs are compared and are never deleted.
    A run counts from ``min_lines`` lines on, and may repeat within one document. The original is the
    one with the smallest ``doc_id`` (null ids last; among rows with the same id, the one read first),
    and the earliest within it. ``n_lines`` and ``n_removed`` count lines that are not blank, ``lost``
    is the removed share of their characters. Null text stays null, with 0 lines. Repeated rows are
    copies of each other. Columns named like the new ones are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    new = ("n_lines", "n_removed", "lost")
    names = [c for c in docs.columns if c not in new]
    packed = scratch.keep(docs.select(
        F.struct(*[c for c in names if c != "text"]).alias("doc"), "text", F.monotonically_increasing_id().alias("row")))
    filled = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    lines = (
        packed.select("row", F.col("doc.doc_id").alias("id"), F.posexplode(filled).alias("pos", "line"))
        .select(
            F.struct(F.col("id").isNull().alias("none"), "id", "row", "pos").alias("place"), "row", "pos",
            F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2"))
    )
    copies = (
        repeated_runs(lines, scratch, min_lines)
        .groupBy("row").agg(F.collect_list("pos").alias("starts"))
    )
    gone = F.array_distinct(F.flatten(F.transform(
        F.col("starts"), lambda s: F.sequence(s, s + F.lit(min_lines - 1)))))
    parts = F.split("text", "\n")
    # by hash at every size, so that texts are shuffled once and never sorted
    joined = (
        packed.join(copies.hint("shuffle_hash"), "row", "left")
        .withColumn("lines", F.when(F.col("starts").isNotNull(), parts))
        .withColumn("full", F.filter(F.sequence(F.lit(0), F.size("lines") - 1),
                                     lambda i: F.trim(F.col("lines")[i]) != ""))
        .withColumn("out", F.transform(gone, lambda g: F.col("full")[g]))
        .withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("out")))
    )
    chars = lambda at: F.aggregate(
        at, F.lit(0).cast("long"), lambda n, i: n + F.length(F.col("lines")[i]))
    changed = F.col("starts").isNotNull()
    text = F.when(changed, F.array_join(F.transform("left", lambda i: F.col("lines")[i]), "\n")).otherwise(F.col("text"))
    result = F.struct(
        text.alias("text"),
        F.when(changed, F.size("full")).when(F.col("text").isNull(), 0).otherwise(F.size(filled)).cast("long").alias("n_lines"),
        F.when(changed, F.size("out")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(changed, chars(F.col("out")) / F.nullif(chars(F.col("full")), F.lit(0))).otherwise(F.lit(0.0)).alias("lost"),
    )
    # From a generator, so that no filter on these columns is rewritten into one that splits the text for each line.
    made = joined.select("doc", F.explode(F.array(result)).alias("made"))
    return made.select(
        *[F.col("made.text") if c == "text" else F.col("doc")[c].alias(c) for c in names],
        "made.n_lines", "made.n_removed", "made.lost")


def drop_copied(docs: DataFrame, min_lines: int = MIN_LINES, most_lost: float = MOST_LOST) -> DataFrame:
    """``docs`` (same columns) with copied runs deleted.

    A document that loses more than ``most_lost`` of its characters is itself a later copy: what is
    left of it are the few lines in which a near copy differs, so it goes as a whole.
    """
    return dedup_lines(docs, min_lines).where(F.col("lost") <= most_lost).select(*docs.columns)
