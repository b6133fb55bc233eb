"""Benchmark decontamination: a prefix-filtered set join (DataFrame functions only).

A benchmark item is cut into windows of consecutive words. A document window matches only if it
holds all words of an item window, so a prefix of one word is enough to find every match, and the
rarest word of the whole corpus gives the fewest candidates. The prefix word's place in the item
window fixes where the document window must begin (positional bound); it must lie inside the
document (length bound); then the words themselves are compared.

The documents are read once to count the item words and once to match. Neither pass shuffles a
word: item words and windows are broadcast, in blocks whose size is measured first, so a larger
benchmark takes more passes and never a larger broadcast. Verification happens where the word was
found, before any row leaves the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.llm.tables import Scratch, plain_words

WINDOW = 10
BLOCK_BYTES = 8_000_000
BLOCK_ROWS = 100_000


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``window_id, words, items``: distinct windows and the items that have them.

    An item shorter than the window is one window; one without words has none.
    """
    words = items.select(F.col("item_id").cast("string").alias("item"), plain_words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    return (
        words.where(F.size("w") > 0)
        .select("item", "w", F.explode(starts).alias("start"))
        .select("item", F.slice("w", F.col("start"), F.lit(width)).alias("words"))
        .groupBy("words").agg(F.collect_set(F.struct("item")).alias("items"))
        .select(F.md5(F.concat_ws(" ", "words")).alias("window_id"), "words",
                F.col("items.item").alias("items"))
    )


def _blocks(table: DataFrame, key: str, size) -> int:
    """How many parts of the table are each small enough to be broadcast."""
    rows, total = table.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return 1 + max(rows // BLOCK_ROWS, total // BLOCK_BYTES)


def _block(table: DataFrame, key: str, n: int, k: int) -> DataFrame:
    return F.broadcast(table if n == 1 else table.where(F.pmod(F.xxhash64(key), F.lit(n)) == k))


def prefixes(docs: DataFrame, windows: DataFrame, scratch: Scratch) -> DataFrame:
    """Each window with its prefix: the word that is rarest in all documents, and its place."""
    parts = windows.select("window_id", F.posexplode("words").alias("at", "token"))
    vocabulary = scratch.keep(parts.select("token").distinct())
    n = _blocks(vocabulary, "token", F.octet_length("token") + 32)
    found = docs.select(F.explode(plain_words(F.col("text"))).alias("token"))
    counts = None
    for k in range(n):
        part = found.join(_block(vocabulary, "token", n, k), "token", "left_semi").groupBy("token").count()
        counts = part if counts is None else counts.unionByName(part)
    counts = scratch.keep(counts)
    rarest = (
        parts.join(counts, "token", "left")
        .groupBy("window_id")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "at")).alias("p"))
    )
    result = scratch.keep(
        windows.join(rarest, "window_id")
        .where(F.col("p.n") > 0)  # a window with a word that no document has occurs nowhere
        .select(F.col("p.token").alias("token"), F.col("p.at").alias("at"), F.col("words").alias("wanted"), "items"))
    scratch.drop(vocabulary, counts)
    return result


def contamination(docs: DataFrame, items: DataFrame, keep=("doc_id",), width: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: the columns in ``keep``, ``n_words``, ``spans`` and ``items``.

    ``spans`` are the distinct ``(start, length)`` of item windows found, ``items`` the ids (as
    strings, sorted) that have them. Null or empty text has no words and no hits; null items and
    items without words match nothing; item ids that repeat count once; rows with the same
    ``doc_id`` are judged each on its own text. Items without an id count as one, listed last as null. An
    empty benchmark hits nothing.
    """
    scratch = Scratch(docs.sparkSession)
    windows = scratch.keep(item_windows(items, width))
    wanted = prefixes(docs, windows, scratch)
    scratch.drop(windows)
    n = _blocks(wanted, "wanted", F.octet_length(F.concat_ws(" ", "wanted")) + F.size("items") * 24 + 64)
    words = (
        docs.select(*keep, F.monotonically_increasing_id().alias("_row"), plain_words(F.col("text")).alias("_words"))
        .select(*keep, "_row", "_words", F.size("_words").alias("_n"), F.posexplode_outer("_words").alias("_pos", "token"))
    )
    start = F.col("_pos") - F.col("at")
    length = F.size("wanted")
    match = F.when(
        F.col("at").isNull(), F.lit(False)
    ).otherwise(
        (start >= 0) & (start + length <= F.col("_n"))
        & (F.slice("_words", F.greatest(start + 1, F.lit(1)), length) == F.col("wanted")))
    found = None
    for k in range(n):
        keeps = F.coalesce(F.col("_pos") == 0, F.lit(True)) if k == 0 else F.lit(False)
        part = (
            words.join(_block(wanted, "wanted", n, k), "token", "left")
            .select(*keep, "_row", "_n", "_pos", match.alias("_hit"), start.alias("start"), length.alias("length"), "items")
            .where(F.col("_hit") | keeps)
            .select(*keep, "_row", "_n",
                    F.when(F.col("_hit"), F.struct("start", "length")).alias("span"),
                    F.when(F.col("_hit"), F.col("items")).alias("items"))
        )
        found = part if found is None else found.unionByName(part)
    return (
        found.groupBy("_row", *keep)
        .agg(F.max("_n").cast("long").alias("n_words"), F.collect_set("span").alias("spans"),
             F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .drop("_row")
    )


def covered(spans) -> Column:
    """How many words lie in at least one of the ``(start, length)`` spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
    return F.aggregate(
        F.array_sort(spans), zero,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(
                F.lit(0), s["start"] + s["length"] - F.greatest(s["start"], acc["end"])).cast("long")).alias("n"),
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end")),
        lambda acc: acc["n"])


def remove_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without those that hold an item window; all their columns are kept.

    Contamination depends on the text alone, so documents are matched to findings by its digest.
    """
    digest = F.md5(F.col("text"))
    bad = contamination(docs.withColumn("_digest", digest), items, keep=("_digest",), width=width)
    bad = bad.where(F.size("spans") > 0).select("_digest").distinct()
    return docs.withColumn("_digest", digest).join(bad, "_digest", "left_anti").select(*docs.columns)
