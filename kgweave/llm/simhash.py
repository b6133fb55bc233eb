"""SimHash near-duplicates by joining binary tries of fingerprints with themselves.

Fingerprints that differ in at most three of 64 bits agree in at least one of four blocks of 16 bits.
For each block the fingerprint is rotated so that the block comes first; its 16 bits are the top of a
binary trie, where two fingerprints must take the same path. Below that, pairs of trie nodes are
walked down together: going different ways costs one bit, and a pair of nodes is dropped as soon as it
has cost more than the budget. Small nodes are compared member by member.

Only distinct fingerprints enter the tries, so a group of exact copies is one entry. A block value
shared by very many fingerprints is dealt out as pairs of salted parts. A task reports for each of its
fingerprints the least one it is connected to, never pairs, so a dense group of n gives at most n - 1
links; these are joined into components over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.llm.tables import Scratch
from kgweave.operators.components import connected_components
from kgweave.plans.skew import HEAVY_SHARE, join_counted

SHINGLE = 3
MAX_BITS = 3
SEED = 42
LEAF = 256  # member pairs below which two trie nodes are compared directly
CHUNK = 1 << 17  # node pairs and links that are worked on at once
PART = 1 << 15  # fingerprints with one block value that a task takes

_digest = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]
    hashes = np.fromiter(map(_digest, shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[at:at + CHUNK, None].view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, name: str = "fingerprint", width: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a signed 64-bit number."""

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, fingerprints(F.col("text")))


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the groups of each ``i`` and ``j``; a group's label is its least member."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def trie_pairs(values: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted, distinct ``values`` that differ in at most ``budget`` bits.

    All values agree in their first ``depth`` bits. Node pairs wait on a stack in chunks, so memory is
    bounded by the depth of the trie, not by the number of pairs.
    """
    whole = np.array([0]), np.array([len(values)])
    stack = [(depth, *whole, *whole, np.zeros(1, np.int64))]
    while stack:
        depth, a0, a1, b0, b1, cost = stack.pop()
        sizes = (a1 - a0) * (b1 - b0)
        leaf = sizes <= LEAF
        if leaf.any():
            yield from _compare(values, a0[leaf], b0[leaf], (b1 - b0)[leaf], sizes[leaf], budget)
        go = ~leaf
        if not go.any():
            continue
        a0, a1, b0, b1, cost = a0[go], a1[go], b0[go], b1[go], cost[go]
        low = np.uint64(63 - depth)

        def half(start, end):
            bound = ((values[start] >> low) | np.uint64(1)) << low
            return np.clip(np.searchsorted(values, bound), start, end)

        am, bm = half(a0, a1), half(b0, b1)
        mirrored = a0 == b0  # a node with itself: its two mixed pairs are the same
        children = [
            np.stack(x) for x in (
                (a0, am, b0, bm, cost), (am, a1, bm, b1, cost), (a0, am, bm, b1, cost + 1),
                tuple(x[~mirrored] for x in (am, a1, b0, bm, cost + 1)))]
        pairs = np.concatenate(children, axis=1)
        pairs = pairs[:, (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= budget)]
        for at in range(0, pairs.shape[1], CHUNK):
            stack.append((depth + 1, *pairs[:, at:at + CHUNK]))


def _compare(values, a0, b0, widths, sizes, budget):
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for at in range(0, int(ends[-1]), CHUNK * 8):
        until = min(at + CHUNK * 8, int(ends[-1]))
        place = np.arange(at, until)
        node = np.searchsorted(ends, place, side="right")
        inner = place - starts[node]
        i, j = a0[node] + inner // widths[node], b0[node] + inner % widths[node]
        near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        if near.any():
            yield i[near], j[near]


def _linker(budget: int, block_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        values = rows["turned"].to_numpy().view(np.uint64)
        keys = rows[["turn", "block", "part_a", "part_b"]].to_numpy()
        order = np.lexsort((values, keys[:, 3], keys[:, 2], keys[:, 1], keys[:, 0]))
        values, keys = values[order], keys[order]
        fingerprints = rows["fp"].to_numpy()[order]
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        labels = np.arange(len(values))
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(values)]))
        sizes = ends - starts
        small = (sizes > 1) & (sizes * sizes <= LEAF)
        for i, j in _compare(values, starts[small], starts[small], sizes[small], (sizes * sizes)[small], budget) \
                if small.any() else ():
            unite(labels, i, j)
        for start, end in zip(starts[sizes * sizes > LEAF], ends[sizes * sizes > LEAF]):
            own = labels[start:end] - start
            for i, j in trie_pairs(values[start:end], block_bits, budget):
                unite(own, i, j)
            labels[start:end] = own + start
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        yield pd.DataFrame({"s": fingerprints[linked], "o": fingerprints[labels[linked]]})
    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS, part: int = PART) -> DataFrame:
    """``(s, o)`` links whose components are those of all fingerprints within ``max_bits`` bits.

    ``distinct`` has one row per fingerprint in column ``fp``.
    """
    blocks = max_bits + 1
    width = 64 // blocks
    turned = distinct.select(
        "fp", F.explode(F.array(*[_turned(k, width) for k in range(blocks)])).alias("t")).select("fp", "t.*")
    hot = (
        turned.groupBy("turn", "block").count().where(F.col("count") > part)
        .select("turn", "block", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # every pair of different parts meets in one task; pairs inside a part meet in several
    meetings = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != own),
        lambda x: F.struct(F.least(x, own).alias("a"), F.greatest(x, own).alias("b")))
    alone = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    dealt = turned.join(F.broadcast(hot), ["turn", "block"], "left").select(
        "fp", "turn", "turned", "block",
        F.explode(F.when(F.col("parts").isNull(), alone).otherwise(meetings)).alias("m"),
    ).select("fp", "turn", "turned", "block", F.col("m.a").alias("part_a"), F.col("m.b").alias("part_b"))
    return dealt.repartition("turn", "block", "part_a", "part_b").mapInPandas(
        _linker(max_bits, width), "s long, o long")


def _turned(turn: int, width: int) -> Column:
    by = turn * width
    value = F.col("fp") if not by else F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", 64 - by))
    return F.struct(
        F.lit(turn).alias("turn"), value.alias("turned"),
        F.shiftrightunsigned(value, 64 - width).alias("block"))


def group(rows: DataFrame, rank: Column, scratch: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` with ``least``: the smallest ``rank`` in the component of their fingerprint ``fp``.

    ``rows`` must be a stored table, as it is read several times. Ranks that are null do not count.
    """
    total = rows.count()
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min(rank).alias("first"), F.count("*").alias("n")))
    linked = scratch.keep(links(distinct.select("fp"), max_bits).distinct())
    members = scratch.keep(connected_components(linked))
    joined = members.withColumnRenamed("node", "fp")
    least = joined.join(distinct, "fp").groupBy("canonical").agg(F.min("first").alias("least"))
    summary = scratch.keep(
        distinct.join(joined.join(least, "canonical").select("fp", "least"), "fp", "left")
        .select("fp", "n", F.coalesce("least", "first").alias("least")))
    scratch.drop(distinct, linked, members)
    return join_counted(rows, summary, ["fp"], max(total, HEAVY_SHARE)).drop("n")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Texts that are null or have no words have fingerprint 0. Repeated rows and repeated ids each give
    a row. ``component_id`` is the smallest ``doc_id`` that is reachable over links; it is null only
    where the whole component has null ids.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(with_fingerprint(docs.select("doc_id", "text"), "fp", width).select("doc_id", "fp"))
    return group(rows, F.col("doc_id"), scratch, max_bits).select("doc_id", "fp", F.col("least").alias("component_id"))


def keep_first(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest ``doc_id``, null ids last.

    Of rows with the same id, the one that is read first stays. All columns are kept as they are.
    """
    scratch = Scratch(docs.sparkSession)
    packed = docs.select(F.struct(*docs.columns).alias("doc"), "text", F.monotonically_increasing_id().alias("row"))
    stored = scratch.keep(with_fingerprint(packed, "fp", width).drop("text"))
    rows = stored.select("row", "fp", F.col("doc.doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    firsts = group(rows, order, scratch, max_bits).where(F.col("least.row") == F.col("row")).select("row")
    return stored.join(firsts, "row", "left_semi").select("doc.*")
