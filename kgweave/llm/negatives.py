"""Hard negatives by inner product, with coordinate pruning after LEMP.

Rows are sorted by length (``repartitionByRange``; equal lengths spread by id), and up to ``BUCKET``
consecutive rows become a length bucket: their vectors and, for every coordinate of the vectors scaled to
length 1, the list of rows sorted by it. A bucket is one row of a stored index, built once.

An anchor asks a bucket for rows with an inner product of at least t. Divided by the anchor's length and
the bucket's greatest length this is a least cosine. It bounds what the ``FOCUS`` coordinates in which the
anchor is largest may be: where the anchor's coordinate is cos a and the least cosine cos g, a row's
coordinate is between cos(a + g) and cos(a - g). The rows inside such a range are a slice of a sorted list;
the slices are intersected and what is left is verified by exact inner products. A bucket whose rows are
all too short is skipped whole. Where every slice holds most of a bucket, intersecting would cost more than it
saves, and all rows of the bucket are verified, for all such anchors in one matrix product.

Least scores come from the ``SEEDS`` buckets of the longest rows, which every anchor meets first: the
k-th best score found there can only be exceeded, so nothing is lost by asking for no less. Anchors go to the
tasks in blocks of about ``ANCHORS`` rows, each a broadcast of bounded size, against all buckets; a bucket
answers with its best few rows per question. Exactness does not depend on any of these numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgweave.llm.tables import Scratch, shuffles

BUCKET = 2048
FOCUS = 4
SEEDS = 4
ANCHORS = 8192
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH, WHOLE = 30, 90, 100  # a negative's score is between LOW and HIGH of WHOLE parts of the positive's
SLACK = 1e-6  # widens ranges against rounding; candidates are verified exactly
CHUNK = 256  # anchors that are verified at once
NO_ID = WIDEST = np.iinfo(np.int64).max

INDEX = "rows binary, ids binary, labels binary, vectors binary, lists binary, n int, longest double"
ANSWER = "question long, row long, id long, score long"


def scaled(vector: Column, factor: int) -> Column:
    """``floor(factor * x)`` of each component as long; null if one is null, not finite or beyond a long."""
    limit = F.lit(2.0 ** 62 / factor)
    values = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(values, lambda x: F.coalesce(F.abs(x) < limit, F.lit(False)))
    return F.when(fine, F.transform(values, lambda x: F.floor(F.lit(float(factor)) * x)))


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(float) ** 2).sum(axis=1))


def _units(vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(lengths, 1e-300)[:, None]


def _matrix(vectors, dims: int, kind: str) -> np.ndarray:
    """One row per vector; shorter ones are filled with zeros."""
    found = np.zeros((len(vectors), dims), kind)
    for at, v in enumerate(vectors):
        found[at, :len(v)] = v
    return found


def _packer(dims: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BUCKET):
                part = batch.iloc[at:at + BUCKET]
                vectors = _matrix(part["vector"], dims, kind)
                lengths = _lengths(vectors)
                lists = np.argsort(_units(vectors, lengths).T, axis=1, kind="stable").astype(np.uint16)
                yield pd.DataFrame([(
                    *(part[c].to_numpy(np.int64).tobytes() for c in ("row", "id", "label")),
                    vectors.tobytes(), lists.tobytes(), len(part), float(lengths.max()))],
                    columns=["rows", "ids", "labels", "vectors", "lists", "n", "longest"])
    return run


class Questions:
    """Anchors and what they ask for: rows of the own or of another label with scores from ``low`` to ``high``.

    Question i belongs to anchor ``anchor[i]`` and wants its ``best`` rows, by score and then by id.
    """

    def __init__(self, anchors: dict[str, np.ndarray], same: bool, best: int,
                 anchor: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.rows, self.labels, self.vectors = anchors["row"], anchors["label"], anchors["vector"]
        self.same, self.best, self.anchor, self.low, self.high = same, best, anchor, low, high


def feasible(unit: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Focus coordinates of unit vectors, and the range of each that a row of the least cosine may have."""
    focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
    own = np.arccos(np.clip(np.take_along_axis(unit, focus, axis=1), -1, 1))
    turn = np.arccos(np.clip(least, -1, 1))[:, None]
    low, high = np.cos(np.minimum(own + turn, np.pi)), np.cos(np.maximum(own - turn, 0))
    return focus, low - SLACK, high + SLACK


def candidates(units: np.ndarray, lists: np.ndarray, asking: np.ndarray, least: np.ndarray) -> list[np.ndarray | None]:
    """For each asking unit vector the rows of a bucket inside all its ranges; None stands for all rows."""
    n = len(units)
    found: list[np.ndarray | None] = [None] * len(asking)
    chosen = np.flatnonzero(least > 0)
    if not len(chosen):
        return found
    focus, low, high = feasible(asking[chosen], least[chosen])
    first, last = np.zeros(focus.shape, np.int64), np.full(focus.shape, n)
    for f in np.unique(focus):
        values = units[lists[f], f]
        at = focus == f
        first[at] = np.searchsorted(values, low[at], "left")
        last[at] = np.searchsorted(values, high[at], "right")
    shortest = (last - first).argmin(axis=1)
    for i, spot in enumerate(chosen):
        k = shortest[i]
        if 2 * (last[i, k] - first[i, k]) >= n:
            continue
        rows = lists[focus[i, k], first[i, k]:last[i, k]]
        for other in range(focus.shape[1]):
            if other != k and len(rows):
                values = units[rows, focus[i, other]]
                rows = rows[(values >= low[i, other]) & (values <= high[i, other])]
        found[spot] = rows
    return found


def _scores(vectors: np.ndarray, others: np.ndarray, exact) -> np.ndarray:
    return vectors.astype(exact) @ others.astype(exact).T


def _verified(bucket, asked: Questions, exact) -> Iterator[tuple[np.ndarray, ...]]:
    """``(anchor, row of the bucket, score)`` of rows that pass pruning and are within the anchor's widest range."""
    lengths = _lengths(bucket["vectors"])
    units = _units(bucket["vectors"], lengths)
    total = len(asked.rows)
    low, high = np.full(total, WIDEST), np.full(total, -WIDEST)
    np.minimum.at(low, asked.anchor, asked.low)
    np.maximum.at(high, asked.anchor, asked.high)
    own = _lengths(asked.vectors)
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(low > 0, low / (own * bucket["longest"]), -1.0)
    alive = np.flatnonzero((low <= high) & ~(least > 1 + SLACK))
    for at in range(0, len(alive), CHUNK):
        part = alive[at:at + CHUNK]
        picks = candidates(units, bucket["lists"], _units(asked.vectors[part], own[part]), least[part])
        whole = np.array([a for a, rows in zip(part, picks) if rows is None], np.int64)
        if len(whole):
            scores = _scores(asked.vectors[whole], bucket["vectors"], exact)
            a, r = np.nonzero((scores >= low[whole, None]) & (scores <= high[whole, None]))
            yield whole[a], r, scores[a, r].astype(np.int64)
        for a, rows in zip(part, picks):
            if rows is not None and len(rows):
                scores = _scores(asked.vectors[a:a + 1], bucket["vectors"][rows], exact)[0]
                yield np.full(len(rows), a), rows.astype(np.int64), scores.astype(np.int64)


def _first(question: np.ndarray, score: np.ndarray, ids: np.ndarray, best: int) -> np.ndarray:
    """Places of each question's ``best`` entries, by descending score and ascending id."""
    order = np.lexsort((ids, -score, question))
    sorted_ = question[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.empty(0, np.int64)
    rank = np.arange(len(sorted_)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_)]))
    return order[rank < best]


def _answers(bucket, asked: Questions, exact) -> pd.DataFrame:
    """Each question's best rows of one bucket."""
    order = np.argsort(asked.anchor, kind="stable")
    begin = np.searchsorted(asked.anchor[order], np.arange(len(asked.rows) + 1))
    parts = []
    for anchor, row, score in _verified(bucket, asked, exact):
        fit = (asked.labels[anchor] == bucket["labels"][row]) == asked.same
        fit &= asked.rows[anchor] != bucket["rows"][row]
        anchor, row, score = anchor[fit], row[fit], score[fit]
        n = begin[anchor + 1] - begin[anchor]  # an entry counts for each question of its anchor that it fits
        entry = np.repeat(np.arange(len(anchor)), n)
        question = order[begin[anchor][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)]
        fit = (score[entry] >= asked.low[question]) & (score[entry] <= asked.high[question])
        entry, question = entry[fit], question[fit]
        keep = _first(question, score[entry], bucket["ids"][row[entry]], asked.best)
        entry = entry[keep]
        parts.append(pd.DataFrame({"question": question[keep], "row": bucket["rows"][row[entry]],
                                   "id": bucket["ids"][row[entry]], "score": score[entry]}))
    found = pd.concat(parts) if parts else pd.DataFrame({c: pd.Series([], dtype=np.int64) for c in ("question", "row", "id", "score")})
    keep = _first(found["question"].to_numpy(), found["score"].to_numpy(), found["id"].to_numpy(), asked.best)
    return found.iloc[keep]


def ask(index: DataFrame, asked: Questions, dims: int, kind: str, exact) -> DataFrame:
    """``ANSWER`` rows: every bucket's best for every question."""
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                bucket = {
                    "rows": np.frombuffer(row.rows, np.int64), "ids": np.frombuffer(row.ids, np.int64),
                    "labels": np.frombuffer(row.labels, np.int64), "longest": row.longest,
                    "vectors": np.frombuffer(row.vectors, kind).reshape(row.n, dims),
                    "lists": np.frombuffer(row.lists, np.uint16).reshape(dims, row.n)}
                yield _answers(bucket, sent.value, exact)

    return index.mapInPandas(run, ANSWER)


def ranked(answers: DataFrame, best: int) -> DataFrame:
    """The ``best`` answers of each question with their ``rank`` from 1."""
    order = Window.partitionBy("question").orderBy(F.desc("score"), "id", "row")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _least(answers: DataFrame, asked: Questions) -> np.ndarray:
    """Each question's lowest useful score, given answers from some of the rows."""
    low = asked.low.copy()
    for r in ranked(answers, asked.best).where(F.col("rank") == asked.best).select("question", "score").collect():
        low[r.question] = max(low[r.question], r.score)
    return low


def _settled(index: DataFrame, seeds: DataFrame, asked: Questions, *form) -> DataFrame:
    asked.low = _least(ask(seeds, asked, *form), asked)
    return ranked(ask(index, asked, *form), asked.best)


def mine(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` (all long but the int rank).

    ``vectors`` has the columns ``vec_id`` (long), ``label`` (integer) and ``vector`` (array of long);
    other columns are not read. Rows with a null label, vector or component take no part. A shorter vector counts as
    filled up with zeros. Each row counts on its own, equal ones and equal ids too; null ids come last among
    equal scores, and a null ``is_anchor`` says no. An anchor without positives, or a positive without
    negatives, has no rows; a negative positive score allows none. Scores beyond what a long holds are
    refused (``ValueError``). Without rows the result is empty.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    good = F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    rows = vectors.where(good).select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.col("vector").cast("array<bigint>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        F.aggregate("vector", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double")).alias("square"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"), F.max("square").alias("square"),
                     F.count_if("asks").alias("anchors")).first()
    if (facts.square or 0) >= 2.0 ** 62:
        raise ValueError("inner products beyond what a long holds")
    dims, square = max(1, facts.dims or 0), facts.square or 0.0
    kind = "<i4" if square < 2.0 ** 60 else "<i8"
    exact = np.float32 if square < 2.0 ** 24 else np.float64 if square < 2.0 ** 53 else np.int64
    form = (dims, kind, exact)
    parts = -(-facts.n // BUCKET)
    parts = parts if parts <= shuffles(spark) else max(shuffles(spark), -(-parts // 32))
    spread = [F.col("square"), F.xxhash64("id"), F.xxhash64("vector", "label")]
    placed = scratch.keep(
        rows.repartitionByRange(max(1, parts), *spread).sortWithinPartitions(*spread)
        .withColumn("row", F.monotonically_increasing_id()))
    index = scratch.keep(placed.select("row", F.coalesce("id", F.lit(int(NO_ID))).alias("id"), "label", "vector")
                         .mapInPandas(_packer(dims, kind), INDEX))
    anchors = scratch.keep(placed.where("asks").select("row", "id", "label", "vector"))
    scratch.drop(placed)
    seeds = index.orderBy(F.desc("longest"), "rows").limit(SEEDS)
    names = "question long, anchor_id long, positive_id long, positive_score long"
    blocks, results = max(1, -(-facts.anchors * 4 // (3 * ANCHORS))), []
    for number in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).collect()
        if not own:
            continue
        asking = {"row": np.array([r.row for r in own], np.int64), "label": np.array([r.label for r in own], np.int64),
                  "vector": _matrix([r.vector for r in own], dims, kind)}
        every = np.arange(len(own))
        wide = np.full(len(own), -WIDEST), np.full(len(own), WIDEST)
        positives = _settled(index, seeds, Questions(asking, True, POSITIVES, every, *wide), *form).collect()
        questions = [(r.question, -(-LOW * r.score // WHOLE), HIGH * r.score // WHOLE) for r in positives]
        anchor, low, high = np.array(questions, np.int64).reshape(-1, 3).T
        found = _settled(index, seeds, Questions(asking, False, NEGATIVES, anchor, low, high), *form)
        known = spark.createDataFrame(
            [(i, own[r.question].id, None if r.id == NO_ID else r.id, r.score) for i, r in enumerate(positives)], names)
        results.append(scratch.keep(found.join(F.broadcast(known), "question").select(
            "anchor_id", "positive_id", "rank", F.nullif("id", F.lit(int(NO_ID))).alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"))))
    result = results[0] if results else spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for part in results[1:]:
        result = result.unionByName(part)
    return result
