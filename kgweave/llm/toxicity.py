"""Toxicity from class-conditional Kneser-Ney letter models.

Words are runs of letters, in lower case. Each class, toxic and ordinary, has a model that predicts a
word letter by letter, its end included, from the ``ORDER - 1`` letters before. The counts of a class
are discounted, and what the discount frees goes to one lower model that both classes share: it counts
in how many different contexts a letter follows, at every shorter length down to the bare alphabet. So
a rare or new form of a known expression is judged by the letters that it shares with known ones, and
letters that neither class has seen there cancel out.

The two log-likelihoods of a word are compared per predicted letter, and a text is judged by the word
that speaks most for the toxic class: a mean over all words would hide one insult in a long text, and
the noise of the counts grows with the text. Labelled rows of one part (``CALIBRATION``) are judged by a
model learned without them; a logistic curve through their labels turns the difference into a score. The
final model is learned from all parts.

What the models count is a table of all words with their counts, so it grows with the input; n-grams
and Kneser-Ney sums are made from it with DataFrame operations. The finished model is a table of
n-grams, broadcast in slices of about ``SLICE_ROWS`` rows, 16 bytes each. A task that meets more than one
slice holds one at a time and adds up, so a large model costs time, not memory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.llm.tables import Scratch

ORDER = 4
DISCOUNT = 0.75
KEEP_OUT = 2  # remainder modulo 4 of the rows whose labels are not learned
CALIBRATION = 3  # remainder of the labelled rows that set the score
SLICE_ROWS = 2_000_000
BIN = 1e-3  # width of the bins in which the calibration counts its texts
MOST_BINS = 20_000  # on either side of 0; beyond, differences count alike
THRESHOLD = 0.3
BROADCAST_LABELS = 2_000_000  # rows of an id and a label
START, END = "\x02", "\x03"
PIECE = 1 << 20  # code points of a text whose words are listed at once
CACHED_WORDS = 200_000  # words that a task remembers
LEARNED_WORDS = 10_000  # words whose n-grams are spelled out at once
BATCH_ROWS = 1000

_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 4).cast("int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == KEEP_OUT, F.lit(False))


def words(text: str | None) -> Iterator[list[str]]:
    """The words of a text, a bounded piece at a time; words are never cut."""
    text, at = (text or "").lower(), 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
        stop = gap.start() if gap else len(text)
        yield _WORD.findall(text, at, stop)
        at = stop


def vocabulary(labelled: DataFrame) -> DataFrame:
    """``(word, toxic, fold, n)`` over all rows of ``text, toxic, fold``; tasks add up before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def flushed():
            return pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["word", "toxic", "fold", "n"])

        for batch in batches:
            for text, toxic, part in zip(batch["text"], batch["toxic"], batch["fold"]):
                for some in words(text):
                    for word, n in Counter(some).items():
                        counts[word, toxic, part] += n
                    if len(counts) > CACHED_WORDS:
                        yield flushed()
                        counts.clear()
        if counts:
            yield flushed()

    rows = labelled.where(F.col("text").isNotNull()).select("text", "toxic", "fold")
    return rows.mapInPandas(run, "word string, toxic int, fold int, n long").groupBy("word", "toxic", "fold").agg(
        F.sum("n").alias("n"))


def ngrams(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """``(gram, toxic, fold, n)``: the letters of every word and its end, each with ``order - 1`` before it."""
    padded = F.concat(F.lit(START * (order - 1)), F.col("word"), F.lit(END))
    spot = F.explode(F.sequence(F.lit(1), F.length("word") + 1))
    return (
        counted.select("toxic", "fold", "n", padded.alias("padded"), spot.alias("spot"))
        .select(F.substring(F.col("padded"), F.col("spot"), F.lit(order)).alias("gram"), "toxic", "fold", "n")
        .groupBy("gram", "toxic", "fold").agg(F.sum("n").alias("n"))
    )


def _context(gram: str = "gram") -> Column:
    return F.substring(F.col(gram), F.lit(1), F.length(gram) - 1)


def shared_model(grams: DataFrame, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """``(gram, shared)``: what the shared lower model gives the last letter of every known gram.

    The model of length k counts the different letters before each gram of length k, and passes its
    discount on to length k - 1; below length 1 all known letters are alike.
    """
    level, levels = grams.select("gram").distinct(), []
    for _ in range(order - 1):
        level = scratch.keep(level.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")))
        levels.append(level)
    lowest = 1.0 / (levels[-1].count() + 1)
    below = None
    for level in reversed(levels):
        sums = level.groupBy(_context().alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        rows = level.withColumn("context", _context()).join(sums, "context")
        if below is None:
            rows = rows.withColumn("lower", F.lit(lowest))
        else:
            rows = rows.withColumn("rest", F.expr("substring(gram, 2)")).join(
                below.select(F.col("gram").alias("rest"), F.col("shared").alias("lower")), "rest")
        below = rows.select("gram", (
            (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("lower"))
            / F.col("total")).alias("shared"))
    tails = below.withColumnRenamed("gram", "rest")
    return grams.select("gram").distinct().withColumn("rest", F.expr("substring(gram, 2)")).join(tails, "rest").select(
        "gram", "shared")


def differences(grams: DataFrame, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """A stored table ``(context, letter, delta)`` from ``(gram, toxic, n)``.

    ``delta`` is the toxic minus the ordinary log probability of the letter after the context. The row
    with a null letter is for letters that neither class has seen there: the shared model cancels out.
    Contexts that are not listed have difference 0.
    """
    both = grams.groupBy("gram").agg(*[
        F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    both = scratch.keep(both.withColumn("context", _context()))
    sums = both.groupBy("context").agg(
        *[F.sum(f"n{k}").alias(f"total{k}") for k in (0, 1)],
        *[F.sum((F.col(f"n{k}") > 0).cast("long")).alias(f"kinds{k}") for k in (0, 1)])

    def freed(k: int) -> Column:
        total = F.col(f"total{k}")
        return F.when(total > 0, DISCOUNT * F.col(f"kinds{k}") / total).otherwise(1.0)

    def probability(k: int) -> Column:
        total = F.col(f"total{k}")
        own = F.when(total > 0, F.greatest(F.col(f"n{k}") - DISCOUNT, F.lit(0.0)) / total).otherwise(0.0)
        return own + freed(k) * F.col("shared")

    seen = both.join(sums, "context").join(shared_model(both, scratch, order), "gram").select(
        "context", F.expr("right(gram, 1)").alias("letter"), (F.log(probability(1)) - F.log(probability(0))).alias("delta"))
    other = sums.select("context", F.lit(None).cast("string").alias("letter"),
                        (F.log(freed(1)) - F.log(freed(0))).alias("delta"))
    return scratch.keep(seen.unionByName(other))


def _keys(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points, by fixed random odd factors."""
    factors = np.random.default_rng(points.shape[1]).integers(0, 1 << 63, points.shape[1], dtype=np.uint64) * 2 + 1
    return (points.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _packed(rows: list[tuple[str, float]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of strings of the same length, ascending, and their values."""
    keys = _keys(_points("".join(r[0] for r in rows)).reshape(-1, length))
    order = np.argsort(keys)
    return keys[order], np.array([r[1] for r in rows])[order]


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: np.ndarray | float) -> np.ndarray:
    known, values = table
    if not len(known):
        return np.broadcast_to(missing, keys.shape)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], missing)


class _Judge:
    """Length-normalised differences of words, as far as this task has met them."""

    def __init__(self, slices: list, order: int):
        self.slices, self.order = slices, order
        self.known: dict[str, float] = {}

    def _hashed(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words' n-grams and of their contexts, where each word's begin, and how many it has."""
        padded = _points("".join(START * (self.order - 1) + word + END for word in new))
        letters = np.array([len(word) + 1 for word in new])
        ends = np.cumsum(letters)
        at = np.arange(ends[-1]) + np.repeat(np.arange(len(new)) * (self.order - 1), letters)
        grams = padded[at[:, None] + np.arange(self.order)]
        return _keys(grams), _keys(grams[:, :-1]), ends - letters, letters

    def _learn(self, new: list[str]) -> None:
        # the n-grams of a few words at a time; only their hashes are kept until all slices are read
        parts = [self._hashed(new[at:at + LEARNED_WORDS]) for at in range(0, len(new), LEARNED_WORDS)]
        totals = [np.zeros(len(letters)) for *_, letters in parts]
        for sent in self.slices:
            seen, other = sent.value
            for total, (keys, contexts, starts, _) in zip(totals, parts):
                total += np.add.reduceat(_found(seen, keys, _found(other, contexts, 0.0)), starts)
            if len(self.slices) > 1:  # let go of the slice; the next use reads it again
                sent.__dict__.pop("_value", None)
        means = np.concatenate([total / letters for total, (*_, letters) in zip(totals, parts)])
        self.known.update(zip(new, means.tolist()))

    def worst(self, texts: list[str | None]) -> list[float | None]:
        """The largest difference among each text's words; None without a word."""
        found: list[float | None] = [None] * len(texts)

        def settle(waiting):
            if len(self.known) > CACHED_WORDS:
                self.known.clear()
            new = list(set().union(*(own for _, own in waiting)) - self.known.keys())
            if new:
                self._learn(new)
            for i, own in waiting:
                most = max(map(self.known.__getitem__, own))
                found[i] = most if found[i] is None else max(found[i], most)

        waiting, size = [], 0
        for i, text in enumerate(texts):
            for some in words(text):
                if some:
                    waiting.append((i, set(some)))
                    size += len(waiting[-1][1])
                if size > CACHED_WORDS:
                    settle(waiting)
                    waiting, size = [], 0
        if waiting:
            settle(waiting)
        return found


def _judging(slices: list, order: int):
    @F.pandas_udf("double")
    def worst(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _Judge(slices, order)
        for texts in batches:
            found: list[float | None] = []
            for at in range(0, len(texts), BATCH_ROWS):
                found += own.worst(texts.iloc[at:at + BATCH_ROWS].tolist())
            yield pd.Series(found, dtype=object)
    return worst


def with_worst(docs: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``docs`` with ``_worst``: the largest length-normalised difference among the words of ``text``, or null.

    ``model`` holds ``differences`` in a stored table. A context's rows are all in one slice, as its hash says.
    """
    spark = docs.sparkSession
    number = max(1, -(-model.count() // SLICE_ROWS))
    part, slices = F.pmod(F.xxhash64("context"), F.lit(number)), []
    for i in range(number):
        rows = model.where(part == i).select("context", "letter", "delta").collect()
        seen = [(r.context + r.letter, r.delta) for r in rows if r.letter is not None]
        other = [(r.context, r.delta) for r in rows if r.letter is None]
        slices.append(spark.sparkContext.broadcast((_packed(seen, order), _packed(other, order - 1))))
    return docs.withColumn("_worst", _judging(slices, order)(F.col("text")))


def curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Offset and slope of the logistic curve through ``(difference, texts, toxic texts)``.

    Newton steps on the likelihood with one invented text of each class at either end, so that classes
    that do not overlap still have a finite slope.
    """
    at = np.array([b[0] for b in bins], float)
    low, high = at.min() - BIN, at.max() + BIN
    x = np.concatenate((at, [low, low, high, high]))
    n = np.concatenate(([b[1] for b in bins], np.ones(4)))
    hits = np.concatenate(([b[2] for b in bins], [0, 1, 0, 1]))
    scale = max(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)), 1e-12)
    design = np.stack((np.ones_like(x), x / scale), axis=1)

    def loss(beta):
        logit = design @ beta
        return float((n * np.logaddexp(0, logit) - hits * logit).sum())

    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -700, 700)))
        slope = design.T @ (n * p - hits)
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-9 * np.eye(2), slope)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1] / scale)


def _calibrate(judged: DataFrame) -> tuple[float, float] | None:
    """The curve from rows of ``toxic, _worst``, counted in bins of equal width; None without a word."""
    place = F.greatest(F.least(F.round(F.col("_worst") / BIN), F.lit(float(MOST_BINS))), F.lit(-float(MOST_BINS)))
    rows = (judged.where(F.col("_worst").isNotNull()).groupBy(place.alias("bin"))
            .agg(F.count("*").alias("n"), F.sum(F.col("toxic")).alias("hits")).orderBy("bin").collect())
    return curve([(r.bin * BIN, r.n, r.hits) for r in rows]) if rows else None


def score(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``, which replace columns of those names.

    ``docs`` has at least ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``toxic`` (0, 1; null says
    nothing). Several labels of one id count as toxic if any does. Null ids have no label and are not
    held out. Rows with the same id are learned and judged each on its own text. Null texts and texts
    without a letter get the share of toxic rows among the learned ones. If the learned rows lack one
    of the classes, every row gets that share; without learned rows it is 0. Columns of ``labels``
    other than the two are not read. Very long texts are read whole, in pieces.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    judged = docs.select(F.struct("*").alias("given"), "doc_id", "text")
    known = scratch.keep(labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("toxic")))
    if known.count() <= BROADCAST_LABELS:  # texts then stay where they are; beyond, both sides are shuffled
        known = F.broadcast(known)
    own = fold(F.col("doc_id"))
    labelled = docs.select("doc_id", "text").where(own != KEEP_OUT).join(known, "doc_id").select(
        "text", "toxic", own.alias("fold"))
    totals = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    answer = F.lit(float(share))
    if len(totals) == 2:
        counted = scratch.keep(vocabulary(labelled))
        grams = scratch.keep(ngrams(counted, order))
        first = differences(grams.where(F.col("fold") != CALIBRATION), scratch, order)
        model = differences(grams, scratch, order)
        fit = _calibrate(with_worst(labelled.where(F.col("fold") == CALIBRATION), first, order))
        # a corpus so small that its calibration part has no text is judged by the curve of all learned rows
        offset, slope = fit or _calibrate(with_worst(labelled, model, order)) or (math.log(share / (1 - share)), 0.0)
        judged = with_worst(judged, model, order)
        scratch.drop(counted, grams, first, model)
        answer = F.when(
            F.col("_worst").isNotNull(), 1 / (1 + F.exp(-(F.lit(offset) + F.lit(slope) * F.col("_worst"))))).otherwise(answer)
    return judged.select(
        "given.*", held_out(F.col("doc_id")).alias("held_out"), answer.alias("score"),
        (answer >= THRESHOLD).cast("int").alias("predicted"))
