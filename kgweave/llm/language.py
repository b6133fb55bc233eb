"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. A trigram is bound as the
product of its first letter's vector rotated twice, the second's rotated once, and the third's. A
text is the sum (bundle) of its trigrams' vectors, a language the sum over its training texts. The
prediction is the language whose prototype has the largest cosine with the text's vector.

Both passes run where the documents lie. Training sends one vector per language and task to the
shuffle, where they are added; the prototypes (languages x DIMENSIONS numbers) are all that is
broadcast. Texts are worked on in pieces of bounded size, so one very long text needs no more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
PIECE = 1 << 17  # code points that are counted at once
BLOCK = 1 << 13  # trigrams whose vectors are held at once
BATCH_ROWS = 128
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """Documents kept out of training: crc32 of the id as text leaves remainder 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Trigrams:
    """Trigram counts of texts, and the trigrams' vectors."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self._slot = np.full(0x110000, -1, np.int32)  # of a letter in the tables below
        self._other = np.zeros(0x110000, bool)  # code points that are known not to be letters
        self._turned = [np.empty((0, dimensions), np.int8) for _ in range(3)]
        self._learn(np.array([32]))

    def _learn(self, points: np.ndarray) -> None:
        fresh = [np.random.default_rng(int(p)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1 for p in points]
        self._slot[points] = np.arange(len(points)) + len(self._turned[0])
        for turns in range(3):
            own = np.roll(np.array(fresh, np.int8), turns, axis=1)
            self._turned[turns] = np.concatenate((self._turned[turns], own))

    def _letters(self, points: np.ndarray) -> np.ndarray:
        """The points with all that are not letters replaced by a space."""
        unseen = np.unique(points[(self._slot[points] < 0) & ~self._other[points]])
        if len(unseen):
            alpha = np.array([chr(p).isalpha() for p in unseen], bool)
            self._other[unseen[~alpha]] = True
            if alpha.any():
                self._learn(unseen[alpha])
        return np.where(self._other[points], 32, points)

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        """The trigrams of the text's letters, a piece at a time; a run of other characters is one space.

        The last two letters or spaces of a piece lead the next one, so the pieces' trigrams are the text's.
        """
        text, carried = text.lower(), np.array([32])
        for at in range(0, len(text), PIECE):
            points = np.frombuffer(text[at:at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            end = [32] if at + PIECE >= len(text) else []
            points = np.concatenate((carried, self._letters(points), end)).astype(np.int64)
            keep = np.ones(len(points), bool)
            keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
            points = points[keep]
            yield (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
            carried = points[-2:]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        first, second, third = codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF
        bound = self._turned[2][self._slot[first]] * self._turned[1][self._slot[second]]
        return (bound * self._turned[0][self._slot[third]]).astype(np.float32)

    def bundles(self, texts: list[str], rows: np.ndarray | None = None, n: int | None = None) -> np.ndarray:
        """The bundle of each text, or of the texts with the same number in ``rows``; zero without a letter."""
        rows = np.arange(len(texts)) if rows is None else rows
        total = np.zeros((len(texts) if n is None else n, self.dimensions))
        found, owners, size = [], [], 0
        for row, text in zip(rows, texts):
            for codes in self.pieces(text):
                found.append(codes)
                owners.append(row)
                size += len(codes)
                if size >= PIECE:
                    self._add(total, found, owners)
                    found, owners, size = [], [], 0
        if size:
            self._add(total, found, owners)
        return total

    def _add(self, total: np.ndarray, found: list[np.ndarray], owners: list[int]) -> None:
        codes, place = np.unique(np.concatenate(found), return_inverse=True)
        rows, own = np.unique(np.repeat(owners, [len(f) for f in found]), return_inverse=True)
        for at in range(0, len(codes), BLOCK):
            block = codes[at:at + BLOCK]
            inside = (place >= at) & (place < at + len(block)) if len(codes) > BLOCK else slice(None)
            cells = own[inside] * len(block) + place[inside] - at
            counts = np.bincount(cells, minlength=len(rows) * len(block)).reshape(len(rows), -1)
            total[rows] += counts.astype(np.float32) @ self.vectors(block)


def _trainer(dimensions: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, sums = Trigrams(dimensions), {}
        for batch in batches:
            for at in range(0, len(batch), BATCH_ROWS):
                part = batch.iloc[at:at + BATCH_ROWS]
                numbers, names = pd.factorize(part["lang"])
                bundles = counter.bundles(part["text"].tolist(), numbers, len(names))
                for lang, vector in zip(names, bundles):
                    sums[lang] = sums.get(lang, 0) + vector
        for lang, vector in sums.items():
            yield pd.DataFrame({"lang": lang, "at": np.arange(dimensions, dtype=np.int32), "value": vector})
    return run


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS) -> list[tuple[str, list[float]]]:
    """``(lang, vector)`` of each language with a letter in its texts, learned from all rows of ``text, lang``."""
    rows = (
        labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
        .mapInPandas(_trainer(dimensions), "lang string, at int, value double")
        .groupBy("lang", "at").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
        .select("lang", F.col("v.value").alias("v")).orderBy("lang").collect()
    )
    return [(r.lang, list(r.v)) for r in rows if any(r.v)]


def predict(docs: DataFrame, learned: list[tuple[str, list[float]]], dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` with the columns ``lang_pred`` and ``score``, which replace columns of those names.

    The score is the cosine, at least 0. Null texts, texts without a letter, and all texts where no
    language was learned are ``und`` with score 0. Equal cosines go to the language that comes first
    in code point order. Rows with the same id are judged each on its own text. Very long texts are read
    whole, in pieces. An empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    names = [lang for lang, _ in learned] or [UNDETERMINED]
    matrix = np.array([v for _, v in learned] or [[0.0] * dimensions])
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Trigrams(dimensions)
        for texts in batches:
            parts = []
            for at in range(0, len(texts), BATCH_ROWS):
                own = [t or "" for t in texts.iloc[at:at + BATCH_ROWS]]
                bundles = counter.bundles(own)
                length = np.linalg.norm(bundles, axis=1)
                cosine = (bundles @ matrix.T) / np.maximum(length, 1e-12)[:, None]
                best = cosine.argmax(axis=1)
                none = (length == 0) | (not learned)
                parts.append(pd.DataFrame({
                    "lang_pred": np.where(none, UNDETERMINED, np.array(names, object)[best]),
                    "score": np.where(none, 0.0, np.clip(cosine[np.arange(len(own)), best], 0.0, 1.0))}))
            yield pd.concat(parts) if parts else pd.DataFrame({"lang_pred": pd.Series([], dtype=object), "score": []})

    judged = docs.select(F.struct("*").alias("given"), judge(F.col("text")).alias("judged"))
    return judged.select("given.*", "judged.lang_pred", "judged.score")


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learn from the documents that are not held out and predict all, see ``predict``."""
    training = docs.where(~held_out(F.col("doc_id")))
    return predict(docs, prototypes(training, dimensions), dimensions)
