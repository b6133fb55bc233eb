"""Quality rules by weak supervision.

Each rule looks at one count of a text and votes good, bad, or not at all. A rule that looks for one
defect does not vote good where the defect is missing. How far a rule can be trusted is not set by hand:
expectation-maximisation over all documents estimates how often it votes either way on good and on bad
texts, together with the share of good texts. A document is kept if its posterior probability of being
good is high enough: a vote that good texts often get too does not sink it, one that they never get does.

Documents enter the estimation as counts of vote patterns. There are at most 3 ** (number of rules) of
them, however many documents there are; that table is all that reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.llm.tables import Scratch

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
LETTERS = bytes(b for b in range(256) if b >= 128 or chr(b).isalpha())
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
NO_LETTERS = bytes(b for b in range(256) if b not in LETTERS and chr(b) not in WHITE)
ENDINGS = (".", "!", "?", ":", ";", '"', "”", "»", ")", "…", "。")

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
KEEP_FROM = 0.5
ROUNDS = 200
PRIOR = 0.5  # added to each count of votes
START_GOOD, START_BAD = 0.9, 0.1  # first guess for texts without and with a vote for bad

# count per unit, and the share from which a rule votes bad
DEFECTS = {
    "symbols": ("n_symbols", "n_words", 0.2),
    "repeats": ("n_repeat_words", "n_words", 0.3),
    "dup_lines": ("n_dup_lines", "n_lines", 0.4),
    "capitals": ("n_capitals", "n_letters", 0.3),
    "bare_words": ("n_bare_words", "n_words", 0.25),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_capitals", "n_letters", "n_open_lines", "n_bare_words")


def measure(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of a text; all 0 for null.

    ``n_repeat_words`` counts the words inside 3-word windows that occur at least twice, the first
    occurrence included; ``n_dup_lines`` the lines with a word that equal an earlier line.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        starts = np.flatnonzero(np.fromiter((often[w] > 1 for w in windows), bool, len(windows)))
        inside = np.zeros(len(words), bool)
        for k in range(3):
            inside[starts + k] = True
        repeated = int(inside.sum())
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    letters = raw.translate(None, NO_LETTERS)
    return (
        len(words), len(text) - sum(text.count(w) for w in WHITE), sum(text.count(s) for s in SYMBOLS),
        len(lines) - len(set(lines)), repeated, len(lines),
        len(raw) - len(raw.translate(None, CAPITALS)),
        sum(map(len, letters.split())), sum(not line.rstrip(WHITE).endswith(ENDINGS) for line in lines),
        len(words) - len(letters.split()),
    )


def measured(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and the ``COUNTS`` of ``text``, one row per row of ``docs``."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=list(COUNTS))

    return docs.select(*keep, counts(F.col("text")).alias("_m")).select(*keep, "_m.*")


def votes() -> dict[str, Column]:
    """1 for good, -1 for bad, 0 for no vote; a text without words or lines gets none from shares of them."""
    found = {
        name: F.when((F.col(unit) > 0) & (F.col(count) >= F.col(unit) * F.lit(bad)), -1).otherwise(0)
        for name, (count, unit, bad) in DEFECTS.items()
    }
    found["word_length"] = (
        F.when(F.col("n_words") == 0, 0)
        .when((F.col("word_chars") < F.col("n_words") * 3) | (F.col("word_chars") > F.col("n_words") * 9), -1)
        .when(F.col("word_chars").between(F.col("n_words") * 4, F.col("n_words") * 6.5), 1).otherwise(0))
    found["ended_lines"] = (
        F.when(F.col("n_lines") == 0, 0)
        .when(F.col("n_open_lines") <= F.col("n_lines") * 0.5, 1)
        .when(F.col("n_open_lines") >= F.col("n_lines") * 0.7, -1).otherwise(0))
    found["words"] = F.when(F.col("n_words") >= 100, 1).otherwise(0)
    return found


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern, the rules' vote rates by (class, vote, rule), the share of good texts.

    Classes are bad and good, votes -1, 0 and 1. Given the class, rules vote independently. A rule whose
    votes for bad are no rarer on good texts than on bad ones is given the same rates for both, so that
    it no longer counts; this also keeps the classes from changing places.
    """
    cast = np.stack([patterns == v for v in (-1, 0, 1)]).astype(float)
    posterior = np.where((patterns == -1).any(axis=1), START_BAD, START_GOOD)
    rates, share = np.full((2, *cast.shape[::2]), 1 / 3), 0.5
    for _ in range(ROUNDS):
        weights = np.stack([counts * (1 - posterior), counts * posterior])
        cells = np.einsum("cp,vpr->cvr", weights, cast) + PRIOR
        pooled = cells.sum(axis=0) / cells.sum(axis=(0, 1))
        rates = cells / cells.sum(axis=1, keepdims=True)
        useless = rates[1, 0] >= rates[0, 0]
        useless |= (rates[1, 2] <= rates[0, 2]) & (cast[0].sum(axis=0) == 0)
        rates[:, :, useless] = pooled[:, useless]
        share = (weights[1].sum() + PRIOR) / (counts.sum() + 2 * PRIOR)
        bad, good = np.einsum("vpr,cvr->cp", cast, np.log(rates)) + np.log([[1 - share], [share]])
        before, posterior = posterior, 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        if np.abs(posterior - before).max(initial=0) < 1e-9:
            break
    return posterior, rates, float(share)


def judge(docs: DataFrame, keep=("doc_id",), keep_from: float = KEEP_FROM) -> DataFrame:
    """``keep``, the ``COUNTS``, ``posterior``, ``base_failed`` and ``kept``, one row per row of ``docs``.

    Null and empty texts have all counts 0 and fail the base rule. Rows with the same id are judged
    each on its own text. Without documents there are no rows. Columns in ``keep`` must not be named
    like the new ones.
    """
    scratch = Scratch(docs.sparkSession)
    rules = votes()
    stored = scratch.keep(measured(docs, keep))
    voted = stored.withColumn("pattern", F.array(*rules.values()))
    table = voted.groupBy("pattern").count().orderBy("pattern").collect()
    patterns = np.array([r["pattern"] for r in table], int).reshape(len(table), len(rules))
    posterior, _, _ = estimate(patterns, np.array([r["count"] for r in table], float))
    known = docs.sparkSession.createDataFrame(
        [(r["pattern"], float(p)) for r, p in zip(table, posterior)], "pattern array<int>, posterior double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        voted.join(F.broadcast(known), "pattern").drop("pattern")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= keep_from))
    )
