import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgweave.llm import negatives

SCHEMA = "vec_id long, label int, vector array<long>"
LAST = 1 << 62


def brute(rows):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    found = []
    for i, (anchor, label, v) in enumerate(rows):
        if anchor is None or anchor % 5:
            continue
        scores = [(dot(v, w), LAST if other is None else other, j) for j, (other, _, w) in enumerate(rows) if j != i]
        scores.sort(key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in scores if rows[s[2]][1] == label][:negatives.POSITIVES]:
            fit = [s for s in scores if rows[s[2]][1] != label and 30 * p <= 100 * s[0] <= 90 * p][:negatives.NEGATIVES]
            found += [(anchor, None if pid == LAST else pid, rank, None if nid == LAST else nid, p, n)
                      for rank, (n, nid, _) in enumerate(fit, 1)]
    return sorted(found, key=str)


def mined(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("question", F.lit(1))
    return sorted((tuple(r) for r in negatives.mine(df, F.col("vec_id") % 5 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def vectors(n, dims, spread, seed=1):
    """Vectors around a few centres, so that thresholds are high and ranges narrow."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    made = centres[rng.integers(0, 6, n)] + rng.normal(scale=spread, size=(n, dims))
    made *= rng.choice([40, 60, 200], n)[:, None] / np.linalg.norm(made, axis=1)[:, None]
    return [(i, int(rng.integers(0, 3)), [int(x) for x in v]) for i, v in enumerate(made)]


@pytest.mark.parametrize("dims, spread", [(3, 0.1), (8, 0.3), (24, 2.0)])
def test_against_brute_force(spark, monkeypatch, dims, spread):
    monkeypatch.setattr(negatives, "BUCKET", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 20)
    rows = vectors(220, dims, spread)
    rng = random.Random(2)
    rows += [rows[3], rows[5], rows[5], (None, 1, rows[7][2]), (None, 2, rows[8][2]), (500, None, rows[1][2]), (505, 1, None),
             (510, 1, [None] * dims), (515, 1, [0] * dims), (520, 2, []), (525, 1, rows[4][2][:2]), (530, 9, rows[9][2])]
    rows += [(600 + i, rng.randint(0, 2), rows[10][2]) for i in range(40)]
    want = brute(rows)
    assert len(want) > 300 and mined(spark, rows) == want


def test_large_numbers_and_refusal(spark):
    rows = [(i, l, [x << 23 for x in v]) for i, l, v in vectors(60, 4, 0.3)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [1 << 40]), (1, 1, [1 << 40])])


def test_nothing_to_do(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1, 2])]) == []
    assert mined(spark, [(0, 1, [1, 2]), (1, 2, [1, 2])]) == []
    assert mined(spark, [(0, 1, [1, 0]), (1, 1, [-1, 0]), (2, 2, [-1, 0])]) == []


def test_ranges_prune_without_losing_a_row():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(600, 5))
    units = rows / np.linalg.norm(rows, axis=1)[:, None]
    lists = np.argsort(units.T, axis=1, kind="stable").astype(np.uint16)
    asking = units[:50]
    least = np.full(50, 0.8)
    picks = negatives.candidates(units, lists, asking, least)
    cosine = asking @ units.T
    assert sum(p is not None for p in picks) > 25
    for i, rows_ in enumerate(picks):
        assert rows_ is None or set(np.flatnonzero(cosine[i] >= 0.8)) <= set(rows_.tolist())
    assert np.mean([len(p) for p in picks if p is not None]) < 200


def test_scaled(spark):
    rows = [([0.5, -0.001],), ([1.0, None],), ([float("nan")],), ([float("inf")],), (None,), ([],), ([1e300],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(negatives.scaled(F.col("v"), 256)).collect()]
    assert got == [[128, -1], None, None, None, None, [], None]
