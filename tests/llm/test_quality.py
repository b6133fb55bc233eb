import random
import re
from collections import Counter

import numpy as np
import pytest

from kgweave.llm import quality
from kgweave.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(inside))


def test_base_counts_against_brute_force(spark, saved, rows):
    got = QUERIES["op6_quality"](spark, saved).collect()
    want = Counter((r[0], *slow_base(r[1])) for r in rows)
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert 0 <= r.posterior <= 1 and (not r.base_failed or not r.kept)


def test_estimate_recovers_what_rules_are_worth():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    rate_bad, rate_good = np.array([0.8, 0.6, 0.5, 0.1]), np.array([0.02, 0.05, 0.01, 0.1])
    bad_votes = rng.random((20_000, 4)) < np.where(good[:, None], rate_good, rate_bad)
    patterns, counts = np.unique(np.where(bad_votes, -1, 0), axis=0, return_counts=True)
    posterior, rates, share = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.05
    assert np.abs(rates[0, 0, :3] - rate_bad[:3]).max() < 0.1 and np.abs(rates[1, 0, :3] - rate_good[:3]).max() < 0.05
    at = {tuple(p): q for p, q in zip(patterns, posterior)}
    assert at[0, 0, 0, 0] > 0.9 > 0.1 > at[-1, -1, -1, 0]
    assert at[0, 0, 0, -1] == pytest.approx(at[0, 0, 0, 0], abs=0.1)  # a useless rule hardly counts


def test_clean_stays_and_junk_goes(spark):
    rng = random.Random(9)
    words = [a + b for a in ("mon", "ter", "lav", "sor", "pil") for b in ("ana", "iro", "ent", "us", "olk")]
    clean = [". ".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(15)) + "." for _ in range(60)]
    junk = [" ".join(rng.choice(["#$%", "|||", "AAAA", "X9", "<<>>", "88"]) + str(rng.random()) for _ in range(120))
            for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(clean + junk)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 75))
