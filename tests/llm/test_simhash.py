import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kgweave.llm import simhash
from kgweave.llm.queries import QUERIES
from kgweave.llm.tables import Scratch
from kgweave.operators.components import connected_components


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(values, bits=3):
    """The least index reachable from each index."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= bits and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


def test_query_against_brute_force(spark, saved, rows):
    values = [slow_fingerprint(r[1]) for r in rows]
    label = slow_groups(values)
    ids = [r[0] for r in rows]
    least = {}
    for i, g in zip(ids, label):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    want = sorted((str(i), f"{v:016x}", str(least[g])) for i, v, g in zip(ids, values, label))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in QUERIES["op5_simhash"](spark, saved).collect())
    assert got == want


def crowd(rng, n):
    """Fingerprints in a few chains, so that nodes, parts and budgets all matter."""
    found = {rng.getrandbits(64) for _ in range(n // 4)}
    while len(found) < n:
        value = rng.choice(sorted(found)[:n // 4])
        for _ in range(rng.randint(1, 5)):
            value ^= 1 << rng.randrange(64)
        found.add(value)
    return sorted(found)


def test_trie_pairs_are_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 4)
    values = crowd(random.Random(4), 300)
    values = np.array(sorted(v >> 8 for v in values), np.uint64)  # the first eight bits agree
    values = np.unique(values)
    got = {tuple(sorted((int(i), int(j)))) for a, b in simhash.trie_pairs(values, 8, 3) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values))
            if (int(values[i]) ^ int(values[j])).bit_count() <= 3}
    assert got == want and want


@pytest.mark.parametrize("part", [simhash.PART, 7])
def test_links_join_the_same_groups(spark, part):
    values = crowd(random.Random(6), 240)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "fp long")
    linked = simhash.links(distinct, part=part).distinct()
    got = {}
    for r in connected_components(Scratch(spark).keep(linked)).collect():
        got.setdefault(r.canonical, set()).add(r.node)
    want = {}
    for v, g in zip(signed, slow_groups(values)):
        want.setdefault(g, set()).add(v)
    groups = lambda d: {frozenset(m) for m in d.values() if len(m) > 1}
    whole = {frozenset(m | {c}) for c, m in got.items()}
    assert {m for m in whole if len(m) > 1} == groups(want)


def test_keep_first_keeps_one_of_each_group(docs, rows, nothing):
    label = slow_groups([slow_fingerprint(r[1]) for r in rows])
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, i)
    want = sorted(str(tuple(rows[min((i for i in range(len(rows)) if label[i] == g), key=order)])) for g in set(label))
    kept = simhash.keep_first(docs.withColumn("fp", F.lit("mine")).withColumn("row", F.lit(1)))
    assert kept.columns == [*docs.columns, "fp", "row"]
    assert sorted(str(tuple(r)[:5]) for r in kept.collect()) == want
    assert simhash.keep_first(nothing).collect() == []
