import random

import pytest

from kgweave.llm import phrases


def slow_cut(rows, window):
    """What stays of each text, by its place in ``rows``."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, kept = set(), {}
    for i in order:
        words = (rows[i][1] or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            gone.update(range(s, s + window)) if key in seen else seen.add(key)
        kept[i] = [w.decode() for k, w in enumerate(words) if k not in gone]
    return kept


@pytest.mark.parametrize("shard", [phrases.SHARD_BYTES, 200, 4000])
def test_against_brute_force(spark, docs, rows, shard, monkeypatch):
    """One shard and many: passages meet within a shard and across shards."""
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases, "PATTERNS", 5)
    want = slow_cut(rows, 20)
    got = phrases.remove_repeats(docs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(
        key((r[0], len((r[1] or "").split()), len((r[1] or "").split()) - len(want[i]), " ".join(want[i])))
        for i, r in enumerate(rows))


def test_few_words_many_repeats(spark, monkeypatch):
    """Texts over two words: anchors tie, runs overlap themselves."""
    monkeypatch.setattr(phrases, "SHARD_BYTES", 500)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    want = slow_cut(rows, 6)
    got = phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=6, phrase=3).collect()
    assert {r.doc_id: r.kept for r in got} == {i: " ".join(w) for i, w in want.items()}


def test_empty(nothing):
    assert phrases.remove_repeats(nothing).collect() == []


def test_large_ids_beside_null_ones(spark):
    ids = [(1 << 53) + 1, None, (1 << 53) + 3, (1 << 62) + 1]
    got = phrases.remove_repeats(spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string").coalesce(1))
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted(ids, key=str)
