import math
import random
import tracemalloc
import types
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kgweave.llm import queries, toxicity
from kgweave.llm.tables import Scratch, documents

LABELS = "doc_id long, toxic int"


def brute(counts: dict, order: int, discount: float) -> dict:
    """Log-ratio of every gram of both classes, and of an unseen letter per context, straight from the definition."""
    def lower(h, w):  # the shared model after context h
        level = {g[-len(h) - 1:] for g in counts}
        for length in range(order - 1, len(h), -1):
            level = {g[1:] for g in {g[-length - 1:] for g in counts}}
        kinds = Counter(g[1:] for g in {g[-len(h) - 2:] for g in counts})
        total = sum(n for g, n in kinds.items() if g[:-1] == h)
        different = sum(1 for g in kinds if g[:-1] == h)
        below = lower(h[1:], w) if h else 1 / (len({g[-1] for g in counts}) + 1)
        return (max(kinds[h + w] - discount, 0) + discount * different * below) / total

    found = {}
    for gram in counts:
        h, p = gram[:-1], []
        for k in (0, 1):
            own = {g: n[k] for g, n in counts.items() if g[:-1] == h and n[k]}
            total, shared = sum(own.values()), lower(h[1:], gram[-1])
            p.append((max(own.get(gram, 0) - discount, 0) + discount * len(own) * shared) / total if total else shared)
            found.setdefault((h, None), []).append(discount * len(own) / total if total else 1.0)
        found[h, gram[-1]] = math.log(p[1]) - math.log(p[0])
    return {k: v if isinstance(v, float) else math.log(v[1]) - math.log(v[0]) for k, v in found.items()}


def test_model_against_its_definition(spark):
    texts = [("bad worse bad!", 1, 0), ("good goods bad", 0, 0), ("Good été", 0, 1), ("worst", 1, 1)]
    rows = spark.createDataFrame(texts, "text string, toxic int, fold int")
    got = {(r.context, r.letter): r.delta for r in toxicity.differences(
        toxicity.ngrams(toxicity.vocabulary(rows)), Scratch(spark)).collect()}
    counts = {}
    for text, toxic, _ in texts:
        for some in toxicity.words(text):
            for word in some:
                padded = toxicity.START * 3 + word + toxicity.END
                for at in range(len(word) + 1):
                    counts.setdefault(padded[at:at + 4], [0, 0])[toxic] += 1
    want = brute(counts, 4, toxicity.DISCOUNT)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def made(n=900):
    rng = random.Random(3)
    plain = [a + b for a in ("ka", "lo", "mi", "ru", "té") for b in ("na", "rit", "pos", "del")]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(rng.randint(8, 60))]
        if toxic:  # an unseen form of a known stem
            words[rng.randrange(len(words))] = "zworg" + "".join(rng.choice("aeiounrst") for _ in range(4))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_also_for_unseen_forms(spark):
    rows, labels = made()
    judged = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)).collect()
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in judged)
    unseen = [r for r in judged if r.held_out]
    assert len(unseen) > 100 and sum(r.predicted == truth[r.doc_id] for r in unseen) > 0.97 * len(unseen)


def test_held_out_labels_are_not_learned(spark):
    rows, labels = made(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    first, second = (sorted(tuple(r) for r in toxicity.score(docs, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned))
    assert first == second


def test_slices_pieces_and_forgetting_give_the_same_scores(spark, monkeypatch):
    rows, labels = made(120)
    docs = spark.createDataFrame(rows + [(1000, "ka" * 50 + " " + "lorit été-" * 3000)], "doc_id long, text string")
    score = lambda: {r.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame(labels, LABELS)).collect()}
    whole = score()
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    assert score() == pytest.approx(whole, abs=1e-9)
    monkeypatch.setattr(toxicity, "SLICE_ROWS", 60)
    assert score() == pytest.approx(whole, abs=1e-9)
    monkeypatch.setattr(toxicity, "CACHED_WORDS", 5)
    assert score() == pytest.approx(whole, abs=1e-9)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    text = "ka" * 50 + " " + "lorit été-" * 30
    assert [w for some in toxicity.words(text) for w in some] == toxicity._WORD.findall(text)


def test_many_new_words_take_little_memory():
    known = toxicity._packed([("abcd", 1.0), ("bcde", -0.5)], 4), toxicity._packed([("abc", 0.25)], 3)
    new = [f"abcd{i}" for i in range(60_000)]
    judge = toxicity._Judge([types.SimpleNamespace(value=known)], 4)
    tracemalloc.start()
    try:
        judge._learn(new)
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()
    alone = toxicity._Judge([types.SimpleNamespace(value=known)], 4)
    for word in (new[0], new[10_000], new[-1]):
        alone._learn([word])
    assert len(judge.known) == len(new) and alone.known == {w: judge.known[w] for w in alone.known}


def test_nulls_ties_repeats_clashing_names_and_empty_tables(spark):
    rows, labels = made(80)
    rows += [(rows[0][0], rows[1][1]), (None, rows[2][1]), (500, None), (501, ""), (502, "1 2 !"), (None, None)]
    labels += [(0, 1 - labels[0][1]), (None, 1), (501, None), (9999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn(
        "toxic", F.lit("y")).withColumn("_worst", F.lit(7)).withColumn("fold", F.lit(1))
    judged = toxicity.score(docs, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("other")))
    got = judged.collect()
    assert len(got) == len(rows) and {r._worst for r in got} == {7} and {r.toxic for r in got} == {"y"}
    assert all(r.score is not None for r in got)
    empty = [r for r in got if r.doc_id in (500, 501, 502) or r.text is None]
    assert len(empty) == 4 and len({r.score for r in empty}) == 1 and 0 < empty[0].score < 1
    no_labels = spark.createDataFrame([], LABELS)
    assert {(r.score, r.predicted) for r in toxicity.score(docs, no_labels).collect()} == {(0.0, 0)}
    one_class = spark.createDataFrame([(i, 1) for i in range(80)], LABELS)
    assert {r.score for r in toxicity.score(docs, one_class).collect()} == {1.0}
    assert toxicity.score(docs.limit(0), no_labels).collect() == []
    letterless = spark.createDataFrame([(i, "1") for i in range(40)], "doc_id long, text string")
    assert len(toxicity.score(letterless, spark.createDataFrame(labels, LABELS)).collect()) == 40


def test_given_tables(spark):
    """Held-out rows; toxic texts in languages other than English bear no sign of it in this table."""
    sf = "/root/testdata/sf0.1"
    got = queries.op11_toxicity(spark, sf).where("held_out").join(documents(spark, sf, "labels"), "doc_id").join(
        documents(spark, sf).where("lang = 'en'").select("doc_id"), "doc_id")
    n, hit, toxic, told = got.agg(F.count("*"), *[F.count_if(F.expr(e)) for e in (
        "predicted = 1 AND toxic = 1", "toxic = 1", "predicted = 1")]).first()
    assert n > 300 and hit >= 0.85 * toxic and hit >= 0.95 * told
