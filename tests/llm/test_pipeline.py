"""Each stage on the fixture against what a few lines of Python make of its input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from kgweave.llm.tables import Scratch

from .test_linededup import slow_lines
from .test_simhash import slow_fingerprint, slow_groups


@pytest.fixture(scope="module")
def steps(spark, saved):
    docs = spark.read.parquet(f"{saved}/documents.parquet")
    found = [docs.collect()]
    for _, stage in pipeline.STAGES:
        docs = Scratch(spark).keep(stage(spark, docs, saved))
        found.append(docs.collect())
    return found


def test_language_drops_texts_without_letters_only(steps):
    want = Counter(map(tuple, (r for r in steps[0] if any(c.isalpha() for c in r.text or ""))))
    got = Counter(map(tuple, steps[1]))
    strange = {"x", "X", "ab " * 300, "same line\n" * 9}  # no trigram in common with any other text
    assert not got - want and {r[1] for r in want - got} <= strange


def test_lines(steps):
    rows = [tuple(r) for r in steps[1]]
    want = []
    for i, (text, _, _) in slow_lines(rows, 3).items():
        lost = 1 - len(text.replace("\n", "")) / len(rows[i][1].replace("\n", ""))
        if lost <= 0.5:
            want.append((rows[i][0], text, *rows[i][2:4], len(text)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in steps[2])


def test_near_duplicates(steps):
    label = slow_groups([slow_fingerprint(r.text) for r in steps[2]])
    assert len(steps[3]) == len(set(label)) and not Counter(map(tuple, steps[3])) - Counter(map(tuple, steps[2]))


def test_contaminated_documents_go(steps):
    gone = Counter(map(tuple, steps[3])) - Counter(map(tuple, steps[4]))
    assert any(len(r[1].split()) > 5000 for r in gone)
    assert all(len(r.text.split()) < 5000 and r.text.strip().lower() != "x" for r in steps[4])


def test_mix_and_run(spark, saved, steps):
    taken = Counter()
    for r in steps[5]:
        taken[r.doc_id] += r.taken
    size = {r.doc_id: len(r.text.split()) for r in steps[4]}
    assert all(n <= 2 * size[i] for i, n in taken.items())
    assert sorted(map(str, pipeline.run(spark, saved).collect())) == sorted(map(str, steps[5]))
    assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(pipeline.run(spark, saved).columns)


def test_empty(spark, saved, nothing):
    docs = nothing.withColumn("extra", F.lit(1))
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, saved)
        assert docs.collect() == [], name
