import random
from collections import Counter

import numpy as np
import pytest

from kgweave.llm import tokens
from kgweave.llm.queries import QUERIES
from kgweave.llm.tables import Scratch


def test_counts_are_those_of_the_texts(spark, saved, rows):
    encode = tokens.encoder(open(tokens.VOCABULARY, "rb").read()).encode_ordinary
    want = Counter((r[0], len(encode(r[1] or "")), True) for r in rows)
    assert Counter(map(tuple, QUERIES["op10_tokens"](spark, saved).collect())) == want


def test_decoded_files_are_the_texts(spark, docs, rows):
    encoder = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    blocks = Scratch(spark).keep(tokens.token_files(docs, block=37)).orderBy("file", "block").collect()
    flat = np.concatenate([np.frombuffer(b.tokens, "<u2") for b in blocks])
    parts = np.split(flat, np.flatnonzero(flat == tokens.END) + 1)
    assert [encoder.decode(p[:-1].tolist()) for p in parts[:-1]] == [r[1] or "" for r in rows] and not len(parts[-1])


@pytest.mark.parametrize("group", [1, 3, 1000])
def test_boundaries_across_blocks(spark, group):
    rng = random.Random(group)
    rows, want = [], []
    for file in range(4):
        flat = [rng.choice([7, 9, 9, 9, 8]) for _ in range(rng.randint(0, 300))]
        at, number = 0, rng.randint(-3, 5)
        while at < len(flat):
            size = rng.choice([0, 1, 2, 5, 40])
            rows.append((file, number, np.array(flat[at:at + size], "<u2").tobytes()))
            at, number = at + size, number + rng.randint(1, 3)
        docs = [[]]
        for t in flat:
            docs.append([]) if t == 8 else docs[-1].append(t)
        want += [(file, i, len(d), True) for i, d in enumerate(docs[:-1])]
        want += [(file, len(docs) - 1, len(docs[-1]), False)] if docs[-1] else []
    rng.shuffle(rows)
    files = spark.createDataFrame(rows + [(9, 0, b""), (10, 0, None)], "file int, block long, tokens binary")
    assert sorted(map(tuple, tokens.scan(files, end=8, group=group).collect())) == want


def test_wide_tokens(spark):
    end = 100_000
    files = spark.createDataFrame([(0, 0, np.array([1, end, 70_000, end], "<u4").tobytes())], "file int, block long, tokens binary")
    assert [r.n_tokens for r in tokens.scan(files, end=end).orderBy("ordinal").collect()] == [1, 1]


def test_large_ids_beside_null_ones_and_nothing(spark, nothing):
    ids = [(1 << 53) + 1, None, (1 << 53) + 3, (1 << 53) + 1]
    docs = spark.createDataFrame([(i, "a") for i in ids], "doc_id long, text string").coalesce(1)
    got = tokens.scan(Scratch(spark).keep(tokens.token_files(docs)), keep=("ids",)).collect()
    assert sorted((r.ids for r in got), key=str) == sorted(ids, key=str)
    assert tokens.scan(Scratch(spark).keep(tokens.token_files(nothing)), keep=("ids",)).collect() == []
