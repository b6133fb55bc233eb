import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from kgweave.llm import merkle

H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row[0], row[3], row[2], None if row[4] is None else row[4] + more, row[1]]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([H(*found[-1][i:i + 2]) for i in range(0, len(found[-1]), 2)])
    return found


def brute(rows):
    """The contract's rows for ``(doc_id, text, lang, source, n_chars)``, from whole trees."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    trees = {}
    for lang, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = levels([leaf(r) for r in own])
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    top = levels([trees[x][-1][0] for x in order])
    found = []
    for at, lang in enumerate(order):
        for pos, row in enumerate(groups[lang]):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node, proof = leaf(row, 1 if changed else 0), []
            for nodes, place in ((trees[lang], pos), (top, at)):
                for level in nodes[:-1]:
                    first = place - place % 2
                    others = [level[i] for i in (first, first + 1) if i != place and i < len(level)]
                    proof += others
                    node = H(*([*others, node] if place % 2 else [node, *others]))
                    place //= 2
            root = top[-1][0]
            found.append((row[0], leaf(row), trees[lang][-1][0], root, H(*proof), node, node == root))
    return sorted(found, key=str)


def proved(docs):
    _, got = merkle.manifest_of(docs)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)


@pytest.mark.parametrize("top_nodes", [0, 10, 100_000])
def test_against_whole_trees(spark, docs, rows, small, monkeypatch, top_nodes):
    monkeypatch.setattr(merkle, "TOP_NODES", top_nodes)
    assert proved(docs.withColumn("tree", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("digest", F.lit(2))) == brute(rows)


def test_hot_group_many_groups_and_ties(spark, small):
    rng = random.Random(1)
    made = [(rng.randrange(80), rng.choice(["a", "é", None, ""]), rng.choice(["en"] * 6 + ["de", None, "", "zz", "É"]), "s",
             rng.choice([1, None])) for _ in range(300)] + [(i, "t", f"l{i}", None, 3) for i in range(41)]
    rows = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    assert proved(rows.repartition(7)) == brute(made)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 33])
def test_sizes(spark, small, n):
    made = [(i, "t" * i, "en", "s", i) for i in range(n)]
    assert proved(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")) == brute(made)


def test_nothing(nothing):
    assert proved(nothing) == []


def test_multiproof_is_minimal_and_sufficient(spark):
    rng, trees, asked = random.Random(7), {}, []
    for size in (1, 2, 3, 7, 8, 13, 64, 100):
        trees[size] = levels([H(str(i)) for i in range(size)])
        asked += [(size, rng.sample(range(size), rng.randint(1, min(size, 9)))) for _ in range(6)]
    rows = spark.createDataFrame(asked, "size long, wanted array<long>").coalesce(1)
    found = rows.select("size", "wanted", F.expr(merkle.missing("wanted", "size")).alias("missing")).collect()
    given = []
    for size, wanted, coordinates in found:
        nodes, coordinates = trees[size], [tuple(c) for c in coordinates]
        assert len(set(coordinates)) == len(coordinates)
        known, needed = {(0, p) for p in wanted}, set()
        for level in range(len(nodes) - 1):  # nothing that the wanted leaves yield is fetched, and all else that is needed
            here = {p for at, p in known if at == level}
            needed |= {(level, p ^ 1) for p in here if p ^ 1 < len(nodes[level]) and p ^ 1 not in here}
            known |= {(level + 1, p // 2) for p in here}
        assert set(coordinates) == needed
        given.append((size, [(p, nodes[0][p], nodes[0][p]) for p in wanted],
                      [(level, p, nodes[level][p]) for level, p in coordinates]))
    proofs = spark.createDataFrame(
        given, "size long, leaves array<struct<pos: long, digest: string, presented: string>>, "
        "fetched array<struct<level: int, at: long, node: string>>").coalesce(1).select(
        "size", F.expr(f"inline({merkle.expanded('leaves', 'fetched', 'size')})")).select(
        "size", F.expr(merkle.climbed("digest", "pos", "proof")).alias("root"))
    assert all(r.root == trees[r.size][-1][0] for r in proofs.collect())


def test_proofs_for_some_rows_only(spark, docs, rows, small):
    manifest, _ = merkle.manifest_of(docs)
    asked = manifest.leaves.where("doc_id IN (2, 3, 11)").withColumn("presented", F.col("digest"))
    some = merkle.prove(manifest, asked.select("tree", "size", "pos", "digest", "presented")).collect()
    full = {(r[1], r[4]) for r in brute(rows)}
    assert len(some) == asked.count() and {r.folded_root for r in some} == {manifest.root}
    assert {(r.digest, r.proof_sha256) for r in some} <= full
