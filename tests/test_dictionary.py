"""Ids by hash, shared hashes, frequent ids; multi-maps in chunks."""

from collections import Counter

from pyspark.sql import functions as F

from kgweave.operators import dictionary, graph as G
from tests.conftest import rows

DATA = [(f"s{i % 9}", "p" if i % 5 else "q", f"o{i % 13}") for i in range(60)] + [("_:n", "q", '"1"')]


def test_terms_that_share_a_hash_get_ids_of_their_own(graph):
    for hashed in (F.xxhash64, lambda *c: F.pmod(F.xxhash64(*c), F.lit(80))):
        encoded, terms = dictionary.encode_terms(graph(DATA), hashed)
        names = {r.id: r.term for r in terms.collect()}
        assert sorted(names.values()) == sorted({x for row in DATA for x in row})
        assert Counter(tuple(names[x] for x in r) for r in encoded.collect()) == Counter(DATA)
        again, _ = dictionary.encode_terms(graph(DATA), hashed)
        assert rows(again) == rows(encoded)


def test_counts_nulls_and_no_rows(spark, graph):
    with_null = graph(DATA).union(spark.createDataFrame([("s1", None, "o1")], "s string, p string, o string"))
    encoded, terms = dictionary.encode_terms(with_null)
    assert encoded.count() == len(DATA)
    want = Counter(r[0] for r in DATA)
    assert {r.term: r.n_s for r in terms.collect() if r.n_s} == dict(want)
    encoded, terms = dictionary.encode_terms(graph(DATA).where("false"))
    assert terms.collect() == [] and dictionary.decode_terms(encoded, terms).collect() == []


def test_decoding_with_and_without_frequent_ids(spark, graph, monkeypatch):
    encoded, terms = dictionary.encode_terms(graph(DATA))
    unknown = encoded.union(spark.createDataFrame([(1, 2, 3)], encoded.schema))
    assert Counter(map(tuple, dictionary.decode_terms(unknown, terms).collect())) == Counter(DATA)
    monkeypatch.setattr(dictionary, "BROADCAST_ROWS", 0)
    for share in (1, 10, 1000):
        monkeypatch.setattr(dictionary, "HEAVY_SHARE", share)
        assert Counter(map(tuple, dictionary.decode_terms(unknown, terms).collect())) == Counter(DATA)


def test_chunks_hold_every_value_once(spark):
    pairs = [("hub", f"v{i}") for i in range(500)] + [("hub", "v1"), ("few", "a"), ("few", "b"), ("few", None)]
    got = G.multi_map_chunks(spark.createDataFrame(pairs, "s string, o string"), 20).collect()
    assert all(1 <= len(r["values"]) <= 20 for r in got)
    assert len({(r.key, r.chunk) for r in got}) == len(got)
    assert Counter((r.key, v) for r in got for v in r["values"]) == Counter({p for p in pairs if p[1] is not None})
    assert [r.chunk for r in got if r.key == "few"] == [0]


def test_f7_predicates_in_use_are_broadcast(graph, monkeypatch):
    """One shuffle of the triples for the subjects and one for the objects, without their ids, and none for the predicates."""
    data = [(f"s{i}", f"p{i % 7}", f"o{i % 5}") for i in range(40)]
    encoded, terms = dictionary.encode_terms(graph(data))
    swapped = encoded.select(F.col("p").alias("s"), F.col("s").alias("p"), "o")  # predicates that the dictionary has as subjects
    monkeypatch.setattr(dictionary, "HEAVY_SHARE", 2)
    for limit, joins in ((45, 2), (3, 3)):
        monkeypatch.setattr(dictionary, "BROADCAST_ROWS", limit)
        decoded = dictionary.decode_terms(encoded, terms)
        plan = decoded._jdf.queryExecution().optimizedPlan().toString()
        assert len([line for line in plan.split("\n") if "Join LeftOuter" in line and "_key" in line]) == joins
        assert sorted(map(tuple, decoded.collect())) == sorted(data)
        assert sorted(map(tuple, dictionary.decode_terms(swapped, terms).collect())) == sorted((p, s, o) for s, p, o in data)
