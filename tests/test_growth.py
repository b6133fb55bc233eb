"""What a larger input costs: which rows are shuffled, derived or written again."""

import glob

from pyspark.sql import functions as F

from kgweave.functions import terms as t
from kgweave.job import materialize_job
from kgweave.operators import owlrl, rdfs
from kgweave.plans.triples import TripleTable
from kgweave.plans.workspace import FactTable
from kgweave.sources import ntriples as nt

from tests.conftest import rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_facts_stay_in_their_buckets(spark):
    """However many partitions a shuffle has: a table with fewer buckets would be shuffled in every round."""
    changed = {"spark.sql.shuffle.partitions": str(8 * spark.sparkContext.defaultParallelism + 3),
               "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in changed}
    try:
        for name, value in changed.items():
            spark.conf.set(name, value)
        table = FactTable(spark, ["s", "o"], large=True)
        table.append(spark.range(50).select(F.col("id").cast("string").alias("s"), F.hex("id").alias("o")))
        new = spark.range(60).select(F.col("id").cast("string").alias("s"), F.hex("id").alias("o")).distinct()
        joined = new.join(table.known, ["s", "o"], "left_anti")
        assert plan_of(joined).count("Exchange hashpartitioning") == 1
        assert joined.count() == 10
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_later_rounds_derive_from_new_effects_only(spark, graph, monkeypatch):
    calls = []

    def noted(facts, effects):
        calls.append((facts.count(), effects.by_property.df.union(effects.by_class.df.select(
            "c", F.lit(""), "target", F.lit(True))).count()))
        return apply_effects(facts, effects)

    apply_effects = rdfs.apply_effects
    monkeypatch.setattr(rdfs, "apply_effects", noted)
    facts = [("C", t.SUB_CLASS, "D"), ("C", t.TYPE, t.RDFS_CLASS), ("p", t.DOMAIN, "C"), *[(f"x{i}", "p", f"y{i}") for i in range(200)]]
    got = rows(rdfs.materialize_rdfs(graph(facts), rdfs.Level.FULL))
    assert {("x7", t.TYPE, "D"), ("y7", t.TYPE, t.RESOURCE), ("p", t.TYPE, t.PROPERTY), (t.PROPERTY, t.TYPE, t.RESOURCE)} <= got
    compiled = max(effects for _, effects in calls)
    assert [n for n, effects in calls[1:] if n > 200 and effects < compiled], "the whole graph meets the added effects"
    assert len([n for n, effects in calls if n > 200 and effects == compiled]) <= 2


def test_pairs_of_a_list_are_not_shuffled(spark, graph):
    cells = [f"L{i}" for i in range(40)] + [t.NIL]
    facts = [("w", t.DISTINCT_MEMBERS, "L0"), ("m0", t.DIFFERENT_FROM, "m1"), ("m0", t.DIFFERENT_FROM, "z"),
             *[x for i in range(40) for x in ((cells[i], t.FIRST, f"m{i}"), (cells[i], t.REST, cells[i + 1]))]]
    asked = spark.createDataFrame([("m0",), ("m1",), ("z",), (None,)], "node string")
    got = owlrl.different_from(graph(facts), asked)
    before_join = plan_of(got).split("BroadcastHashJoin")[0]
    assert "Exchange" not in before_join
    pairs = [(s, o) for s, _, o in got.collect()]
    want = {(a, f"m{i}") for a in ("m0", "m1") for i in range(40) if a != f"m{i}"} | {("m0", "z"), ("z", "m0")}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_many_asked_nodes_agree(spark, graph, monkeypatch):
    cells = [f"L{i}" for i in range(12)] + [t.NIL]
    facts = graph([("w", t.DISTINCT_MEMBERS, "L0"), ("m0", t.DIFFERENT_FROM, "z"),
                   *[x for i in range(12) for x in ((cells[i], t.FIRST, f"m{i}"), (cells[i], t.REST, cells[i + 1]))]])
    asked = spark.createDataFrame([(f"m{i}",) for i in range(6)], "node string")
    want = rows(owlrl.different_from(facts, asked))
    monkeypatch.setattr(owlrl, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(owlrl, "PAIRED_ROWS", 4)
    assert rows(owlrl.different_from(facts, asked)) == want and len(want) == 6 * 11 + 1


def test_job_writes_compressed(spark, graph, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    nt.write_ntriples(graph([("http://a", t.TYPE, "http://C"), ("http://C", t.SUB_CLASS, "http://D")]), source, compression="gzip")
    materialize_job(spark, source, out, "rdfs-simple", compression="gzip")
    assert glob.glob(f"{source}/*.gz") and glob.glob(f"{out}/*.gz")
    assert ("http://a", t.TYPE, "http://D") in rows(nt.load_ntriples(spark, out))


def test_a_round_of_triples_is_few_files(spark):
    """However many partitions a shuffle has: each rule opens the files of the groups that it asks for."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        table = TripleTable(spark)
        some = spark.range(2000).select(F.concat(F.lit("x"), "id").alias("s"), F.lit("p").alias("p"), F.hex("id").alias("o"))
        assert table.append(some) == 2000
        assert len(table.known.inputFiles()) <= 16
        more = spark.range(2500).select(F.concat(F.lit("x"), "id").alias("s"), F.lit("p").alias("p"), F.hex("id").alias("o"))
        assert table.append(more) == 500 and table.append(more) == 0
        assert table.known.count() == table.known.distinct().count() == 2500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
