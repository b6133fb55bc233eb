"""What stays on disk: shuffle files and tables that nothing reads again."""

import glob
import os

from pyspark.sql import functions as F

from kgweave.functions import terms as t
from kgweave.operators import axioms as ax, horst, rdfs
from kgweave.plans import triples as plan_of_triples
from kgweave.plans.triples import TripleTable
from kgweave.plans.workspace import CLEANUP, store
from kgweave.sources import axioms as axs
from kgweave.sources.inline import inline
from tests.conftest import rows


def _shuffle_bytes(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(f) for d in folders for f in glob.glob(f"{d.getPath()}/*/shuffle_*") if os.path.exists(f))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f4_f8_a_written_table_leaves_no_shuffle_files(spark):
    before, kept = spark.conf.get(CLEANUP, None), _shuffle_bytes(spark)
    stored = store(spark.range(200_000).select(F.hex("id").alias("x")).repartition(4, "x").distinct())
    assert stored.rows == 200_000 and _shuffle_bytes(spark) - kept < 100_000
    assert spark.conf.get(CLEANUP, None) == before


def test_f10_a_round_s_candidates_are_dropped_after_it(spark, graph):
    table = TripleTable(spark)
    table.begin(graph([("a", "p", "b"), ("a", "p", "b")]), [graph([("a", "p", "b"), ("a", "q", "b")])])
    assert rows(table.derived) == {("a", "q", "b")} and table.rows == 2
    passing = table.passing(store(graph([("a", "q", "b"), ("c", "q", "d")])))
    assert table.append(passing.df) == 1 and rows(table.derived) == {("a", "q", "b"), ("c", "q", "d")}
    assert not spark.catalog.tableExists(passing.name)


def test_f8_f10_a_large_round_is_several_shuffles(spark, graph, monkeypatch):
    monkeypatch.setattr(plan_of_triples, "SLICE_ROWS", 10)
    monkeypatch.setattr(plan_of_triples, "BROADCAST_ROWS", 0)
    written, inner = [], TripleTable._write_round
    monkeypatch.setattr(TripleTable, "_write_round", lambda self, rows, number: written.append(number) or inner(self, rows, number))
    data = [(f"x{i}", "p" if i % 3 else "q", f"y{i}") for i in range(25)]
    table = TripleTable(spark)
    assert table.begin(graph(data + data), [graph(data[:9] + [("a", "p", "b")])]) == 26
    assert table.append(graph(data + [("c", "p", "d"), ("c", "q", "d")])) == 2 and written == [0] * 4 + [1] * 3
    assert sorted(map(tuple, table.known.collect())) == sorted([*data, ("a", "p", "b"), ("c", "p", "d"), ("c", "q", "d")])
    assert rows(table.derived) == {("a", "p", "b"), ("c", "p", "d"), ("c", "q", "d")}


def test_f1_f5_what_a_graph_lacks(graph):
    data = [("A", t.SUB_CLASS, "B"), ("B", t.SUB_CLASS, "C"), ("x", t.TYPE, "A"), ("x", t.TYPE, "B"), ("x", t.TYPE, "A"), ("x", "p", "y"),
            ("x", "p", "y"), ("x", "q", "y"), ("p", t.SUB_PROPERTY, "q"), ("q", t.DOMAIN, "A"), ("p", t.INVERSE_OF, "r"), ("y", "r", "x")]
    given = graph(data)
    for whole, new in ((rdfs.materialize_rdfs(given, rdfs.Level.SIMPLE), rdfs.materialize_rdfs(given, rdfs.Level.SIMPLE, only_new=True)),
                       (horst.materialize_owl_horst(given), horst.materialize_owl_horst(given, only_new=True))):
        assert sorted(map(tuple, new.collect())) == sorted(rows(whole) - set(data))


def test_f4_f19_axioms_are_read_in_one_pass(spark, graph):
    data = [("A", t.SUB_CLASS, "B"), ("x", t.TYPE, "A"), ("x", "p", "y"), ("x", "d", '"l"'), ("B", t.TYPE, t.RDFS_CLASS), ("B", t.TYPE, t.CLASS),
            ("p", t.TYPE, t.TRANSITIVE), ("p", t.DOMAIN, "A"), ("d", t.RANGE, "D"), ("x", t.SAME_AS, "z"), ("x", None, "y"), ("x", t.TYPE, None)]
    given = spark.createDataFrame(data + data, "s string, p string, o string")
    got, _ = axs.axioms_from_triples(given)
    assert _plan(got).count("Scan ExistingRDD") == 1
    want = [("SubClassOf", "A", "B", None), ("ClassAssertion", "A", "x", None), ("ObjectPropertyAssertion", "p", "x", "y"),
            ("DataPropertyAssertion", "d", "x", '"l"'), ("Declaration", "B", "Class", None), ("TransitiveObjectProperty", "p", None, None),
            ("ObjectPropertyDomain", "p", "A", None), ("ObjectPropertyRange", "d", "D", None), ("SameIndividual", "x", "z", None)]
    assert sorted(map(str, map(tuple, got.select(*axs.AXIOM).collect()))) == sorted(map(str, want))


def test_f4_f5_given_axioms_are_not_given_again(spark):
    none = inline(spark, [], axs.EXPRESSION)
    given = [("ClassAssertion", "A", "x", None), ("SubClassOf", "A", "B", None), ("ObjectPropertyRange", "p", t.RDFS_CLASS, None),
             ("ObjectPropertyAssertion", "p", "x", "C"), ("Declaration", "C", "Class", None), ("Declaration", "q", "FooProperty", None),
             ("AnnotationPropertyRange", "n", "Y", None)]
    for rows_ in (given, given[:5] + given[6:]):
        found = ax.materialize_axioms_rdfs(spark.createDataFrame(rows_ * 2, "kind string, a string, b string, c string"), none)
        got = list(map(tuple, found.collect()))
        assert len(got) == len(set(got)) and set(got) == {*rows_, ("ClassAssertion", "B", "x", None)}
