"""What large graphs must not do: hold a file's rows in a task, compare leaves in every round, sort every name."""

from collections import Counter

from kgweave.functions import terms as t
from kgweave.operators import abstraction, closure, dictionary, intervals, isomorphism as iso, rdfs
from tests.conftest import rows


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def _aggregates_below_exchanges(df, columns: int) -> int:
    """Partial aggregations over as many keys that stand under an exchange."""
    lines, n = _plan(df), 0
    for above, line in zip(lines, lines[1:]):
        if "Exchange hashpartitioning" in above and "HashAggregate(keys=[" in line:
            n += line.split("keys=[")[1].split("]")[0].count("#") >= columns
    return n


def _walk(edges):
    closed = set(edges)
    while True:
        more = closed | {(a, d) for a, b in closed for c, d in edges if b == c}
        if more == closed:
            return closed
        closed = more


def test_f34_leaves_take_no_part_in_the_rounds(spark, monkeypatch):
    edges = [(f"leaf{i}", f"n{i % 3}") for i in range(30)] + [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n2", "top")]
    given, seen = spark.createDataFrame(edges + edges[:5], "s string, o string"), []
    inner = closure.FactTable.append

    def append(self, candidates):
        found = inner(self, candidates)
        seen.append(found)
        return found

    monkeypatch.setattr(closure, "TINY_ROWS", 0)
    monkeypatch.setattr(closure.FactTable, "append", append)
    for limit in (300_000, 0):
        seen.clear()
        monkeypatch.setattr(closure, "BROADCAST_ROWS", limit)
        got = closure.close_into_table(given, [])
        assert Counter(map(tuple, got.known.collect())) == Counter(_walk(edges)) and got.rows == len(_walk(edges))
        assert seen[0] == 4
    assert closure.closure(given.where("false")).count() == 0


def test_f35_rounds_by_rows_get_new_rows_only(spark):
    edges, sizes = spark.createDataFrame([(i, i + 1) for i in range(8)], "s long, o long"), []

    def step(known):
        sizes.append(known.count())
        return closure.compose(known, edges, [])

    got = closure.fixpoint(edges, step, by_rows=True)
    assert rows(got) == {(a, b) for a in range(9) for b in range(a + 1, 9)}
    assert sizes == [8, 7, 6, 5, 4, 3, 2, 1]


def test_f17_other_ground_facts_end_before_colours_are_refined(graph, monkeypatch):
    first = [("_:" + "a" * 60, "p", "_:b"), ("_:b", "p", "x")]
    rounds, refined = [], iso._refined
    monkeypatch.setattr(iso, "_refined", lambda *args: rounds.append(1) or refined(*args))
    assert not iso.same_graph(graph(first), graph([("_:c", "p", "_:d"), ("_:d", "p", "y")]))
    assert rounds == []
    assert iso.same_graph(graph(first), graph([("_:c", "p", "_:d"), ("_:d", "p", "x")]))
    names = {n for r in iso._short_names([graph(first)]).collect() for n in (r.s, r.o) if n.startswith("_:")}
    assert len(names) == 2 and max(map(len, names)) == 13


def test_f27_f30_signatures_need_no_sort(spark, graph, monkeypatch):
    data = [("a", t.TYPE, "C"), ("a", t.TYPE, "B"), ("a", "p", "b"), ("b", "q", "a"), ("b", "q", None), (None, "p", "b"), ("c", None, "b")]
    data += [(f"x{i}", f"p{i:03}", "hub") for i in range(130)]
    given = spark.createDataFrame(data, "s string, p string, o string")
    marked = abstraction.compute_types(given)
    assert not [line for line in _plan(marked) if "ObjectHashAggregate" in line]
    got = {r[0]: tuple(map(tuple, r[1:])) for r in marked.collect()}
    monkeypatch.setattr(abstraction, "MARKED", 0)
    assert got == {r[0]: tuple(map(tuple, r[1:])) for r in abstraction.compute_types(given).collect()}
    assert got["a"] == (("B", "C"), ("p", t.TYPE), ("q",)) or got["a"] == (("B", "C"), (t.TYPE, "p"), ("q",))
    assert got["hub"] == ((), (), tuple(f"p{i:03}" for i in range(130))) and got["c"] == ((), (), ())


def test_f21_f31_f33_no_triples_are_collected_before_the_shuffle(graph):
    data = [("A", t.SUB_CLASS, "B"), ("x", t.TYPE, "A"), ("x", t.TYPE, "A"), ("x", "p", "y"), ("x", "p", "y"), ("p", t.SUB_PROPERTY, "q"),
            ("q", t.DOMAIN, "A"), ("p", t.RANGE, "D"), ("y", "q", '"lit"'), ("z", "r", "z2")]
    given = graph(data)
    types = intervals.infer_types(given, intervals.label_classes(given))
    assert types.collect() == [("x", t.TYPE, "B")] and not _aggregates_below_exchanges(types, 2)
    simple = rdfs.materialize_rdfs(given, rdfs.Level.SIMPLE)
    more = {("x", "q", "y"), ("x", t.TYPE, "B"), ("y", t.TYPE, "D"), ("y", t.TYPE, "A"), ("y", t.TYPE, "B")}
    assert Counter(map(tuple, simple.collect())) == Counter(set(data) | more)
    closed = closure.transitive_reasoner(given, ["p"])
    assert Counter(map(tuple, closed.collect())) == Counter(set(data))


def test_f25_reasons_become_classes_after_the_shuffle(graph):
    data = [("x", "p", "y"), ("x", "p", '"l"'), ("p", t.DOMAIN, "A"), ("p", t.DOMAIN, "B"), ("p", t.RANGE, "C"), (t.TYPE, t.SUB_PROPERTY, "kind"),
            ("w", t.TYPE, "A"), ("A", t.TYPE, t.RDFS_CLASS), (t.TYPE, t.RANGE, "K")]
    got = rdfs.materialize_rdfs(graph(data + data), rdfs.Level.DEFAULT)
    nodes = {x for s, _, o in data for x in (s, o) if not x.startswith('"')}
    want = set(data) | {(n, t.TYPE, t.RESOURCE) for n in nodes} | {("x", t.TYPE, "A"), ("x", t.TYPE, "B"), ("y", t.TYPE, "C")} | {
        ("w", "kind", "A"), ("A", "kind", t.RDFS_CLASS), ("A", t.TYPE, "K"), (t.RDFS_CLASS, t.TYPE, "K"),
        ("A", t.SUB_CLASS, t.RESOURCE), ("A", t.SUB_CLASS, "A")}
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert "node" in "".join(line for line in _plan(got) if "Exchange hashpartitioning(node" in line)


def test_f22_encoding_without_shared_ids_sorts_no_names(spark, graph, monkeypatch):
    given, calls = graph([(f"s{i}", "p", f"o{i % 3}") for i in range(20)]), []
    stored = dictionary.store
    monkeypatch.setattr(dictionary, "store", lambda df: calls.append(df) or stored(df))
    encoded, terms = dictionary.encode_terms(given)
    assert len(calls) == 2 and not [line for df in calls for line in _plan(df) if "SortAggregate" in line]
    calls.clear()
    assert Counter(map(tuple, dictionary.decode_terms(encoded, terms).collect())) == Counter(map(tuple, given.collect()))
    assert calls == []  # ids are neither written nor counted again
