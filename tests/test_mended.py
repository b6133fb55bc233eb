"""Inputs that rarely occur: very long literals, escapes, odd labels, shared list cells, properties below built-ins."""

import random

import pytest

from kgweave.functions import terms as t
from kgweave.operators import backward, closure, el, owlrl, validate
from kgweave.operators.lists import unfold_list
from kgweave.operators.rdfs import Level, materialize_rdfs
from kgweave.plans.workspace import FixpointNotReached
from kgweave.sources.inline import inline
from kgweave.sources.ntriples import parse_lines
from tests.conftest import rows


def parsed(spark, lines, strict=True):
    return parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), strict).collect()


def test_long_literals_and_long_malformed_lines(spark):
    body, escapes = "x" * 1_000_000, r"\"" * 500_000
    good = [f'<a> <p> "{body}"@en .', f'_:b <p> "{escapes}" . # note', "", "# only a comment"]
    assert [tuple(r) for r in parsed(spark, good)] == [("a", "p", f'"{body}"@en'), ("_:b", "p", f'"{escapes}"')]
    bad = [f'<a> <p> "{body}', f'<a> <p> "{escapes}', "\x01<a>\x01<p>\x01<o>", "<a" * 100_000, f"<a> <p> {'o' * 100_000}"]
    assert parsed(spark, bad, strict=False) == []
    with pytest.raises(Exception, match="not an N-Triples line"):
        parsed(spark, bad[:1])


def test_one_spelling_per_term(spark):
    lines = [r'<\u00e9> <p> "a\u0041\U0001F600\t\u0009\'\\u0041\u0022\uD800" .', '<é> <p> "aA😀\\t\\t\'\\\\u0041\\"\\uD800" .']
    first, second = parsed(spark, lines)
    assert first == second and first.s == "é" and first.o == '"aA😀\\t\\t\'\\\\u0041\\"\\uD800"'


def test_user_nodes_with_any_label_stay(spark, graph):
    got = rows(el.materialize_owl_el(graph([
        ("_:and-x", t.SUB_CLASS, "B"), ("B", t.SUB_CLASS, "C"), ("D", t.SUB_CLASS, "_:and-x")])))
    assert {("_:and-x", t.SUB_CLASS, "C"), ("D", t.SUB_CLASS, "_:and-x"), ("D", t.SUB_CLASS, "C")} <= got


def test_limit_counts_compositions_at_every_size(spark, monkeypatch):
    path = inline(spark, [(f"x{i:02}", f"x{i + 1:02}") for i in range(20)], ["s", "o"])
    for tiny in (closure.TINY_ROWS, 0):
        monkeypatch.setattr(closure, "TINY_ROWS", tiny)
        with pytest.raises(FixpointNotReached):
            closure.closure(path, max_rounds=3)
        assert closure.closure(path, max_rounds=5).count() == 210


def test_list_that_starts_inside_another(spark, graph):
    cells = [("l0", t.FIRST, "a"), ("l0", t.REST, "l1"), ("l1", t.FIRST, "b"), ("l1", t.REST, "l2"),
             ("l2", t.FIRST, "c"), ("l2", t.REST, t.NIL), ("C", t.ONE_OF, "l0"), ("D", t.ONE_OF, "l1")]
    assert rows(unfold_list(graph(cells))) == {
        ("l0", 1, "a"), ("l0", 2, "b"), ("l0", 3, "c"), ("l1", 1, "b"), ("l1", 2, "c")}
    assert {("b", t.TYPE, "D"), ("c", t.TYPE, "D"), ("a", t.TYPE, "C")} <= rows(owlrl.one_of_members(graph(cells)))


def test_stated_equality_is_kept_either_way(spark, graph):
    stated = [("a", t.SAME_AS, "b"), ("b", t.SAME_AS, "c")]
    for more in ([], [("c", "p", "x")]):
        assert set(stated) <= rows(owlrl.materialize_owl_rl(graph(stated + more)))


def test_all_clashing_members_are_reported(spark, graph):
    listed = [("_:g", t.TYPE, t.ALL_DISJOINT_PROPERTIES), ("_:g", t.MEMBERS, "l0")]
    for i, p in enumerate("pqr"):
        listed += [(f"l{i}", t.FIRST, p), (f"l{i}", t.REST, f"l{i + 1}" if i < 2 else t.NIL), ("x", p, "y")]
    assert {(r.arg1, r.arg2) for r in validate.all_disjoint_properties(graph(listed)).collect()} == {("p", "q"), ("p", "r")}
    same = [("b", t.SAME_AS, "a"), ("c", t.SAME_AS, "a"), ("_:d", t.DISTINCT_MEMBERS, "m0")]
    for i, n in enumerate("abc"):
        same += [(f"m{i}", t.FIRST, n), (f"m{i}", t.REST, f"m{i + 1}" if i < 2 else t.NIL)]
    assert {(r.node, r.arg1) for r in validate.same_and_different(graph(same)).collect()} == {("a", "b"), ("a", "c")}


@pytest.mark.parametrize("seed", range(2))
def test_goals_agree_with_materialization(spark, graph, seed):
    rng = random.Random(seed)
    names = ["A", "B", "C", "isA", "q", "x", "y"]
    triples = [("isA", t.SUB_PROPERTY, t.TYPE), ("kind", t.SUB_PROPERTY, t.SUB_CLASS), ("q", t.SUB_PROPERTY, "isA"),
               ("x", "isA", "A"), ("A", "kind", "B"), ("y", "q", "C")]
    triples += [(rng.choice(names), rng.choice([t.SUB_CLASS, t.DOMAIN, t.RANGE, "isA", "kind", "q"]), rng.choice(names))
                for _ in range(6)]
    data = graph(triples)
    whole = rows(materialize_rdfs(data, Level.SIMPLE))
    asked = backward.GoalReasoner(data)
    for s, p, o in [(None, t.TYPE, None), ("x", None, None), (None, t.SUB_CLASS, None), (None, None, "B"), (None, "isA", None),
                    ("y", t.TYPE, "C"), (None, None, None)]:
        want = {r for r in whole if all(w in (None, v) for w, v in zip((s, p, o), r))}
        assert rows(asked.query(s, p, o)) == want, (s, p, o)


def test_goal_names_its_predicates_to_the_scan(spark, graph, tmp_path):
    graph([("p", t.DOMAIN, "A"), ("q", t.SUB_PROPERTY, "p"), ("x", "q", "y"), ("x", "other", "y")]).write.parquet(str(tmp_path / "g"))
    asked = backward.GoalReasoner(spark.read.parquet(str(tmp_path / "g")))
    plan = asked.query(None, t.TYPE, "A")._jdf.queryExecution().executedPlan().toString()
    assert "In(p, [p,q])" in plan or "In(p, [q,p])" in plan
