"""Pattern rules, and dedicated operators against the same rules stated as patterns."""

import pytest

from kgweave.functions import terms as t
from kgweave.operators import owlrl, patterns, rulesets
from kgweave.operators.backward import GoalReasoner
from kgweave.operators.components import connected_components
from kgweave.operators.horst import materialize_owl_horst
from kgweave.operators.rdfs import Level, materialize_rdfs
from kgweave.plans.workspace import FixpointNotReached
from kgweave.sources.inline import inline
from tests.conftest import rows

A, SC, SP = t.TYPE, t.SUB_CLASS, t.SUB_PROPERTY

MIXED = [
    ("a", A, "A"), ("a", "p", "b1"), ("p", SP, "p1"), ("A", SC, "B"),
    ("A", SC, "_:hv"), ("_:hv", t.ON_PROPERTY, "p2"), ("_:hv", t.HAS_VALUE, "value"),
    ("_:s1", t.ON_PROPERTY, "p"), ("_:s1", t.SOME_VALUES, "S1"), ("_:s2", t.ON_PROPERTY, "p"), ("_:s2", t.SOME_VALUES, "S2"),
    ("x15", "p", "y1"), ("y1", A, "S1"), ("x15", "p", "y2"), ("y2", A, "S2"),
    ("_:a1", t.ON_PROPERTY, "p"), ("_:a1", t.ALL_VALUES, "V1"), ("_:a2", t.ON_PROPERTY, "p"), ("_:a2", t.ALL_VALUES, "V2"),
    ("x16", "p", "y16"), ("x16", A, "_:a1"), ("x16", A, "_:a2"),
    ("p4", A, t.TRANSITIVE), ("t1", "p4", "t2"), ("t2", "p4", "t3"), ("t3", "p4", "t4"),
    ("f", A, t.FUNCTIONAL), ("f", A, t.INVERSE_FUNCTIONAL), ("k1", "f", "v1"), ("k1", "f", "v2"), ("m1", "f", "w"), ("m2", "f", "w"),
    ("inv", t.INVERSE_OF, "p4"), ("sym", A, t.SYMMETRIC), ("sym", SP, "p1"), ("q1", "sym", "q2"),
    ("C1", t.EQUIVALENT_CLASS, "C2"), ("C2", SC, "A"), ("z", A, "C1"), ("a1", t.SAME_AS, "a2"),
    ("p1", t.DOMAIN, "D"), ("p1", t.RANGE, "R"), ("l", "p1", '"text"'),
]


def no_loops(triples):
    return {r for r in triples if not (r[0] == r[2] and r[1] in (SC, SP))}


def test_horst_agrees_with_its_rule_set(graph):
    dedicated = rows(materialize_owl_horst(graph(MIXED)))
    assert dedicated == no_loops(rows(patterns.materialize(graph(MIXED), rulesets.OWL_HORST)))


def test_rl_agrees_with_its_rule_set(graph, spark):
    """Pairwise copies of the rule set, moved onto canonical terms, are the merged result."""
    data = MIXED + [
        ("p", A, t.OBJECT_PROPERTY), ("dp", A, t.DATA_PROPERTY), ("_:dt", t.ON_PROPERTY, "dp"),
        ("_:dt", t.SOME_VALUES, t.XSD + "int"), ("n1", "dp", f'"1"^^<{t.XSD}int>'), ("n2", "dp", '"1"'),
        ("_:any", t.ON_PROPERTY, "p4"), ("_:any", t.SOME_VALUES, t.THING),
        ("_:max", t.ON_PROPERTY, "h"), ("_:max", t.MAX_CARDINALITY, '"1"'), ("o1", A, "_:max"), ("o1", "h", "h1"), ("o1", "h", "h2"),
        # Merging h1 and h2 gives one subject two values of a functional property: merged in turn.
        ("h1", "f", "g1"), ("h2", "f", "g2"), ("g1", "likes", "cake"),
        ("E", t.ONE_OF, "_:l1"), ("_:l1", t.FIRST, "e1"), ("_:l1", t.REST, "_:l2"), ("_:l2", t.FIRST, "e2"), ("_:l2", t.REST, t.NIL),
    ]
    pairwise = rows(patterns.materialize(graph(data), rulesets.OWL_RL))
    merged = rows(owlrl.materialize_owl_rl(graph(data)))
    same = [(s, o) for s, p, o in pairwise if p == t.SAME_AS]
    root = dict(rows(connected_components(inline(spark, same, ["s", "o"]))))
    plain = {r for r in merged if r[1] != t.SAME_AS}
    assert plain == {(root.get(s, s), p, root.get(o, o)) for s, p, o in pairwise if p != t.SAME_AS}
    stars = {(s, o) for s, p, o in merged if p == t.SAME_AS and s != o}
    assert stars == {pair for n, c in root.items() if n != c for pair in ((n, c), (c, n))}
    asked = inline(spark, [("g2",)], ["node"])
    assert ("g2", "likes", "cake") in rows(owlrl.expand_nodes(graph(merged), asked))


def test_naive_and_seminaive(graph):
    expected = rows(materialize_rdfs(graph(MIXED), Level.SIMPLE))
    assert rows(patterns.materialize(graph(MIXED), rulesets.RDFS_SIMPLE)) == expected
    assert rows(patterns.materialize_naive(graph(MIXED), rulesets.RDFS_SIMPLE)) == expected
    assert rows(materialize_rdfs(graph(expected), Level.SIMPLE)) == expected
    with pytest.raises(FixpointNotReached):
        patterns.materialize(graph(MIXED), rulesets.OWL_HORST, max_rounds=1)


def test_builtins_and_unconnected_patterns(graph):
    data = graph([("a", "p", "b"), ("a", "p", '"1"'), ("a", "q", "a"), ("l", t.FIRST, "b"), ("l", t.REST, t.NIL)])
    assert rows(patterns.bgp(data, [("?x", "p", "?y")], [("notLiteral", "?y")])) == {("a", "b")}
    assert rows(patterns.bgp(data, [("?x", "q", "?x")])) == {("a",)}
    assert rows(patterns.bgp(data, [("?x", "p", "?y")], [("listContains", "l", "?y")]).select("x", "y")) == {("a", "b")}
    with pytest.raises(patterns.UnconnectedPatterns):
        patterns.bgp(data, [("?x", "p", "?y"), ("?z", "q", "?w")])


def test_goals_match_materialization(graph):
    data = graph(MIXED)
    everything = rows(materialize_rdfs(data, Level.SIMPLE))
    goal = GoalReasoner(data)
    for s, p, o in [(None, A, "B"), ("a", A, None), (None, A, None), (None, "p1", None), ("x15", "p1", None), (None, "p1", "y2"),
                    (None, SC, "A"), ("a", None, None), (None, None, "B"), (None, None, None), (None, t.DOMAIN, None)]:
        wanted = {r for r in everything if all(q is None or q == x for q, x in zip((s, p, o), r))}
        assert rows(goal.query(s, p, o)) == wanted, (s, p, o)
    assert goal.is_entailed(("a", A, "B")) and not goal.is_entailed(("a", A, "S1"))
