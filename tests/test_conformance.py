"""Premise and conclusion pairs: what is inferred beyond the premise is exactly the conclusion.

All cases run as one graph; each one's terms carry its name, so they cannot interfere.
"""

from kgweave.functions import terms as t
from kgweave.operators.graph import TERMINOLOGICAL_TYPES
from kgweave.operators.horst import materialize_owl_horst
from kgweave.operators.rdfs import Level, materialize_rdfs
from tests.conftest import rows

A, SC, SP = t.TYPE, t.SUB_CLASS, t.SUB_PROPERTY

RDFS_CASES = {
    "domain": ([("u", "p", "v"), ("p", t.DOMAIN, "c")], [("u", A, "c")]),
    "range": ([("u", "p", "v"), ("p", t.RANGE, "c")], [("v", A, "c")]),
    "two-domains": ([("u", "p", "v"), ("p", t.DOMAIN, "c"), ("p", t.DOMAIN, "d")], [("u", A, "c"), ("u", A, "d")]),
    "literal-range": ([("u", "p", '"v"'), ("p", t.RANGE, "c")], []),
    "subclass": ([("c1", SC, "c2"), ("w", A, "c1")], [("w", A, "c2")]),
    "subclass-trans": ([("c1", SC, "c2"), ("c2", SC, "c3")], [("c1", SC, "c3")]),
    "subprop": ([("s", "p1", "o"), ("p1", SP, "p2")], [("s", "p2", "o")]),
    "subprop-trans": ([("p1", SP, "p2"), ("p2", SP, "p3")], [("p1", SP, "p3")]),
    "inherited-domain": ([("s", "p1", "o"), ("p1", SP, "p2"), ("p2", t.DOMAIN, "c"), ("c", SC, "d")],
                         [("s", "p2", "o"), ("s", A, "c"), ("s", A, "d")]),
}
HORST_CASES = {
    "functional": ([("x", "p", "y1"), ("x", "p", "y2"), ("p", A, t.FUNCTIONAL)],
                   [("y1", t.SAME_AS, "y2"), ("y2", t.SAME_AS, "y1")]),
    "functional-literals": ([("x", "p", '"1"'), ("x", "p", '"2"'), ("p", A, t.FUNCTIONAL)], []),
    "inversefunc-data": ([("x1", "p", '"data"'), ("x2", "p", '"data"'), ("p", A, t.INVERSE_FUNCTIONAL),
                          ("p", A, t.DATA_PROPERTY)], [("x1", t.SAME_AS, "x2"), ("x2", t.SAME_AS, "x1")]),
    "symmetric": ([("x", "p", "y"), ("p", A, t.SYMMETRIC)], [("y", "p", "x")]),
    "transitive": ([("x", "p", "y"), ("y", "p", "z"), ("p", A, t.TRANSITIVE)], [("x", "p", "z")]),
    "two-transitive": ([("x", "p", "y"), ("y", "q", "z"), ("z", "q", "w"), ("p", A, t.TRANSITIVE), ("q", A, t.TRANSITIVE)],
                       [("y", "q", "w")]),
    "inverse": ([("s1", "p", "o1"), ("s2", "q", "o2"), ("q", t.INVERSE_OF, "p")], [("o1", "q", "s1"), ("o2", "p", "s2")]),
    "eqclass-1": ([("c1", t.EQUIVALENT_CLASS, "c2")],
                  [("c1", SC, "c2"), ("c2", SC, "c1"), ("c2", t.EQUIVALENT_CLASS, "c1")]),
    "eqclass-2": ([("c1", SC, "c2"), ("c2", SC, "c1")],
                  [("c1", t.EQUIVALENT_CLASS, "c2"), ("c2", t.EQUIVALENT_CLASS, "c1")]),
    "eqprop-1": ([("p1", t.EQUIVALENT_PROPERTY, "p2")],
                 [("p1", SP, "p2"), ("p2", SP, "p1"), ("p2", t.EQUIVALENT_PROPERTY, "p1")]),
    "eqprop-2": ([("p1", SP, "p2"), ("p2", SP, "p1")],
                 [("p1", t.EQUIVALENT_PROPERTY, "p2"), ("p2", t.EQUIVALENT_PROPERTY, "p1")]),
    "hasvalue-obj": ([("z", t.HAS_VALUE, "u"), ("z", t.ON_PROPERTY, "p"), ("w", A, "z")], [("w", "p", "u")]),
    "hasvalue-subj": ([("z", t.HAS_VALUE, "u"), ("z", t.ON_PROPERTY, "p"), ("w", "p", "u"), ("w2", "p", "no")],
                      [("w", A, "z")]),
    "somevalues": ([("z", t.ON_PROPERTY, "p"), ("z", t.SOME_VALUES, "c"), ("x", A, "c"), ("w", "p", "x"), ("w2", "q", "x")],
                   [("w", A, "z")]),
    "allvalues": ([("z", t.ON_PROPERTY, "p"), ("z", t.ALL_VALUES, "c"), ("w", A, "z"), ("w", "p", "x"), ("w", "p", '"l"')],
                  [("x", A, "c")]),
    # A property triple that appears in a later round still triggers the rules on it.
    "late-property": ([("z", t.ON_PROPERTY, "p"), ("z", t.HAS_VALUE, "v"), ("d", SC, "z"), ("y", t.ON_PROPERTY, "q"),
                       ("y", t.SOME_VALUES, "d"), ("p", SP, "r"), ("a", A, "d")],
                      [("a", A, "z"), ("a", "p", "v"), ("a", "r", "v")]),
    "flipped-domain": ([("a", "p", "b"), ("p", t.INVERSE_OF, "q"), ("q", t.DOMAIN, "c"), ("q", SP, "r")],
                       [("b", "q", "a"), ("b", "r", "a"), ("b", A, "c")]),
}


def packed(cases, index):
    def term(name, x):
        return x if "://" in x or x.startswith('"') else f"{name}#{x}"
    return {(term(n, s), term(n, p), term(n, o)) for n, case in cases.items() for s, p, o in case[index]}


def test_packing_keeps_vocabulary_apart():
    assert all("://" in c for c in TERMINOLOGICAL_TYPES)


def test_rdfs_simple(graph):
    premise = packed(RDFS_CASES, 0)
    assert rows(materialize_rdfs(graph(premise), Level.SIMPLE)) - premise == packed(RDFS_CASES, 1)


def test_owl_horst(graph):
    cases = RDFS_CASES | HORST_CASES
    premise = packed(cases, 0)
    assert rows(materialize_owl_horst(graph(premise))) - premise == packed(cases, 1)


def test_property_below_type_extends_the_terminology(graph):
    premise = {("isA", SP, t.TYPE), ("x", "isA", "c"), ("c", SC, "d"), ("below", SP, t.SUB_CLASS), ("d", "below", "e")}
    derived = {("x", A, "c"), ("x", A, "d"), ("x", A, "e"), ("d", SC, "e"), ("c", SC, "e")}
    assert rows(materialize_rdfs(graph(premise), Level.SIMPLE)) - premise == derived
    assert rows(materialize_owl_horst(graph(premise))) - premise == derived


def test_full_adds_axioms_and_is_stable(graph):
    full = rows(materialize_rdfs(graph([("a", "p", "b"), ("c", SC, "d")]), Level.FULL))
    assert {("p", A, t.PROPERTY), ("p", SP, "p"), ("c", A, t.RDFS_CLASS), ("c", SC, "c"), ("c", SC, t.RESOURCE),
            ("a", A, t.RESOURCE), (t.RDFS + "Datatype", SC, t.RDFS_CLASS)} <= full
    assert rows(materialize_rdfs(graph(full), Level.FULL)) == full
