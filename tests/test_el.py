import random

from kgweave.functions import terms as t
from kgweave.operators import el
from kgweave.plans.workspace import store
from tests.conftest import rows

SC = t.SUB_CLASS


def some(node, r, filler):
    return [(node, t.ON_PROPERTY, r), (node, t.SOME_VALUES, filler)]


def meet(node, *classes):
    out = [(node, t.INTERSECTION, f"{node}0")]
    for i, c in enumerate(classes):
        out += [(f"{node}{i}", t.FIRST, c), (f"{node}{i}", t.REST, f"{node}{i + 1}" if i + 1 < len(classes) else t.NIL)]
    return out


ONTOLOGY = [
    ("A1", SC, "A2"), ("A2", SC, "A3"), ("A2", SC, "A4"), ("A4", SC, "A5"),                                  # CR1
    *meet("_:m", "B2", "B3"), ("_:m", SC, "BD"), ("B1", SC, "B2"), ("B1", SC, "B3"),                          # CR2
    *meet("_:n", "B2", "B3", "B4"), ("_:n", SC, "BE"), ("B5", SC, "B2"), ("B5", SC, "B3"), ("B5", SC, "B4"),  # CR2, three
    ("C1", SC, "C2"), ("C2", SC, "_:c"), *some("_:c", "cr", "CD"),                                            # CR3
    ("D1", SC, "_:d"), *some("_:d", "dr", "DX"), ("DX", SC, "DY"), *some("_:e", "dr", "DY"), ("_:e", SC, "DE"),  # CR4
    ("E1", SC, "_:f"), *some("_:f", "er", "EX"), ("EX", SC, t.NOTHING),                                       # CR5
    ("F1", SC, "_:g"), *some("_:g", "fr", "FX"), ("fr", t.SUB_PROPERTY, "fs"),                                # CR10
    ("G1", SC, "_:h"), *some("_:h", "g1", "G2"), ("G2", SC, "_:i"), *some("_:i", "g2", "G3"),                 # CR11
    ("g3", t.PROPERTY_CHAIN, "_:ch0"), ("_:ch0", t.FIRST, "g1"), ("_:ch0", t.REST, "_:ch1"),
    ("_:ch1", t.FIRST, "g2"), ("_:ch1", t.REST, t.NIL),
]


def test_completion_rules(graph):
    subsumptions, links = el.derived(el.read_axioms(graph(ONTOLOGY)))
    assert rows(subsumptions) == {
        ("A1", "A3"), ("A1", "A4"), ("A1", "A5"), ("A2", "A5"), ("B1", "BD"), ("B5", "BD"), ("B5", "BE"),
        ("D1", "DE"), ("E1", t.NOTHING)}
    assert rows(links) == {("C1", "cr", "CD"), ("F1", "fs", "FX"), ("G1", "g3", "G3")}


def test_materialized_graph(graph):
    inferred = rows(el.materialize_owl_el(graph(ONTOLOGY))) - set(ONTOLOGY)
    nodes = {s: o for s, p, o in inferred if p == t.ON_PROPERTY}
    assert set(nodes.values()) == {"cr", "fs", "g3"}
    assert len(inferred) == 9 + 3 * 3


def test_extraction(graph):
    df = graph(ONTOLOGY)
    assert ("B2", "B3", "BD") in rows(el.intersection_subclasses(df))
    assert rows(el.restriction_subclasses(df)) == {("dr", "DY", "DE")}
    assert rows(el.property_chains(df)) == {("g1", "g2", "g3")}
    assert ("C2", "cr", "CD") in rows(el.restriction_superclasses(df))


def test_saturation_against_plain_rounds(spark):
    """A random terminology: the loop over contexts ends where applying all rules to all facts ends."""
    rnd = random.Random(3)
    names = [f"K{i}" for i in range(14)]
    one = lambda: rnd.choice(names)
    read = {
        "below": {(one(), one()) for _ in range(14)} | {(names[0], t.NOTHING)},
        "meets": {(one(), one(), one()) for _ in range(6)},
        "some_below": {(rnd.choice("pqu"), one(), one()) for _ in range(5)},
        "some_above": {(one(), rnd.choice("pqu"), one()) for _ in range(7)},
        "roles": {("p", "q")},
        "chains": {("p", "q", "u")},
    }
    columns = {"below": "c d", "meets": "c1 c2 d", "some_below": "r filler d", "some_above": "c r filler",
               "roles": "r q", "chains": "r1 r2 q"}
    axioms = el.Axioms(**{k: store(spark.createDataFrame(sorted(v), columns[k].split())) for k, v in read.items()})
    s, e = set(read["below"]), set(read["some_above"])
    while True:
        more_s = {(c, x) for c, d in s for y, x in read["below"] if y == d}
        more_s |= {(c, x) for c, d in s for a, b, x in read["meets"] if a == d and (c, b) in s}
        more_s |= {(c, x) for c, r, d in e for q, f, x in read["some_below"] if q == r and (d, f) in s}
        more_s |= {(c, t.NOTHING) for c, r, d in e if (d, t.NOTHING) in s}
        more_e = {(c, r, f) for c, d in s for y, r, f in read["some_above"] if y == d}
        more_e |= {(c, q, d) for c, r, d in e for p, q in read["roles"] if p == r}
        more_e |= {(c, q, d) for c, r, m in e for n, r2, d in e for a, b, q in read["chains"]
                   if n == m and a == r and b == r2}
        if more_s <= s and more_e <= e:
            break
        s, e = s | more_s, e | more_e
    assert rows(el.complete(axioms).known) == {(c, "", d) for c, d in s} | e


def test_a_class_in_many_intersections_is_not_spelled_out(graph, monkeypatch):
    """What a round keeps grows with the superclasses of a class, not with the intersections that these begin."""
    kept = []
    append = el.Contexts.append

    def noted(self, frames):
        kept.extend(df.count() for df in frames.values())
        append(self, frames)

    monkeypatch.setattr(el.Contexts, "append", noted)
    facts = [x for i in range(60) for x in (*meet(f"_:m{i}_", "Hub", f"K{i}"), (f"_:m{i}_", SC, f"L{i}"))]
    facts += [x for i in range(20) for x in ((f"x{i}", SC, "Hub"), (f"x{i}", SC, f"K{i}"))]
    subsumptions, _ = el.derived(el.read_axioms(graph(facts)))
    assert rows(subsumptions) == {(f"x{i}", f"L{i}") for i in range(20)}
    assert sum(kept) < 200


def test_duplicates_are_removed_after_the_join(graph):
    facts = graph([*some("_:r", "r", "F"), ("A", SC, "_:r"), ("A", SC, "_:r"), ("A", SC, "B"), ("A", SC, "B")])
    found = el.restriction_superclasses(facts, el.restriction_nodes(facts).limit(5))
    assert [tuple(r) for r in found.collect()] == [("A", "r", "F")]
    assert [tuple(r) for r in el.atomic_subclasses(facts).collect()] == [("A", "B")]
    plan = el.restriction_superclasses(facts, facts.selectExpr("s AS node", "p AS r", "o AS filler"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == 2
