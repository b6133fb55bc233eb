"""Files, axiom tables, dictionary, signatures, consistency, and the job."""

import pytest

from kgweave.functions import terms as t
from kgweave.job import materialize_job, materialize_profile
from kgweave.operators import abstraction, axioms as ax, dictionary, graph as G, validate
from kgweave.sources import ntriples as nt
from kgweave.sources.axioms import axioms_from_triples, triples_from_axioms
from kgweave.sources.inline import inline
from tests.conftest import rows

LINES = [
    '<ex:a> <ex:p> "typed"^^<http://www.w3.org/2001/XMLSchema#string> .',
    '<ex:a> <ex:p> "plain" . # a remark',
    '<ex:a> <ex:p> "hello"@en .',
    '<ex:a> <ex:p> "été"@fr-be .',
    '<ex:a> <ex:p> "say \\"hi\\" # .\\n it\'s" .',
    '<ex:a> <ex:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .',
    '_:b1 <ex:q> _:b.2 .',
    '<ex:a>\t<ex:q>\t<ex:c>.',
    '<ex:a> <ex:q> _:b3.',
]


def test_ntriples(spark, tmp_path):
    path = str(tmp_path / "data.nt")
    with open(path, "w") as f:
        f.write("# header\n\n" + "\n".join(LINES))
    df = nt.load_ntriples(spark, path)
    got = rows(df)
    assert len(got) == 9
    assert {("_:b1", "ex:q", "_:b.2"), ("ex:a", "ex:q", "ex:c"), ("ex:a", "ex:q", "_:b3"), ("ex:a", "ex:p", '"été"@fr-be'),
            ("ex:a", "ex:p", '"say \\"hi\\" # .\\n it\'s"')} <= got
    out = str(tmp_path / "out")
    nt.write_ntriples(df, out, sorted=True)
    assert rows(nt.load_ntriples(spark, f"{out},{path}").distinct()) == got
    with open(path, "a") as f:
        f.write("\nnot a triple\n")
    with pytest.raises(Exception, match="not an N-Triples line"):
        nt.load_ntriples(spark, path).collect()
    assert rows(nt.load_ntriples(spark, path, strict=False)) == got


def test_term_parts(spark):
    df = inline(spark, [(x,) for x in ['"a"@en', f'"1"^^<{t.XSD}int>', "ex:a", "_:b", t.literal('q"\n')]], ["x"])
    from pyspark.sql import functions as F
    got = [tuple(r) for r in df.select(t.language_of(F.col("x")), t.datatype_of(F.col("x")), t.lexical_of(F.col("x"))).collect()]
    assert got == [("en", "", "a"), ("", t.XSD + "int", "1"), ("", "", "ex:a"), ("", "", "_:b"), ("", "", 'q\\"\\n')]


def test_job(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    data = inline(spark, [("ex:a", t.TYPE, "ex:C"), ("ex:C", t.SUB_CLASS, "ex:D"), ("ex:x", "ex:p", "ex:y"), ("ex:y", "ex:p", "ex:z")], ["s", "p", "o"])
    nt.write_ntriples(data, source)
    materialize_job(spark, source, out, "transitive", ["ex:p"], sorted=True)
    assert rows(nt.load_ntriples(spark, out)) - rows(data) == {("ex:x", "ex:p", "ex:z")}
    assert ("ex:a", t.TYPE, "ex:D") in rows(materialize_profile(data, "rdfs-simple"))
    with pytest.raises(ValueError):
        materialize_profile(data, "owl-full")


def axiom(kind, a, b=None, c=None):
    return (kind, a, b, c)


AXIOMS = [
    axiom("SubClassOf", "C2", "C1"), axiom("SubClassOf", "C3", "C2"), axiom("ClassAssertion", "C3", "i"),
    axiom("SubObjectPropertyOf", "op2", "op1"), axiom("SubDataPropertyOf", "dp2", "dp1"),
    axiom("SubAnnotationPropertyOf", "ap2", "ap1"),
    axiom("ObjectPropertyAssertion", "op2", "a", "b"), axiom("DataPropertyAssertion", "dp2", "a", '"1"'),
    axiom("AnnotationAssertion", "ap2", "a", "note"),
    axiom("ObjectPropertyDomain", "op1", "D"), axiom("ObjectPropertyRange", "op1", "R"), axiom("DataPropertyRange", "dp1", "X"),
    axiom("AnnotationPropertyRange", "ap1", "Y"),
]
RDFS_NEW = {
    axiom("SubClassOf", "C3", "C1"), axiom("ClassAssertion", "C2", "i"), axiom("ClassAssertion", "C1", "i"),
    axiom("ObjectPropertyAssertion", "op1", "a", "b"), axiom("DataPropertyAssertion", "dp1", "a", '"1"'),
    axiom("AnnotationAssertion", "ap1", "a", "note"), axiom("ClassAssertion", "D", "a"), axiom("ClassAssertion", "R", "b"),
}
HORST_MORE = [
    axiom("FunctionalObjectProperty", "fo"), axiom("ObjectPropertyAssertion", "fo", "f1", "f2"), axiom("ObjectPropertyAssertion", "fo", "f1", "f3"),
    axiom("SymmetricObjectProperty", "so"), axiom("ObjectPropertyAssertion", "so", "s1", "s2"),
    axiom("TransitiveObjectProperty", "to"), axiom("ObjectPropertyAssertion", "to", "t1", "t2"), axiom("ObjectPropertyAssertion", "to", "t2", "t3"),
    axiom("InverseObjectProperties", "io", "jo"), axiom("ObjectPropertyAssertion", "io", "i1", "i2"),
    axiom("EquivalentClasses", "E1", "E2"), axiom("EquivalentDataProperties", "q1", "q2"),
    axiom("EquivalentClasses", "H", "_:h"), axiom("DataPropertyAssertion", "hp", "h1", '"ABCD"'), axiom("DataPropertyAssertion", "hp", "h2", '"X"'),
    axiom("ClassAssertion", "H", "h3"),
]
HORST_NEW = {
    axiom("SameIndividual", "f2", "f3"), axiom("SameIndividual", "f3", "f2"), axiom("ObjectPropertyAssertion", "so", "s2", "s1"),
    axiom("ObjectPropertyAssertion", "to", "t1", "t3"), axiom("ObjectPropertyAssertion", "jo", "i2", "i1"),
    axiom("SubClassOf", "E1", "E2"), axiom("SubClassOf", "E2", "E1"), axiom("EquivalentClasses", "E2", "E1"),
    axiom("SubDataPropertyOf", "q1", "q2"), axiom("SubDataPropertyOf", "q2", "q1"), axiom("EquivalentDataProperties", "q2", "q1"),
    axiom("SubClassOf", "H", "_:h"), axiom("SubClassOf", "_:h", "H"), axiom("EquivalentClasses", "_:h", "H"),
    axiom("ClassAssertion", "_:h", "h1"), axiom("ClassAssertion", "H", "h1"), axiom("ClassAssertion", "_:h", "h3"),
    axiom("DataPropertyAssertion", "hp", "h3", '"ABCD"'),
}


def test_axioms(spark):
    columns = ["kind", "a", "b", "c"]
    none = inline(spark, [], ["id", "kind", "prop", "filler"])
    rdfs = inline(spark, AXIOMS, columns)
    assert rows(ax.materialize_axioms_rdfs(rdfs, none)) - set(AXIOMS) == RDFS_NEW
    both = inline(spark, AXIOMS + HORST_MORE, columns)
    expressions = inline(spark, [("_:h", "DataHasValue", "hp", '"ABCD"')], ["id", "kind", "prop", "filler"])
    assert rows(ax.materialize_axioms_owl_horst(both, expressions)) - set(AXIOMS + HORST_MORE) == RDFS_NEW | HORST_NEW
    back, exprs = axioms_from_triples(triples_from_axioms(both, expressions))
    assert {r for r in rows(back) if r[0] != "Declaration"} == set(AXIOMS + HORST_MORE)
    assert rows(exprs) == {("_:h", "DataHasValue", "hp", '"ABCD"')}
    closed = rows(ax.close_axioms(rdfs))
    assert ("SubClassOf", "C3", "C1", None) in closed and len(closed) == 6


def test_dictionary_and_signatures(spark, graph):
    data = [("a", t.TYPE, "C"), ("b", t.TYPE, "C"), ("a", "p", "x"), ("b", "p", "x"), ("_:n", "q", '"1"')]
    encoded, terms = dictionary.encode_terms(graph(data))
    assert rows(dictionary.decode_terms(encoded, terms)) == set(data)
    assert dict(terms.select("term", "kind").collect()) == {
        "a": 0, "b": 0, "C": 0, "x": 0, "p": 0, "q": 0, t.TYPE: 0, "_:n": 1, '"1"': 2}
    sizes = {tuple(map(tuple, r[:3])): r[3] for r in abstraction.signature_sizes(abstraction.compute_types(graph(data))).collect()}
    assert sizes == {(("C",), (t.TYPE, "p") if t.TYPE < "p" else ("p", t.TYPE), ()): 2, ((), (), ("p",)): 1,
                     ((), ("q",), ()): 1, ((), (), ("q",)): 1}


def test_graph_basics(graph):
    df = graph([("a", "p", "b"), ("a", "p", "b"), ("b", "p", "b")])
    assert G.bag_difference(df, df.distinct()).count() == 1
    assert rows(G.find_pattern(df, ("?x", "p", "?x"))) == {("b", "p", "b")}
    assert G.same_graph(df, df.distinct()) and not G.same_graph(df, df.where("s = 'a'"))


def test_consistency(graph):
    data = [
        ("D", t.DISJOINT_CLASS, "E"), ("x", t.TYPE, "D"), ("x", t.TYPE, "E"), ("y", t.TYPE, "D"),
        ("ir", t.TYPE, t.IRREFLEXIVE), ("x", "ir", "x"), ("x", "ir", "y"),
        ("as", t.TYPE, t.ASYMMETRIC), ("x", "as", "y"), ("y", "as", "x"), ("x", "as", "z"),
        ("p1", t.DISJOINT_PROPERTY, "p2"), ("x", "p1", "y"), ("x", "p2", "y"), ("y", "p2", "x"),
        ("g", t.TYPE, t.ALL_DISJOINT_PROPERTIES), ("g", t.MEMBERS, "l1"), ("l1", t.FIRST, "p1"), ("l1", t.REST, "l2"),
        ("l2", t.FIRST, "p2"), ("l2", t.REST, t.NIL),
        ("r", t.ON_PROPERTY, "p1"), ("r", t.MAX_CARDINALITY, t.integer_literals(0)[1]), ("x", t.TYPE, "r"),
        ("m", t.SAME_AS, "n"), ("n", t.SAME_AS, "m"), ("n", t.DIFFERENT_FROM, "m"), ("bad", t.TYPE, t.NOTHING),
        ("w", t.DISTINCT_MEMBERS, "k1"), ("k1", t.FIRST, "m"), ("k1", t.REST, "k2"), ("k2", t.FIRST, "n"), ("k2", t.REST, t.NIL),
    ]
    found = {(r.node, r.rule) for r in validate.validate(graph(data)).collect()}
    assert found == {("x", "cax-dw"), ("x", "prp-irp"), ("x", "prp-asyp"), ("y", "prp-asyp"), ("x", "prp-pdw"), ("x", "prp-adp"),
                     ("x", "cls-maxc1"), ("n", "eq-diff1"), ("m", "eq-diff1"), ("bad", "cls-nothing")}
