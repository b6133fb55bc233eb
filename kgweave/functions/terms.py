"""RDF terms as plain strings, and column expressions over them.

One string per term: an IRI is its bare text, a blank node is ``_:label`` and a literal keeps
its N-Triples spelling (``"lexical"``, ``"lexical"@lang`` or ``"lexical"^^<datatype>``), so the
kind of a term can be read off its first characters without a lookup.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIPLE = ["s", "p", "o"]

# IRIs of the W3C vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"

TYPE = RDF + "type"
PROPERTY = RDF + "Property"
FIRST = RDF + "first"
REST = RDF + "rest"
NIL = RDF + "nil"

SUB_CLASS = RDFS + "subClassOf"
SUB_PROPERTY = RDFS + "subPropertyOf"
DOMAIN = RDFS + "domain"
RANGE = RDFS + "range"
RESOURCE = RDFS + "Resource"
RDFS_CLASS = RDFS + "Class"
MEMBER = RDFS + "member"
CONTAINER_PROPERTY = RDFS + "ContainerMembershipProperty"

CLASS = OWL + "Class"
THING = OWL + "Thing"
NOTHING = OWL + "Nothing"
RESTRICTION = OWL + "Restriction"
ON_PROPERTY = OWL + "onProperty"
ON_CLASS = OWL + "onClass"
HAS_VALUE = OWL + "hasValue"
SOME_VALUES = OWL + "someValuesFrom"
ALL_VALUES = OWL + "allValuesFrom"
CARDINALITY = OWL + "cardinality"
MIN_CARDINALITY = OWL + "minCardinality"
MAX_CARDINALITY = OWL + "maxCardinality"
MAX_QUALIFIED = OWL + "maxQualifiedCardinality"
INTERSECTION = OWL + "intersectionOf"
UNION = OWL + "unionOf"
COMPLEMENT = OWL + "complementOf"
ONE_OF = OWL + "oneOf"
EQUIVALENT_CLASS = OWL + "equivalentClass"
EQUIVALENT_PROPERTY = OWL + "equivalentProperty"
DISJOINT_CLASS = OWL + "disjointWith"
DISJOINT_PROPERTY = OWL + "propertyDisjointWith"
ALL_DISJOINT_PROPERTIES = OWL + "AllDisjointProperties"
MEMBERS = OWL + "members"
DISTINCT_MEMBERS = OWL + "distinctMembers"
INVERSE_OF = OWL + "inverseOf"
PROPERTY_CHAIN = OWL + "propertyChainAxiom"
SAME_AS = OWL + "sameAs"
DIFFERENT_FROM = OWL + "differentFrom"
OBJECT_PROPERTY = OWL + "ObjectProperty"
DATA_PROPERTY = OWL + "DatatypeProperty"
ANNOTATION_PROPERTY = OWL + "AnnotationProperty"
FUNCTIONAL = OWL + "FunctionalProperty"
INVERSE_FUNCTIONAL = OWL + "InverseFunctionalProperty"
SYMMETRIC = OWL + "SymmetricProperty"
ASYMMETRIC = OWL + "AsymmetricProperty"
REFLEXIVE = OWL + "ReflexiveProperty"
IRREFLEXIVE = OWL + "IrreflexiveProperty"
TRANSITIVE = OWL + "TransitiveProperty"


def iri(text: str) -> str:
    return text


def bnode(label: str) -> str:
    return "_:" + label


def literal(lexical: str, lang: str | None = None, datatype: str | None = None) -> str:
    """Spell a literal the way N-Triples does."""
    escapes = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    body = '"' + "".join(escapes.get(ch, ch) for ch in lexical) + '"'
    if lang is not None:
        return f"{body}@{lang}"
    if datatype is not None:
        return f"{body}^^<{datatype}>"
    return body


def integer_literals(n: int) -> list[str]:
    """The spellings under which a cardinality of ``n`` is met."""
    return [literal(str(n))] + [
        literal(str(n), datatype=XSD + t) for t in ("nonNegativeInteger", "integer", "int")
    ]


def as_literal(col: Column) -> Column:
    """A plain literal around a string column that needs no escapes."""
    return F.concat(F.lit('"'), col, F.lit('"'))


def is_literal(col: Column) -> Column:
    return col.startswith('"')


def is_bnode(col: Column) -> Column:
    return col.startswith("_:")


def is_iri(col: Column) -> Column:
    return ~is_literal(col) & ~is_bnode(col)


def datatype_of(col: Column) -> Column:
    """Datatype IRI of a literal; empty for other terms and for literals without one."""
    return F.when(is_literal(col), F.regexp_extract(col, r'"\^\^<([^>]*)>$', 1)).otherwise("")


def language_of(col: Column) -> Column:
    return F.when(is_literal(col), F.regexp_extract(col, r'"@([A-Za-z0-9-]+)$', 1)).otherwise("")


def lexical_of(col: Column) -> Column:
    """Text between the quotes of a literal, escapes kept; other terms unchanged."""
    return F.when(is_literal(col), F.regexp_extract(col, r'(?s)^"(.*)"', 1)).otherwise(col)


def ntriples_term(col: Column) -> Column:
    return F.when(is_iri(col), F.concat(F.lit("<"), col, F.lit(">"))).otherwise(col)


def ntriples_line(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws(" ", ntriples_term(s), ntriples_term(p), ntriples_term(o), F.lit("."))
