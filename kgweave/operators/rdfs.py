"""RDFS entailment: single rules and whole-graph materialization at three levels.

SIMPLE holds rules 2, 3, 5, 7, 9 and 11. DEFAULT adds one application of 4a/b, 6, 8, 10 and 12.
FULL adds rdf1 and the axiomatic triples and runs everything until nothing is new.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.functions import terms as t
from kgweave.functions.terms import TRIPLE, is_literal
from kgweave.operators.closure import closure_of_predicate
from kgweave.operators.graph import RDFS_SCHEMA
from kgweave.operators.schema import (
    Effects, Hierarchy, added_effects, apply_effects, changes_terminology, close_hierarchy, compile_effects,
)
from kgweave.plans.workspace import BROADCAST_ROWS, FactTable, run_to_fixpoint, spread, store, union_all
from kgweave.sources.inline import triples


class Level(Enum):
    SIMPLE = "simple"
    DEFAULT = "default"
    FULL = "full"


def _schema_side(graph: DataFrame, predicate: str):
    return store(graph.where(F.col("p") == predicate).select("s", "o").distinct())


# --- single rules, one application each ---------------------------------------------------------

def rdfs2(graph: DataFrame) -> DataFrame:
    """The subject of a property is in each of the property's domains."""
    domain = _schema_side(graph, t.DOMAIN)
    side = domain.side(domain.df.select(F.col("s").alias("p"), F.col("o").alias("c")))
    return graph.join(side, "p").select("s", F.lit(t.TYPE).alias("p"), F.col("c").alias("o")).distinct()


def rdfs3(graph: DataFrame) -> DataFrame:
    """The non-literal value of a property is in each of the property's ranges."""
    range_ = _schema_side(graph, t.RANGE)
    side = range_.side(range_.df.select(F.col("s").alias("p"), F.col("o").alias("c")))
    return (
        graph.where(~is_literal(F.col("o"))).join(side, "p")
        .select(F.col("o").alias("s"), F.lit(t.TYPE).alias("p"), F.col("c").alias("o")).distinct()
    )


def rdfs5(graph: DataFrame) -> DataFrame:
    return closure_of_predicate(graph, t.SUB_PROPERTY)


def rdfs7(graph: DataFrame) -> DataFrame:
    """A triple holds for every property above its own."""
    hierarchy = close_hierarchy(graph.where(F.col("p").isin(t.SUB_PROPERTY))).properties
    above = hierarchy.df.where(F.col("s") != F.col("o"))
    side = hierarchy.side(above.select(F.col("s").alias("p"), F.col("o").alias("q")))
    return graph.join(side, "p").select("s", F.col("q").alias("p"), "o").distinct()


def rdfs9(graph: DataFrame) -> DataFrame:
    """An instance of a class is one of every class above."""
    hierarchy = close_hierarchy(graph.where(F.col("p").isin(t.SUB_CLASS))).classes
    side = hierarchy.side(hierarchy.df.select(F.col("s").alias("c"), F.col("o").alias("d")))
    types = graph.where(F.col("p") == t.TYPE).select("s", "p", F.col("o").alias("c"))
    return types.join(side, "c").select("s", "p", F.col("d").alias("o")).distinct()


def rdfs11(graph: DataFrame) -> DataFrame:
    return closure_of_predicate(graph, t.SUB_CLASS)


def rdfs4(graph: DataFrame) -> DataFrame:
    """Every subject and every non-literal object is a resource."""
    nodes = graph.select(F.explode(F.array("s", "o")).alias("s")).where(~is_literal(F.col("s")))
    return nodes.distinct().select("s", F.lit(t.TYPE).alias("p"), F.lit(t.RESOURCE).alias("o"))


def rdf1(graph: DataFrame) -> DataFrame:
    """Every predicate is a property."""
    return graph.select(F.col("p").alias("s")).distinct().select(
        "s", F.lit(t.TYPE).alias("p"), F.lit(t.PROPERTY).alias("o")
    )


def _instances(graph: DataFrame, cls: str) -> DataFrame:
    return graph.where((F.col("p") == t.TYPE) & (F.col("o") == cls)).select("s").distinct()


def rdfs6(graph: DataFrame) -> DataFrame:
    return _instances(graph, t.PROPERTY).select(
        "s", F.lit(t.SUB_PROPERTY).alias("p"), F.col("s").alias("o"))


def rdfs8(graph: DataFrame) -> DataFrame:
    return _instances(graph, t.RDFS_CLASS).select(
        "s", F.lit(t.SUB_CLASS).alias("p"), F.lit(t.RESOURCE).alias("o"))


def rdfs10(graph: DataFrame) -> DataFrame:
    return _instances(graph, t.RDFS_CLASS).select(
        "s", F.lit(t.SUB_CLASS).alias("p"), F.col("s").alias("o"))


def rdfs12(graph: DataFrame) -> DataFrame:
    return _instances(graph, t.CONTAINER_PROPERTY).select(
        "s", F.lit(t.SUB_PROPERTY).alias("p"), F.lit(t.MEMBER).alias("o"))


# The axiomatic triples of RDFS, without the open-ended container properties.
AXIOMS = """
rdf:type rdfs:range rdfs:Class
rdfs:Resource rdf:type rdfs:Class
rdfs:Literal rdf:type rdfs:Class
rdf:Statement rdf:type rdfs:Class
rdf:nil rdf:type rdf:List
rdf:subject rdf:type rdf:Property
rdf:object rdf:type rdf:Property
rdf:predicate rdf:type rdf:Property
rdf:first rdf:type rdf:Property
rdf:rest rdf:type rdf:Property
rdfs:subPropertyOf rdfs:domain rdf:Property
rdfs:subClassOf rdfs:domain rdfs:Class
rdfs:domain rdfs:domain rdf:Property
rdfs:range rdfs:domain rdf:Property
rdf:subject rdfs:domain rdf:Statement
rdf:predicate rdfs:domain rdf:Statement
rdf:object rdfs:domain rdf:Statement
rdf:first rdfs:domain rdf:List
rdf:rest rdfs:domain rdf:List
rdfs:subPropertyOf rdfs:range rdf:Property
rdfs:subClassOf rdfs:range rdfs:Class
rdfs:domain rdfs:range rdfs:Class
rdfs:range rdfs:range rdfs:Class
rdfs:comment rdfs:range rdfs:Literal
rdfs:label rdfs:range rdfs:Literal
rdf:rest rdfs:range rdf:List
rdf:Alt rdfs:subClassOf rdfs:Container
rdf:Bag rdfs:subClassOf rdfs:Container
rdf:Seq rdfs:subClassOf rdfs:Container
rdfs:ContainerMembershipProperty rdfs:subClassOf rdf:Property
rdfs:isDefinedBy rdfs:subPropertyOf rdfs:seeAlso
rdf:XMLLiteral rdf:type rdfs:Datatype
rdfs:Datatype rdfs:subClassOf rdfs:Class
"""


def axiom_rows() -> list[tuple[str, str, str]]:
    spaces = {"rdf": t.RDF, "rdfs": t.RDFS}

    def full(name: str) -> str:
        prefix, local = name.split(":")
        return spaces[prefix] + local

    return [tuple(full(n) for n in line.split()) for line in AXIOMS.split("\n") if line]


def rdfs_axiomatic_triples(spark: SparkSession) -> DataFrame:
    return triples(spark, axiom_rows())


# --- whole graph ----------------------------------------------------------------------------------

def _rdfs_schema(graph: DataFrame) -> DataFrame:
    return store(graph.where(F.col("p").isin(RDFS_SCHEMA)).select(*TRIPLE).distinct()).df


def materialize_rdfs(graph: DataFrame, level: Level = Level.DEFAULT, only_new: bool = False) -> DataFrame:
    """The graph plus its RDFS entailments, or with ``only_new`` what the graph itself lacks.

    At SIMPLE and DEFAULT the closed terminology makes one pass over the instance triples enough.
    A terminology that its own instances can extend, say by a property below rdf:type, goes through
    the loop of FULL instead.
    """
    graph = graph.select(*TRIPLE)
    if level is Level.FULL:
        axioms = rdfs_axiomatic_triples(graph.sparkSession)
        return _lacking(_rounds(graph.union(axioms), with_extras=True), graph, only_new)
    schema = _rdfs_schema(graph)
    hierarchy = close_hierarchy(schema)
    if not changes_terminology(hierarchy):
        return _one_pass(graph, compile_effects(schema, hierarchy), hierarchy, level is Level.DEFAULT, only_new)
    simple = _rounds(graph, with_extras=False)
    if level is Level.SIMPLE:
        return _lacking(simple.distinct(), graph, only_new)
    # Rules 2 to 11 bring in no node that the input lacks, so rule 4 can read the input alone.
    extras = [rdfs4(graph)] + [rule(simple) for rule in (rdfs6, rdfs8, rdfs10, rdfs12)]
    return _lacking(union_all([simple, *extras]).distinct(), graph, only_new)


def _lacking(rows: DataFrame, graph: DataFrame, only_new: bool) -> DataFrame:
    return rows.join(graph, TRIPLE, "left_anti") if only_new else rows


def _once(rows: DataFrame, keys: list[str], item: str, entry: str, only_new: bool) -> DataFrame:
    """Distinct ``(*keys, entry)``; with ``only_new``, ``item`` is a struct that says besides whether a row is given."""
    if not only_new:
        return rows.select(*keys, F.col(item).alias(entry)).distinct()
    return rows.select(*keys, F.col(item)["value"].alias(entry), F.col(item)["given"].alias("given")).groupBy(
        *keys, entry).agg(F.max("given").alias("given")).where("NOT given").drop("given")


def _one_pass(graph: DataFrame, effects: Effects, hierarchy: Hierarchy, with_extras: bool, only_new: bool = False) -> DataFrame:
    """What follows from each triple alone, with duplicates removed: type triples and all others apart.

    Types are shuffled as the reasons for them, ``(node, via, value)``: a class stated (T), a property whose subject (S)
    or object (O) the node is, or no reason but being a node (N). They become classes where a node's reasons meet.
    Other triples take on the properties above their own after the shuffle, too.
    """
    side = effects.by_property
    is_type = F.col("p").eqNullSafe(t.TYPE)
    uses = side.df.groupBy("p").agg(*[F.max(F.col("action") == a).alias(name) for name, a in (("to_s", "S"), ("to_o", "O"))])
    seen = graph.join(side.side(uses), "p", "left").withColumns({
        name: F.coalesce(name, F.lit(False)) for name in ("to_s", "to_o")})

    def reason(when, node: str, via: str, value):
        return F.when(when, F.struct(F.col(node).alias("node"), F.lit(via).alias("via"), value.alias("value")))

    named = F.col("o").isNotNull() & ~is_literal(F.col("o"))
    of_subject = [reason(is_type, "s", "T", F.col("o")), reason(F.col("to_s"), "s", "S", F.col("p"))]
    of_object = [reason(F.col("to_o") & named, "o", "O", F.col("p"))]
    if with_extras:
        of_subject.append(reason(~is_type & ~F.col("to_s"), "s", "N", F.lit("")))
        of_object.append(reason(~F.col("to_o") & named, "o", "N", F.lit("")))
    subjects, objects = [
        seen.select(F.explode(F.array_compact(F.array(*reasons))).alias("e")).select("e.*") for reasons in (of_subject, of_object)]
    # An object may be frequent: its reasons are combined before they are dealt by node.
    rows = graph.count()
    reasons = spread(subjects.union(objects.distinct()), ["node"], rows)
    gives = union_all([
        effects.by_class.df.select(F.lit("T").alias("via"), F.col("c").alias("value"), "target"),
        side.df.where(F.col("action").isin("S", "O")).select(F.col("action").alias("via"), F.col("p").alias("value"), "target")])
    if effects.by_class.rows + side.rows <= BROADCAST_ROWS:
        gives = F.broadcast(gives)

    def entry(value, given):
        return F.struct(value.alias("value"), given.alias("given")) if only_new else value

    none = F.array().cast("array<struct<value:string,given:boolean>>" if only_new else "array<string>")
    classes = [F.when(F.col("via") == "T", F.array(entry(F.col("value"), F.lit(True)))).otherwise(none),
               F.when(F.col("target").isNotNull(), F.array(entry(F.col("target"), F.lit(False)))).otherwise(none)]
    if with_extras:
        classes.append(F.when(~is_literal(F.col("node")), F.array(entry(F.lit(t.RESOURCE), F.lit(False)))).otherwise(none))
    types = _once(reasons.join(gives, ["via", "value"], "left").select("node", F.explode(F.concat(*classes)).alias("x")),
                  ["node"], "x", "o", only_new)

    moves = side.df.where(F.col("action") == "P").select("p", "target")
    added = [hierarchy.triples(), graph.where(is_type).join(side.side(moves.where(F.col("p") == t.TYPE)), "p").select(
        "s", F.col("target").alias("p"), "o")]
    if with_extras:
        simple = union_all([graph, apply_effects(graph, effects), hierarchy.triples()])
        added += [rule(simple) for rule in (rdfs6, rdfs8, rdfs10, rdfs12)]
    links = graph.where(~is_type).withColumn("given", F.lit(True)).unionByName(
        union_all(added).select(*TRIPLE, F.lit(False).alias("given")))
    own, target = entry(F.col("p"), F.col("given")), entry(F.col("target"), F.lit(False))
    above = F.when(F.col("given") & F.col("target").isNotNull(), F.array(own, target)).otherwise(F.array(own))
    others = _once(spread(links, ["s", "o"], rows).join(side.side(moves), "p", "left").select("s", "o", F.explode(above).alias("x")),
                   ["s", "o"], "x", "p", only_new)
    return others.select(*TRIPLE).union(types.select(F.col("node").alias("s"), F.lit(t.TYPE).alias("p"), "o"))


# Classes and properties that the rules name by themselves.
_NAMED = [t.RESOURCE, t.PROPERTY, t.MEMBER]


def _new_nodes(delta: DataFrame) -> DataFrame:
    """Of derived triples those that may hold a node unlike any before: a predicate as subject, or a named term."""
    return delta.where(((F.col("p") == t.TYPE) & (F.col("o") == t.PROPERTY)) | F.col("p").isin(RDFS_SCHEMA)).select(*TRIPLE).union(
        delta.where(F.col("o").isin(_NAMED)).select(F.col("o").alias("s"), "p", "o").distinct())


def _rounds(graph: DataFrame, with_extras: bool) -> DataFrame:
    table = FactTable(graph.sparkSession, TRIPLE, large=True)
    table.append(graph)
    state = {}

    def step(facts: FactTable) -> DataFrame:
        known, delta = facts.known, facts.delta
        parts = []
        if facts.first_round or not delta.where(F.col("p").isin(RDFS_SCHEMA)).isEmpty():
            schema = _rdfs_schema(known)
            hierarchy = close_hierarchy(schema)
            before, state["effects"] = state.get("effects"), compile_effects(schema, hierarchy)
            parts.append(hierarchy.triples())
            if before is not None:
                # New schema triples may concern any known triple, but only through the effects they bring.
                parts.append(apply_effects(known, added_effects(state["effects"], before)))
        parts.append(apply_effects(delta, state["effects"]))
        if with_extras:
            nodes = delta if facts.first_round else _new_nodes(delta)
            parts += [rdfs4(nodes)] + [rule(delta) for rule in (rdf1, rdfs6, rdfs8, rdfs10, rdfs12)]
        return union_all(parts)

    return run_to_fixpoint(table, step).known
