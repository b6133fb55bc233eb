"""OWL Horst (pD*) entailment.

The terminology is closed and compiled first. The loop then applies, to last round's triples only,
the rules that one instance triple triggers (a lookup each) and the rules that need two of them
(existential and universal restrictions, transitive properties). owl:sameAs takes part in no other
rule of this profile, so equal nodes are found once, after the loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.functions import terms as t
from kgweave.functions.terms import TRIPLE, is_literal
from kgweave.operators.closure import compose
from kgweave.operators.components import connected_components, star_triples, value_groups
from kgweave.operators.graph import HORST_SCHEMA_PREDICATES
from kgweave.operators.schema import (
    Effects, Hierarchy, apply_class_effects, apply_property_effects, close_hierarchy,
    compile_effects,
)
from kgweave.plans.triples import TripleTable
from kgweave.plans.workspace import BROADCAST_ROWS, Stored, run_to_fixpoint, store, union_all

# Properties that a kind of rule asks for are literals in the scan up to this number.
PUSHED = 200

SCHEMA_PREDICATES = HORST_SCHEMA_PREDICATES + [
    t.ON_CLASS, t.MAX_CARDINALITY, t.MAX_QUALIFIED, t.ONE_OF,
]
SCHEMA_TYPES = [
    t.TRANSITIVE, t.FUNCTIONAL, t.INVERSE_FUNCTIONAL, t.SYMMETRIC, t.OBJECT_PROPERTY,
    t.DATA_PROPERTY,
]


def is_schema():
    return F.col("p").isin(SCHEMA_PREDICATES) | (
        (F.col("p") == t.TYPE) & F.col("o").isin(SCHEMA_TYPES)
    )


@dataclass(frozen=True)
class Terminology:
    """Closed hierarchies, lookup tables and restrictions of a graph."""

    schema: Stored
    hierarchy: Hierarchy
    effects: Effects
    has_value: Stored       # (r, p, d)
    some_values: Stored     # (r, p, d)
    all_values: Stored      # (r, p, d)
    transitive: Stored      # (p)
    functional: Stored      # (p)
    inverse_functional: Stored  # (p)
    asked: dict[str, list[str] | None]  # kind of rule -> the properties it asks for; None if too many to list
    closed: bool   # the effects' own output has no further effects
    extends: bool  # effects may add to the terminology


def restrictions(schema: DataFrame, predicate: str) -> DataFrame:
    """``(r, p, d)``: restriction node, its property and the value of ``predicate``."""
    filler = schema.where(F.col("p") == predicate).select(F.col("s").alias("r"), F.col("o").alias("d"))
    on = schema.where(F.col("p") == t.ON_PROPERTY).select(F.col("s").alias("r"), F.col("o").alias("p"))
    return filler.join(on, "r").select("r", "p", "d").distinct()


def properties_of_kind(schema: DataFrame, cls: str) -> DataFrame:
    return schema.where((F.col("p") == t.TYPE) & (F.col("o") == cls)).select(F.col("s").alias("p")).distinct()


def read_terminology(graph: DataFrame, some_values=None) -> Terminology:
    """``some_values`` may narrow which existential restrictions apply."""
    schema = store(graph.where(is_schema()).select(*TRIPLE).distinct())
    hierarchy = close_hierarchy(schema.df, with_equivalence=True, keep_loops=False, with_turns=True)
    effects = compile_effects(schema.df, hierarchy)
    fillers = {t.HAS_VALUE: restrictions(schema.df, t.HAS_VALUE),
               t.SOME_VALUES: restrictions(schema.df, t.SOME_VALUES),
               t.ALL_VALUES: restrictions(schema.df, t.ALL_VALUES)}
    if some_values is not None:
        fillers[t.SOME_VALUES] = some_values(fillers[t.SOME_VALUES], schema.df)
    described = store(union_all([
        df.select(F.lit(kind).alias("kind"), "r", "p", "d") for kind, df in fillers.items()]))
    characteristics = schema.df.where(F.col("p") == t.TYPE).select(F.col("o").alias("kind"), F.col("s").alias("p"))
    # Rows per kind of restriction and of property; no longer than the fixed lists above.
    kinds = {
        row.kind: row.n
        for row in described.df.select("kind").union(characteristics.select("kind"))
        .groupBy("kind").agg(F.count("*").alias("n")).collect()
    }

    used = described.df.select("kind", "p").union(characteristics.where(F.col("kind").isin(SCHEMA_TYPES))).distinct()
    listed = used.limit(PUSHED + 1).collect()
    asked = None if len(listed) > PUSHED else {}
    for row in listed if asked is not None else []:
        asked.setdefault(row.kind, []).append(row.p)

    def part(df: DataFrame, kind: str, *columns: str) -> Stored:
        return Stored(df.where(F.col("kind") == kind).select(*columns), kinds.get(kind, 0))

    return Terminology(
        schema, hierarchy, effects,
        *[part(described.df, kind, "r", "p", "d") for kind in fillers],
        *[part(characteristics, kind, "p") for kind in (t.TRANSITIVE, t.FUNCTIONAL, t.INVERSE_FUNCTIONAL)],
        {kind: None if asked is None else asked.get(kind, []) for kind in
         (*fillers, t.TRANSITIVE, t.FUNCTIONAL, t.INVERSE_FUNCTIONAL)},
        *_reach_of_effects(effects),
    )


def _reach_of_effects(effects: Effects) -> tuple[bool, bool]:
    """Whether the effects are closed, and whether they may add to the terminology.

    They are not closed where a property lies below rdf:type or rdf:type itself has effects: what
    instances of a class are is a table of its own.
    """
    moved = F.col("action").isin("P", "I")
    found = effects.by_property.df.agg(
        F.count_if((F.col("p") == t.TYPE) | (moved & (F.col("target") == t.TYPE))).alias("open"),
        F.count_if(F.when(moved, F.col("target").isin(SCHEMA_PREDICATES + [t.TYPE])).otherwise(
            F.col("target").isin(SCHEMA_TYPES))).alias("schema")).first()
    classes = effects.by_class.df.where(F.col("target").isin(SCHEMA_TYPES))
    return found.open == 0, found.schema > 0 or not classes.isEmpty()


def new_schema(facts: TripleTable, terms: Terminology) -> bool:
    """Whether the last round has added to the terminology; after the first one, to what ``terms`` were read from."""
    watched = SCHEMA_PREDICATES + [t.TYPE]
    if facts.first_round:
        return terms.extends and facts.asked(watched).where(is_schema()).count() > terms.schema.rows
    return facts.has_new(watched) and not facts.asked(watched, new=True).where(is_schema()).isEmpty()


# --- rules ----------------------------------------------------------------------------------------

def types_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("p") == t.TYPE)


def has_value_types(rows: DataFrame, has_value: Stored) -> DataFrame:
    """rdfp14a: who has the value is in the restriction."""
    side = has_value.side(has_value.df.select("p", F.col("d").alias("o"), "r"))
    return rows.join(side, ["p", "o"]).select("s", F.lit(t.TYPE).alias("p"), F.col("r").alias("o"))


def has_value_triples(rows: DataFrame, has_value: Stored) -> DataFrame:
    """rdfp14b: who is in the restriction has the value."""
    side = has_value.side(has_value.df.select(F.col("r").alias("o"), F.col("p").alias("q"), "d"))
    return types_of(rows).join(side, "o").select("s", F.col("q").alias("p"), F.col("d").alias("o"))


def _as_is(df: DataFrame, fan_out: int = 1) -> DataFrame:
    return df


def some_values_types(links: DataFrame, members: DataFrame, some_values: Stored,
                      links_side=_as_is, members_side=_as_is) -> DataFrame:
    """rdfp15: who has a value of the class is in the restriction.

    The ``_side`` functions say how rows made from either input enter the join.
    """
    wanted = some_values.side(some_values.df.select("p", "d", "r"))
    asking = links.join(wanted, "p").select("s", F.col("o").alias("a"), "d", "r")
    fillers = some_values.side(some_values.df.select(F.col("d").alias("o")).distinct())
    found = types_of(members).join(fillers, "o", "left_semi").select(
        F.col("s").alias("a"), F.col("o").alias("d"))
    return links_side(asking, some_values.rows).join(members_side(found), ["a", "d"]).select("s", F.lit(t.TYPE).alias("p"), F.col("r").alias("o"))


def all_values_types(links: DataFrame, members: DataFrame, all_values: Stored,
                     links_side=_as_is, members_side=_as_is) -> DataFrame:
    """rdfp16: every value of a restriction's member is in the class."""
    wanted = all_values.side(all_values.df.select("p", "d", "r"))
    asking = links.where(~is_literal(F.col("o"))).join(wanted, "p").select("s", "o", "d", "r")
    owners = all_values.side(all_values.df.select(F.col("r").alias("o")).distinct())
    found = types_of(members).join(owners, "o", "left_semi").select("s", F.col("o").alias("r"))
    return links_side(asking, all_values.rows).join(members_side(found), ["s", "r"]).select(
        F.col("o").alias("s"), F.lit(t.TYPE).alias("p"), F.col("d").alias("o"))


def transitive_triples(first: DataFrame, second: DataFrame, transitive: Stored,
                       first_side=_as_is, second_side=_as_is, rows: int = 0) -> DataFrame:
    """rdfp4, every property on its own. ``rows`` as in ``compose``."""
    side = transitive.side()
    return compose(
        first_side(first.join(side, "p", "left_semi")),
        second_side(second.join(side, "p", "left_semi")), ["p"], rows,
    ).select(*TRIPLE)


def symmetric_triples(graph: DataFrame) -> DataFrame:
    """rdfp3."""
    symmetric = store(properties_of_kind(graph, t.SYMMETRIC))
    return (
        graph.where(~is_literal(F.col("o"))).join(symmetric.side(), "p", "left_semi")
        .select(F.col("o").alias("s"), "p", F.col("s").alias("o")).distinct()
    )


def inverse_triples(graph: DataFrame) -> DataFrame:
    """rdfp8a and 8b."""
    pairs = graph.where(F.col("p") == t.INVERSE_OF).select(F.col("s").alias("p"), F.col("o").alias("q"))
    both = store(pairs.union(pairs.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct())
    return (
        graph.where(~is_literal(F.col("o"))).join(both.side(), "p")
        .select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o")).distinct()
    )


def functional_pairs(graph: DataFrame, functional: Stored) -> DataFrame:
    """rdfp1: values of a functional property, tied to the least value of their subject."""
    rows = graph.join(functional.side(), "p", "left_semi").where(~is_literal(F.col("o")))
    return value_groups(rows, ["p", "s"], "o")


def inverse_functional_pairs(graph: DataFrame, inverse_functional: Stored) -> DataFrame:
    """rdfp2: subjects with the same value, tied to the least of them."""
    rows = graph.join(inverse_functional.side(), "p", "left_semi")
    return value_groups(rows, ["p", "o"], "s")


def equivalences(hierarchy: Hierarchy) -> DataFrame:
    """rdfp12c and 13c: what lies below each other is equivalent."""
    table = hierarchy.table.where(F.col("g").isin(t.SUB_CLASS, t.SUB_PROPERTY))
    back = table.select("g", F.col("s").alias("o"), F.col("o").alias("s"))
    mutual = table.join(back, ["g", "s", "o"], "left_semi")
    return mutual.select(
        "s",
        F.when(F.col("g") == t.SUB_CLASS, t.EQUIVALENT_CLASS).otherwise(t.EQUIVALENT_PROPERTY).alias("p"),
        "o",
    )


def same_as_pairs(facts: TripleTable, terms: Terminology) -> DataFrame:
    """Given and derived sameAs edges ``(s, o)``."""
    parts = [facts.asked([t.SAME_AS]).select("s", "o")]
    if not terms.functional.empty:
        parts.append(functional_pairs(facts.asked(terms.asked[t.FUNCTIONAL]), terms.functional))
    if not terms.inverse_functional.empty:
        parts.append(inverse_functional_pairs(facts.asked(terms.asked[t.INVERSE_FUNCTIONAL]), terms.inverse_functional))
    return union_all(parts)


def reflexive_same_as(graph: DataFrame) -> DataFrame:
    """rdfp5a and 5b: every non-literal node equals itself."""
    nodes = graph.select(F.explode(F.array("s", "o")).alias("s")).where(~is_literal(F.col("s")))
    return nodes.distinct().select("s", F.lit(t.SAME_AS).alias("p"), F.col("s").alias("o"))


def _pairings(facts: TripleTable, first: list[str] | None, second: list[str] | None) -> list[tuple]:
    """The inputs of a rule over two triples, of which the new one may be either, and how they enter a join."""
    if facts.first_round:
        return [(facts.asked(first), facts.asked(second), _as_is, _as_is)]
    found = []
    if facts.has_new(first):
        found.append((facts.asked(first, new=True), facts.asked(second), facts.delta_side, _as_is))
    if facts.has_new(second):
        found.append((facts.asked(first), facts.asked(second, new=True), _as_is, facts.delta_side))
    return found


def with_effects(rows: DataFrame, terms: Terminology) -> DataFrame:
    """The rows and what each of them implies by itself.

    The lookup tables are closed, so applying them to their own output again yields nothing, unless
    ``terms.closed`` is false.
    """
    return union_all([rows, *effects_of(rows, terms)])


def effects_of(rows: DataFrame, terms: Terminology) -> list[DataFrame]:
    parts = []
    if not terms.effects.by_property.empty:
        parts.append(apply_property_effects(rows, terms.effects))
    if not terms.effects.by_class.empty:
        parts.append(apply_class_effects(rows, terms.effects))
    return parts


def instance_step(facts: TripleTable, terms: Terminology) -> list[DataFrame]:
    """What follows from the last round's triples by the rules that ``with_effects`` leaves.

    Each rule reads the triples of the properties it asks for, and takes no part where none is new.
    """
    types, parts = [t.TYPE], []
    if not terms.has_value.empty:
        valued = terms.asked[t.HAS_VALUE]
        if facts.has_new(types):
            parts.append(has_value_triples(facts.asked(types, new=True), terms.has_value))
        if facts.has_new(valued):
            parts.append(has_value_types(facts.asked(valued, new=True), terms.has_value))
    for rule, restricted, kind in ((some_values_types, terms.some_values, t.SOME_VALUES),
                                   (all_values_types, terms.all_values, t.ALL_VALUES)):
        if not restricted.empty:
            parts += [rule(*pairing[:2], restricted, *pairing[2:])
                      for pairing in _pairings(facts, terms.asked[kind], types)]
    if not terms.transitive.empty:
        chained = terms.asked[t.TRANSITIVE]
        rows = facts.rows if facts.delta_rows > BROADCAST_ROWS else 0
        parts += [transitive_triples(*pairing[:2], terms.transitive, *pairing[2:], rows)
                  for pairing in _pairings(facts, chained, chained)]
    return parts


def candidates(parts: list[DataFrame], facts: TripleTable, terms: Terminology) -> DataFrame | None:
    """The derived triples with their effects, the joins behind them being run once.

    Where effects are not closed, those of the last round's triples are taken again.
    """
    found = [with_effects(facts.passing(store(union_all(parts).distinct())).df, terms)] if parts else []
    if not terms.closed:
        found.append(with_effects(facts.delta, terms))
    return union_all(found) if found else None


def schema_entailments(terms: Terminology) -> DataFrame:
    return terms.hierarchy.triples().union(equivalences(terms.hierarchy))


def materialize_owl_horst(graph: DataFrame, reflexive: bool = False,
                          max_rounds: int | None = None, only_new: bool = False) -> DataFrame:
    """The graph plus its OWL Horst entailments, or with ``only_new`` what the graph itself lacks.

    Equal nodes are given as stars, each member with its group's least term both ways;
    ``same_as_partners`` lists the partners of chosen nodes. ``reflexive`` adds rdfp5a/b. When
    derived triples extend the terminology itself, it is read again and the loop goes on.
    """
    graph = graph.select(*TRIPLE)
    terms = read_terminology(graph)
    facts = TripleTable(graph.sparkSession)
    facts.begin(graph, effects_of(graph, terms))
    state = {"terms": terms}

    def step(table: TripleTable) -> DataFrame | None:
        if new_schema(table, state["terms"]):
            state["terms"] = terms = read_terminology(table.asked(SCHEMA_PREDICATES + [t.TYPE]))
            found = candidates(instance_step(AllNew(table), terms) + [schema_entailments(terms)], table, terms)
            return found.union(with_effects(table.known, terms))
        return candidates(instance_step(table, state["terms"]), table, state["terms"])

    run_to_fixpoint(facts, step, max_rounds)
    terms = state["terms"]
    last = [schema_entailments(terms),
            star_triples(connected_components(same_as_pairs(facts, terms)))]
    if reflexive:
        last.append(reflexive_same_as(facts.known))
    facts.append(union_all(last))
    return facts.derived if only_new else facts.known


class AllNew:
    """A fact table seen as if all of its rows were new."""

    delta_side = staticmethod(_as_is)

    first_round = True

    def __init__(self, table: TripleTable):
        self.table = table
        self.rows = self.delta_rows = table.rows
        self.delta = table.known
        self.known = table.known

    def asked(self, predicates: list[str] | None, new: bool = False) -> DataFrame:
        return self.table.asked(predicates)

    def has_new(self, predicates: list[str] | None) -> bool:
        return True
