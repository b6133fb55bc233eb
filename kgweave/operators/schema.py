"""The terminology of a graph, closed once and turned into lookup tables.

Instance rules never walk a hierarchy step by step: the closed tables say directly which types and
properties follow from a predicate or a class, so each rule is one join of the instance triples
with a table that is broadcast when its counted rows are few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.functions import terms as t
from kgweave.functions.terms import TRIPLE, is_literal
from kgweave.operators.closure import close_into_table
from kgweave.plans.workspace import Stored, store, union_all

# Predicates whose meaning is built into the rules. A property placed below one of them changes
# the terminology while rules run, which a terminology closed in advance cannot follow.
BUILT_IN = [
    t.TYPE, t.SUB_CLASS, t.SUB_PROPERTY, t.DOMAIN, t.RANGE, t.EQUIVALENT_CLASS,
    t.EQUIVALENT_PROPERTY, t.INVERSE_OF, t.ON_PROPERTY, t.HAS_VALUE, t.SOME_VALUES, t.ALL_VALUES,
    t.SAME_AS, t.FIRST, t.REST,
]


def hierarchy_edges(schema: DataFrame, with_equivalence: bool) -> DataFrame:
    """``(g, s, o)`` with g naming the class or the property hierarchy."""
    p = F.col("p")
    down = schema.where(p.isin(t.SUB_CLASS, t.SUB_PROPERTY)).select(p.alias("g"), "s", "o")
    if not with_equivalence:
        return down.distinct()
    equal = schema.where(p.isin(t.EQUIVALENT_CLASS, t.EQUIVALENT_PROPERTY)).select(
        F.when(p == t.EQUIVALENT_CLASS, t.SUB_CLASS).otherwise(t.SUB_PROPERTY).alias("g"), "s", "o"
    )
    back = equal.select("g", F.col("o").alias("s"), F.col("s").alias("o"))
    return union_all([down, equal, back]).distinct()


SIGNED = "signed"


def turned_edges(schema: DataFrame, edges: DataFrame) -> DataFrame:
    """Property edges that may turn triples around, as rows of the group ``SIGNED``.

    A property is marked + for its triples as they are and - for them turned around; inverse and
    symmetric properties lead from one mark to the other.
    """
    inverse = schema.where(F.col("p") == t.INVERSE_OF).select("s", "o")
    symmetric = schema.where((F.col("p") == t.TYPE) & (F.col("o") == t.SYMMETRIC)).select(
        "s", F.col("s").alias("o")
    )
    turns = union_all([inverse, inverse.select(F.col("o").alias("s"), F.col("s").alias("o")), symmetric])
    down = edges.where(F.col("g") == t.SUB_PROPERTY)

    def marked(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.lit(SIGNED).alias("g"), F.concat(F.lit(a), "s").alias("s"),
                         F.concat(F.lit(b), "o").alias("o"))

    return union_all([marked(down, m, m) for m in "+-"] + [marked(turns, a, b) for a, b in ("+-", "-+")])


@dataclass(frozen=True)
class Hierarchy:
    """Closed rdfs:subClassOf and rdfs:subPropertyOf, and closed signed property edges."""

    rows: int
    table: DataFrame

    def pairs(self, group: str) -> Stored:
        df = self.table.where(F.col("g") == group).select("s", "o")
        return Stored(df, self.rows)

    @property
    def classes(self) -> Stored:
        return self.pairs(t.SUB_CLASS)

    @property
    def properties(self) -> Stored:
        return self.pairs(t.SUB_PROPERTY)

    def triples(self) -> DataFrame:
        return self.table.where(F.col("g") != SIGNED).select("s", F.col("g").alias("p"), "o")


def close_hierarchy(schema: DataFrame, with_equivalence: bool = False, keep_loops: bool = True,
                    with_turns: bool = False) -> Hierarchy:
    """Both hierarchies, and signed properties when asked for, closed in one loop."""
    edges = hierarchy_edges(schema, with_equivalence)
    if with_turns:
        edges = edges.union(turned_edges(schema, edges))
    closed = close_into_table(edges, ["g"])
    table = closed.known
    if not keep_loops:
        table = table.where((F.col("s") != F.col("o")) | (F.col("g") == SIGNED))
    return Hierarchy(closed.rows, table)


def property_reach(hierarchy: Hierarchy) -> DataFrame:
    """``(p, q, flip, literal_ok)``: a triple of p implies one of q, turned around when ``flip``.

    A literal cannot become a subject; ``literal_ok`` marks what follows without any turn.
    """
    straight = hierarchy.properties.df.where(F.col("s") != F.col("o")).select(
        F.col("s").alias("p"), F.col("o").alias("q"), F.lit(False).alias("flip"),
        F.lit(True).alias("literal_ok"),
    )
    signed = (
        hierarchy.pairs(SIGNED).df
        .where(F.col("s").startswith("+") & (F.col("s") != F.col("o")))
        .select(
            F.expr("substr(s, 2)").alias("p"), F.expr("substr(o, 2)").alias("q"),
            F.col("o").startswith("-").alias("flip"), F.lit(False).alias("literal_ok"),
        )
    )
    return straight.union(signed)


@dataclass(frozen=True)
class Effects:
    """What one instance triple implies by itself.

    ``by_property(p, action, target, literal_ok)``: action S gives the subject type ``target``, O
    the object, P adds the triple under the property ``target``, I adds it turned around.
    ``by_class(c, target)``: an instance of c is one of ``target``.
    """

    by_property: Stored
    by_class: Stored


def compile_effects(schema: DataFrame, hierarchy: Hierarchy) -> Effects:
    reach = property_reach(hierarchy)
    domain = schema.where(F.col("p") == t.DOMAIN).select(F.col("s").alias("q"), F.col("o").alias("c"))
    range_ = schema.where(F.col("p") == t.RANGE).select(F.col("s").alias("q"), F.col("o").alias("c"))

    own = union_all([
        domain.select(F.col("q").alias("p"), F.lit("S").alias("action"), "c", F.lit(True).alias("literal_ok")),
        range_.select(F.col("q").alias("p"), F.lit("O").alias("action"), "c", F.lit(False).alias("literal_ok")),
    ])
    through = union_all([
        reach.join(domain, "q").select(
            "p", F.when(F.col("flip"), "O").otherwise("S").alias("action"), "c", "literal_ok"),
        reach.join(range_, "q").select(
            "p", F.when(F.col("flip"), "S").otherwise("O").alias("action"), "c",
            (F.col("flip") & F.col("literal_ok")).alias("literal_ok")),
    ])
    typed = own.union(through)
    supers = hierarchy.classes.df.where(F.col("s") != F.col("o"))
    widened = typed.join(supers.select(F.col("s").alias("c"), F.col("o").alias("d")), "c").select(
        "p", "action", F.col("d").alias("c"), "literal_ok"
    )
    moves = reach.select(
        "p", F.when(F.col("flip"), "I").otherwise("P").alias("action"), F.col("q").alias("c"), "literal_ok"
    )
    by_property = (
        union_all([typed, widened, moves])
        .groupBy("p", "action", F.col("c").alias("target"))
        .agg(F.max("literal_ok").alias("literal_ok"))
    )
    by_class = supers.select(F.col("s").alias("c"), F.col("o").alias("target"))
    return Effects(store(by_property), Stored(by_class, hierarchy.rows))


def added_effects(now: Effects, before: Effects) -> Effects:
    """The effects in ``now`` that ``before`` lacks."""
    return Effects(*[store(a.df.join(b.df, a.df.columns, "left_anti")) for a, b in (
        (now.by_property, before.by_property), (now.by_class, before.by_class))])


def apply_effects(rows: DataFrame, effects: Effects) -> DataFrame:
    """Triples that follow from each of ``rows`` alone."""
    return apply_property_effects(rows, effects).union(apply_class_effects(rows, effects))


def apply_property_effects(rows: DataFrame, effects: Effects) -> DataFrame:
    action = F.col("action")
    joined = rows.join(effects.by_property.side(), "p").where(
        F.col("literal_ok") | ~is_literal(F.col("o"))
    )
    return joined.select(
        F.when(action.isin("S", "P"), F.col("s")).otherwise(F.col("o")).alias("s"),
        F.when(action.isin("S", "O"), t.TYPE).otherwise(F.col("target")).alias("p"),
        F.when(action == "P", F.col("o")).when(action == "I", F.col("s"))
        .otherwise(F.col("target")).alias("o"),
    )


def apply_class_effects(rows: DataFrame, effects: Effects) -> DataFrame:
    return (
        rows.where(F.col("p") == t.TYPE)
        .join(effects.by_class.side().withColumnRenamed("c", "o"), "o")
        .select("s", "p", F.col("target").alias("o"))
    )


def changes_terminology(hierarchy: Hierarchy) -> bool:
    """Whether some property lies below a built-in one."""
    return not hierarchy.properties.df.where(F.col("o").isin(BUILT_IN)).isEmpty()


def schema_index(graph: DataFrame) -> dict[str, DataFrame]:
    """``{predicate: (s, o)}`` of the RDFS schema, both hierarchies closed."""
    schema = store(graph.where(F.col("p").isin(t.SUB_CLASS, t.SUB_PROPERTY, t.DOMAIN, t.RANGE)).select(*TRIPLE))
    hierarchy = close_hierarchy(schema.df)

    def asserted(predicate: str) -> DataFrame:
        return schema.df.where(F.col("p") == predicate).select("s", "o").distinct()

    return {
        t.SUB_CLASS: hierarchy.classes.df,
        t.SUB_PROPERTY: hierarchy.properties.df,
        t.DOMAIN: asserted(t.DOMAIN),
        t.RANGE: asserted(t.RANGE),
    }
