"""Goal-directed RDFS: answers to one triple pattern without materializing the graph.

The goal is turned around against the closed terminology into the asserted triples that could prove
it, which one filtered scan then reads; the pattern's constants reach that scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions import terms as t
from kgweave.functions.terms import TRIPLE, is_literal
from kgweave.operators.graph import RDFS_SCHEMA, find, is_variable, pattern_filter
from kgweave.operators.schema import (
    close_hierarchy, compile_effects,
)
from kgweave.plans.workspace import Stored, store, union_all


def _matches(**terms: str | None) -> Column:
    condition = F.lit(True)
    for name, term in terms.items():
        if term is not None:
            condition = condition & (F.col(name) == term)
    return condition


PUSHED = 1_000  # predicates that a scan is asked for by name


class GoalReasoner:
    """Answers patterns over a graph; the terminology is read and closed once.

    Triples of a property below ``rdf:type`` or a schema property are terminology or types themselves.
    They are added until the terminology no longer grows, and only these: the graph stays as it is.
    """

    def __init__(self, graph: DataFrame):
        self.graph = graph.select(*TRIPLE)
        self.facts = self.graph
        self.schema = store(self.graph.where(F.col("p").isin(RDFS_SCHEMA)).distinct())
        while True:
            self.hierarchy = close_hierarchy(self.schema.df)
            self.effects = compile_effects(self.schema.df, self.hierarchy)
            lifts = self._narrowed(self.effects.by_property, (F.col("action") == "P") & F.col("target").isin(
                t.TYPE, *RDFS_SCHEMA))
            if lifts.df.isEmpty():
                break
            lifted = self._of(lifts, self.graph).join(lifts.side(lifts.df.select("p", "target")), "p").select(
                "s", F.col("target").alias("p"), "o")
            grown = store(self.schema.df.union(lifted.where(F.col("p") != t.TYPE)).distinct())
            self.facts = self.graph.union(lifted)
            if grown.rows == self.schema.rows:
                break
            self.schema = grown

    def _of(self, effects: Stored, rows: DataFrame) -> DataFrame:
        """The rows whose predicate has one of the effects; few predicates are named to the scan."""
        names = [r.p for r in effects.df.select("p").distinct().limit(PUSHED + 1).collect()]
        return rows.where(F.col("p").isin(names)) if len(names) <= PUSHED else rows

    def asserted(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        return find(self.graph, s, p, o)

    def query(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """All entailed triples (SIMPLE level) that match; ``None`` leaves a position open."""
        if p is None:
            answer = self._any_predicate(s, o)
        elif p == t.TYPE:
            answer = self._types(s, o)
        elif p in (t.SUB_CLASS, t.SUB_PROPERTY):
            answer = self.hierarchy.triples()
        else:
            answer = self._property(s, p, o)
        return answer.where(_matches(s=s, p=p, o=o)).select(*TRIPLE).distinct()

    def query_pattern(self, pattern: tuple[str, str, str]) -> DataFrame:
        """As ``query``; ``?x`` marks a variable and may repeat."""
        s, p, o = (None if is_variable(term) else term for term in pattern)
        return self.query(s, p, o).where(pattern_filter(pattern))

    def is_entailed(self, triple: tuple[str, str, str]) -> bool:
        return not self.query(*triple).isEmpty()

    def _narrowed(self, stored: Stored, condition: Column) -> Stored:
        return Stored(stored.df.where(condition), stored.rows)

    def _types(self, s: str | None, o: str | None) -> DataFrame:
        """Through a class below, or through a property whose domain or range is or lies below."""
        effects = self.effects
        wanted = F.col("target") == o if o is not None else F.lit(True)
        stated = find(self.facts, s, t.TYPE, o)
        below = self._narrowed(effects.by_class, wanted)
        from_class = (
            find(self.facts, s, t.TYPE, None).join(below.side(below.df.withColumnRenamed("c", "o")), "o")
            .select("s", "p", F.col("target").alias("o"))
        )

        def through(action: str, node: str) -> DataFrame:
            side = self._narrowed(effects.by_property, (F.col("action") == action) & wanted)
            rows = self._of(side, self.graph.where(_matches(**{node: s})))
            joined = rows.join(side.side(side.df.select("p", "target", "literal_ok")), "p")
            return joined.where(F.col("literal_ok") | ~is_literal(F.col("o"))).select(
                F.col(node).alias("s"), F.lit(t.TYPE).alias("p"), F.col("target").alias("o"))

        return union_all([stated, from_class, through("S", "s"), through("O", "o")])

    def _property(self, s: str | None, p: str, o: str | None) -> DataFrame:
        side = self._narrowed(self.effects.by_property, (F.col("action") == "P") & (F.col("target") == p))
        below = self._of(side, self.asserted(s, None, o)).join(side.side(side.df.select("p", "target")), "p").select(
            "s", F.col("target").alias("p"), "o")
        return self.asserted(s, p, o).union(below)

    def _any_predicate(self, s: str | None, o: str | None) -> DataFrame:
        moves = self._narrowed(self.effects.by_property, F.col("action") == "P")
        below = self._of(moves, self.asserted(s, None, o)).join(moves.side(moves.df.select("p", "target")), "p").select(
            "s", F.col("target").alias("p"), "o")
        return union_all([self.asserted(s, None, o), below, self._types(s, o), self.hierarchy.triples()])


def query(graph: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    return GoalReasoner(graph).query_pattern(pattern)


def is_entailed(graph: DataFrame, triple: tuple[str, str, str]) -> bool:
    return GoalReasoner(graph).is_entailed(triple)
