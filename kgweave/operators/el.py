"""OWL EL completion of a terminology.

Two relations hold the state: subsumptions between named classes and class-to-class links through a
property. They share one table ``(c, r, d)``, where an empty ``r`` marks a subsumption, so that a
round is one write.

What a fact implies by itself (rules 1, 3 and 10) is closed before the rounds begin: the first round holds,
for each class, all its stated superclasses and all links it inherits. A subsumption found later brings the
first-round rows of its superclass with it in one join. Rounds are thus for rules over two facts only, and
what those look for is kept aside as ``Contexts``, so that a round joins new rows with counted contexts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.functions import terms as t
from kgweave.functions.terms import TRIPLE
from kgweave.operators.closure import close_into_table, closure_of_predicate
from kgweave.operators.lists import unfold_list
from kgweave.plans.skew import join_split
from kgweave.plans.workspace import (
    BROADCAST_ROWS, FactTable, Stored, Workspace, run_to_fixpoint, store, union_all,
)

AUXILIARY = "\x01and-"  # begins like no IRI, blank node or literal
FACT = ["c", "r", "d"]


# --- reading axioms -------------------------------------------------------------------------------

def restriction_nodes(graph: DataFrame) -> DataFrame:
    """``(node, r, filler)`` of existential restrictions."""
    on = graph.where(F.col("p") == t.ON_PROPERTY).select(F.col("s").alias("node"), F.col("o").alias("r"))
    some = graph.where(F.col("p") == t.SOME_VALUES).select(F.col("s").alias("node"), F.col("o").alias("filler"))
    return on.join(some, "node").select("node", "r", "filler").distinct()


def _sub_class(graph: DataFrame) -> DataFrame:
    """Rows may repeat: who reads them removes duplicates from the few that a join leaves."""
    return graph.where(F.col("p") == t.SUB_CLASS).select(F.col("s").alias("c"), F.col("o").alias("d"))


def atomic_subclasses(graph: DataFrame) -> DataFrame:
    """``(c, d)`` between classes that are neither restrictions nor intersections."""
    complex_nodes = graph.where(F.col("p").isin(t.ON_PROPERTY, t.INTERSECTION)).select("s").distinct()
    return (
        _sub_class(graph)
        .join(complex_nodes.withColumnRenamed("s", "c"), "c", "left_anti")
        .join(complex_nodes.withColumnRenamed("s", "d"), "d", "left_anti")
        .select("c", "d").distinct()
    )


def restriction_subclasses(graph: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(r, filler, d)`` of axioms with an existential restriction below a class."""
    return (
        (restriction_nodes(graph) if nodes is None else nodes).join(_sub_class(graph), F.col("node") == F.col("c"))
        .select("r", "filler", "d").distinct()
    )


def restriction_superclasses(graph: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(c, r, filler)`` of axioms with an existential restriction above a class."""
    return (
        (restriction_nodes(graph) if nodes is None else nodes).join(_sub_class(graph), F.col("node") == F.col("d"))
        .select("c", "r", "filler").distinct()
    )


def intersection_subclasses(graph: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """``(c1, c2, d)`` of axioms with an intersection below a class.

    A list of n members becomes n - 1 such rows, chained through auxiliary classes.
    """
    heads = graph.where(F.col("p") == t.INTERSECTION).select(F.col("s").alias("node"), F.col("o").alias("head"))
    members = (unfold_list(graph) if lists is None else lists).join(heads, "head")
    shape = members.groupBy("node", "head").agg(
        F.max("pos").alias("n"), F.max(F.when(F.col("pos") == 1, F.col("member"))).alias("first"))
    axioms = _sub_class(graph).select(F.col("c").alias("node"), "d")
    rows = members.join(shape, ["node", "head"]).join(axioms, "node").where("pos > 1 OR n = 1")

    def prefix(position):
        return F.concat(F.lit(AUXILIARY), F.sha2(F.concat_ws("\x1f", "node", "head", position.cast("string")), 256))

    return rows.select(
        F.when(F.col("pos") <= 2, F.col("first")).otherwise(prefix(F.col("pos") - 1)).alias("c1"),
        F.col("member").alias("c2"),
        F.when(F.col("pos") == F.col("n"), F.col("d")).otherwise(prefix(F.col("pos"))).alias("d"),
    ).distinct()


def sub_properties(graph: DataFrame) -> DataFrame:
    return graph.where(F.col("p") == t.SUB_PROPERTY).select(F.col("s").alias("r"), F.col("o").alias("q")).distinct()


def property_chains(graph: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """``(r1, r2, q)`` of property chains with exactly two members."""
    axioms = graph.where(F.col("p") == t.PROPERTY_CHAIN).select(F.col("s").alias("q"), F.col("o").alias("head"))
    members = (unfold_list(graph) if lists is None else lists).join(axioms, "head")
    return (
        members.groupBy("q", "head")
        .agg(F.count("*").alias("n"),
             F.max(F.when(F.col("pos") == 1, F.col("member"))).alias("r1"),
             F.max(F.when(F.col("pos") == 2, F.col("member"))).alias("r2"))
        .where("n = 2").select("r1", "r2", "q").distinct()
    )


@dataclass(frozen=True)
class Axioms:
    below: Stored       # (c, d)
    meets: Stored       # (c1, c2, d)
    some_below: Stored  # (r, filler, d)
    some_above: Stored  # (c, r, filler)
    roles: Stored       # (r, q), closed
    chains: Stored      # (r1, r2, q)


def read_axioms(graph: DataFrame) -> Axioms:
    closed_roles = closure_of_predicate(graph, t.SUB_PROPERTY)
    lists = store(unfold_list(graph)).df
    # Stored once: each table below reads these, and not the graph with its other predicates.
    nodes = store(restriction_nodes(graph)).df
    stated = store(graph.where(F.col("p").isin(t.SUB_CLASS, t.ON_PROPERTY, t.INTERSECTION)).select("s", "p", "o")).df
    return Axioms(
        store(atomic_subclasses(stated)), store(intersection_subclasses(stated, lists)),
        store(restriction_subclasses(stated, nodes)), store(restriction_superclasses(stated, nodes)),
        store(sub_properties(closed_roles)), store(property_chains(graph, lists)),
    )


# --- rules: S rows are (c, d), E rows are (c, r, d) -------------------------------------------------

def cr1(s: DataFrame, axioms: Axioms) -> DataFrame:
    up = axioms.below.side(axioms.below.df.select(F.col("c").alias("d"), F.col("d").alias("e")))
    return s.join(up, "d").select("c", F.col("e").alias("d"))


def _first_meets(s: DataFrame, axioms: Axioms) -> DataFrame:
    wanted = axioms.meets.side(axioms.meets.df.select(F.col("c1").alias("d")).distinct())
    return s.join(wanted, "d", "left_semi").select("c", F.col("d").alias("d1"))


def _second_meets(s: DataFrame, axioms: Axioms) -> DataFrame:
    wanted = axioms.meets.side(axioms.meets.df.select(F.col("c2").alias("d")).distinct())
    return s.join(wanted, "d", "left_semi").select("c", F.col("d").alias("d2"))


def _met(pairs: DataFrame, axioms: Axioms) -> DataFrame:
    """Subsumptions from ``(c, d1, d2)``, c being below both."""
    meets = axioms.meets
    side = meets.side(meets.df.select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.col("d").alias("e")))
    return pairs.join(side, ["d1", "d2"]).select("c", F.col("e").alias("d"))


def cr2(first: DataFrame, second: DataFrame, axioms: Axioms) -> DataFrame:
    """A class's own superclasses are paired first: they are few, while one class may begin very many intersections."""
    return _met(_first_meets(first, axioms).join(_second_meets(second, axioms), "c"), axioms)


def cr3(s: DataFrame, axioms: Axioms) -> DataFrame:
    above = axioms.some_above
    side = above.side(above.df.select(F.col("c").alias("d"), "r", "filler"))
    return s.join(side, "d").select("c", "r", F.col("filler").alias("d"))


def _fillers(s: DataFrame, axioms: Axioms) -> DataFrame:
    """``(d, r, e)``: what links to d through r is below e."""
    below = axioms.some_below
    side = below.side(below.df.select(F.col("filler").alias("d"), "r", F.col("d").alias("e")))
    return s.join(side, "d").select(F.col("c").alias("d"), "r", "e")


def _asked_links(links: DataFrame, axioms: Axioms) -> DataFrame:
    return links.join(axioms.some_below.side(axioms.some_below.df.select("r").distinct()), "r", "left_semi")


def cr4(links: DataFrame, s: DataFrame, axioms: Axioms) -> DataFrame:
    fillers = _fillers(s, axioms)
    return _asked_links(links, axioms).join(fillers, ["d", "r"]).select("c", F.col("e").alias("d"))


def _empty_classes(s: DataFrame) -> DataFrame:
    return s.where(F.col("d") == t.NOTHING).select(F.col("c").alias("d"))


def cr5(links: DataFrame, s: DataFrame) -> DataFrame:
    return links.join(_empty_classes(s), "d", "left_semi").select("c", F.lit(t.NOTHING).alias("d"))


def cr10(links: DataFrame, axioms: Axioms) -> DataFrame:
    return links.join(axioms.roles.side(), "r").select("c", F.col("q").alias("r"), "d")


def _chain_starts(links: DataFrame, axioms: Axioms) -> DataFrame:
    chains = axioms.chains
    side = chains.side(chains.df.select(F.col("r1").alias("r"), "r2", "q"))
    return links.join(side, "r").select("c", F.col("d").alias("mid"), "r2", "q")


def _chain_ends(links: DataFrame, axioms: Axioms) -> DataFrame:
    chains = axioms.chains
    nexts = chains.side(chains.df.select(F.col("r2").alias("r")).distinct())
    return links.join(nexts, "r", "left_semi").select(F.col("c").alias("mid"), F.col("r").alias("r2"), "d")


def cr11(first: DataFrame, second: DataFrame, axioms: Axioms) -> DataFrame:
    start, follow = _chain_starts(first, axioms), _chain_ends(second, axioms)
    return start.join(follow, ["mid", "r2"]).select("c", F.col("q").alias("r"), "d")


# --- loop -----------------------------------------------------------------------------------------

def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("r") == "").select("c", "d"), rows.where(F.col("r") != "")


def _as_subsumption(df: DataFrame) -> DataFrame:
    return df.select("c", F.lit("").alias("r"), "d")


@dataclass(frozen=True)
class Side:
    """Rows of a join and a bound on how many they are."""

    df: DataFrame
    rows: int


def _pairs(left: Side, right: Side, keys: list[str]) -> list[DataFrame]:
    """The join of two sides, or nothing where one is known to be empty; frequent keys are split where both are large."""
    if not left.rows or not right.rows:
        return []
    if right.rows <= min(left.rows, BROADCAST_ROWS):
        return [left.df.join(F.broadcast(right.df), keys)]
    if left.rows <= BROADCAST_ROWS:
        return [F.broadcast(left.df).join(right.df, keys)]
    return [join_split(left.df, right.df, keys, max(left.rows, right.rows))]


class Contexts:
    """One side of each rule over two facts, cut down to the facts that can take part in it.

    One table ``(k1, k2, v, w)``, partitioned by the round that found a row and by the kind of side, so that a
    round reads just the partitions it joins. ``k1, k2`` are the join's key; each kind's rows are counted.
    """

    COLUMNS = ["k1", "k2", "v", "w"]

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rounds = 0
        self._name = Workspace.of(spark).new_name()
        self._new: dict[str, int] = {}
        self._old: dict[str, int] = {}

    def append(self, frames: dict[str, DataFrame]) -> None:
        rows = union_all([
            df.select(*[F.col(df.columns[i]).alias(c) if i < len(df.columns) else F.lit(None).cast("string").alias(c)
                        for i, c in enumerate(self.COLUMNS)], F.lit(kind).alias("kind"))
            for kind, df in frames.items()])
        (
            rows.withColumn("found_in", F.lit(self.rounds)).write.format("parquet")
            .partitionBy("found_in", "kind").mode("append").saveAsTable(self._name)
        )
        for kind, n in self._new.items():
            self._old[kind] = self._old.get(kind, 0) + n
        found = self.spark.table(self._name).where(F.col("found_in") == self.rounds).groupBy("kind").count()
        self._new = {row["kind"]: row["count"] for row in found.collect()}
        self.rounds += 1

    def new(self, kind: str) -> Side:
        return self._read(kind, F.col("found_in") == self.rounds - 1, self._new.get(kind, 0))

    def old(self, kind: str) -> Side:
        return self._read(kind, F.col("found_in") < self.rounds - 1, self._old.get(kind, 0))

    def all(self, kind: str) -> Side:
        return self._read(kind, F.lit(True), self._old.get(kind, 0) + self._new.get(kind, 0))

    def _read(self, kind: str, when, rows: int) -> Side:
        if not rows:  # nothing will read it
            return Side(self.spark.range(0).toDF("k1"), 0)
        return Side(self.spark.table(self._name).where((F.col("kind") == kind) & when).select(*self.COLUMNS), rows)


def complete(axioms: Axioms) -> FactTable:
    """All subsumptions and links that follow from the axioms, as ``(c, r, d)``."""
    spark = axioms.below.df.sparkSession
    up = close_into_table(axioms.below.df.select(F.col("c").alias("s"), F.col("d").alias("o")), [])
    above = up.known.select(F.col("s").alias("c"), F.col("o").alias("d"))
    stated = axioms.some_above.df.select("c", "r", F.col("filler").alias("d"))
    inherited = stated if axioms.some_above.empty else stated.union(cr3(above, axioms))
    if not axioms.roles.empty:
        inherited = inherited.union(cr10(inherited, axioms).select(*FACT))
    table = FactTable(spark, FACT, large=up.rows + axioms.some_above.rows > BROADCAST_ROWS)
    table.append(_as_subsumption(above).union(inherited))
    contexts = Contexts(spark)

    def step(facts: FactTable) -> DataFrame | None:
        s_new, e_new = _split(facts.delta)
        sides = {"empty": _empty_classes(s_new)}
        if not axioms.meets.empty:
            sides["first"] = _first_meets(s_new, axioms)
            sides["second"] = _second_meets(s_new, axioms)
        if not axioms.some_below.empty:
            sides["filler"] = _fillers(s_new, axioms)
        if not axioms.chains.empty:
            sides["start"] = _chain_starts(e_new, axioms).select("mid", "r2", "c", "q")
            sides["follow"] = _chain_ends(e_new, axioms)
        contexts.append(sides)

        def links(kind: str, columns: list[str], keys: list[str], narrow) -> list[DataFrame]:
            """New links with all contexts of a kind, and all links with its new ones."""
            def named(side: Side) -> Side:
                return Side(side.df.select(*[F.col(k).alias(c) for k, c in columns]) if side.rows else side.df, side.rows)
            found = _pairs(Side(narrow(e_new), facts.delta_rows), named(contexts.all(kind)), keys)
            if not facts.first_round:
                found += _pairs(Side(narrow(_split(facts.known)[1]), facts.rows), named(contexts.new(kind)), keys)
            return found

        def both(first: str, second: str, keys: list[str], end: str) -> list[DataFrame]:
            def ends(side: Side) -> Side:
                return Side(side.df.select(*keys, F.col(end).alias("end")) if side.rows else side.df, side.rows)
            return _pairs(contexts.new(first), ends(contexts.all(second)), keys) + _pairs(
                contexts.old(first), ends(contexts.new(second)), keys)

        below = [_met(df.select(F.col("k1").alias("c"), F.col("k2").alias("d1"), F.col("end").alias("d2")), axioms)
                 for df in both("first", "second", ["k1"], "k2")]
        below += [df.select("c", F.col("e").alias("d")) for df in links(
            "filler", [("k1", "d"), ("k2", "r"), ("v", "e")], ["d", "r"], lambda df: _asked_links(df, axioms))]
        below += [df.select("c", F.lit(t.NOTHING).alias("d")) for df in links(
            "empty", [("k1", "d")], ["d"], lambda df: df)]
        linked = [df.select(F.col("v").alias("c"), F.col("w").alias("r"), F.col("end").alias("d"))
                  for df in both("start", "follow", ["k1", "k2"], "v")]
        candidates = [_as_subsumption(df) for df in below] + linked
        if not candidates:
            return None
        fresh = store(union_all(candidates).distinct().join(facts.known, FACT, "left_anti").select(*FACT))
        if fresh.empty:
            return None
        s_fresh, e_fresh = _split(fresh.df)
        first = facts.base.select(F.col("c").alias("d"), "r", F.col("d").alias("e"))
        brought = fresh.side(s_fresh).join(first, "d").select("c", "r", F.col("e").alias("d"))
        out = [fresh.df, brought]
        if not axioms.roles.empty:
            out.append(cr10(e_fresh, axioms).select(*FACT))
        return union_all(out)

    return run_to_fixpoint(table, step)


def restriction_label(r, filler):
    """One blank node per restriction: the same r and filler always give the same label."""
    return F.concat(F.lit("_:some-"), F.sha2(F.concat_ws("\x1f", r, filler), 256))


def as_triples(subsumptions: DataFrame, links: DataFrame) -> DataFrame:
    """Subsumption triples, and three triples per link (its restriction's two only once)."""
    node = restriction_label(F.col("r"), F.col("d"))
    named = links.select("c", "r", "d", node.alias("node"))
    described = named.select("node", "r", "d").distinct()
    return union_all([
        subsumptions.select(F.col("c").alias("s"), F.lit(t.SUB_CLASS).alias("p"), F.col("d").alias("o")),
        named.select(F.col("c").alias("s"), F.lit(t.SUB_CLASS).alias("p"), F.col("node").alias("o")),
        described.select(F.col("node").alias("s"), F.lit(t.ON_PROPERTY).alias("p"), F.col("r").alias("o")),
        described.select(F.col("node").alias("s"), F.lit(t.SOME_VALUES).alias("p"), F.col("d").alias("o")),
    ])


def derived(axioms: Axioms) -> tuple[DataFrame, DataFrame]:
    """Subsumptions ``(c, d)`` and links ``(c, r, d)`` beyond the stated ones."""
    facts = complete(axioms).known
    subsumptions, links = _split(facts)
    named = subsumptions.where(~F.col("c").startswith(AUXILIARY) & ~F.col("d").startswith(AUXILIARY))
    stated = axioms.some_above.df.select("c", "r", F.col("filler").alias("d"))
    return (
        named.join(axioms.below.df, ["c", "d"], "left_anti"),
        links.join(stated, ["c", "r", "d"], "left_anti").select("c", "r", "d"),
    )


def materialize_owl_el(graph: DataFrame) -> DataFrame:
    """The graph plus the subclass axioms that the EL completion rules derive."""
    graph = graph.select(*TRIPLE)
    subsumptions, links = derived(read_axioms(graph))
    return graph.union(as_triples(subsumptions, links)).distinct()
