"""owl:sameAs groups as connected components.

A group of n equal nodes has n*n sameAs pairs, so groups are kept as stars: every member points to
the least term of its group. Components come from alternating large-star and small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014), which need O(log^2 n)
rounds on any shape, long chains included. Each round is a minimum per node, combined before the
shuffle, and a join back that keeps the rows of frequent nodes in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.functions.terms import SAME_AS, TRIPLE
from kgweave.plans.skew import join_counted
from kgweave.plans.workspace import BROADCAST_ROWS, Stored, store, union_all


def _link_to_least(edges: Stored, both_ways: bool) -> DataFrame:
    """Re-hang every node's neighbours on the least node around."""
    df = edges.df
    total = edges.rows
    if both_ways:
        df = df.union(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total *= 2
    least = df.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    if total <= BROADCAST_ROWS:
        moved = df.join(F.broadcast(least), "u")
    else:
        least = store(least).df
        moved = join_counted(df, least, ["u"], total)
    if both_ways:
        return moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .where(F.col("u") != F.col("v"))
    )


def _is_forest_of_stars(edges: Stored) -> bool:
    """Every node hangs on one other, and none of those hangs anywhere itself."""
    df = edges.df
    double = df.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("u")
    inner = df.select("u").join(df.select(F.col("v").alias("u")), "u", "left_semi")
    return double.union(inner).isEmpty()


def connected_components(pairs: DataFrame) -> DataFrame:
    """``(node, canonical)`` for every node that occurs in a pair ``(s, o)``."""
    nodes = pairs.select(F.explode(F.array("s", "o")).alias("node")).distinct()
    edges = store(
        pairs.where(F.col("s") != F.col("o"))
        .select(F.greatest("s", "o").alias("u"), F.least("s", "o").alias("v"))
        .distinct()
    )
    while not edges.empty and not _is_forest_of_stars(edges):
        wide = store(_link_to_least(edges, both_ways=True).distinct())
        edges = store(_link_to_least(wide, both_ways=False).distinct())
    return nodes.join(
        edges.df.select(F.col("u").alias("node"), F.col("v").alias("canonical")), "node", "left"
    ).select("node", F.coalesce("canonical", "node").alias("canonical"))


def star_triples(components: DataFrame) -> DataFrame:
    """sameAs triples between each member and its canonical term, both ways."""
    star = components.where(F.col("node") != F.col("canonical"))
    pairs = F.explode(
        F.array(
            F.struct(F.col("node").alias("s"), F.col("canonical").alias("o")),
            F.struct(F.col("canonical").alias("s"), F.col("node").alias("o")),
        )
    )
    return star.select(pairs.alias("e")).select(
        "e.s", F.lit(SAME_AS).alias("p"), "e.o"
    )


def same_as_partners(components: DataFrame, nodes: DataFrame) -> DataFrame:
    """All ``(node, same)`` with ``node`` among the given ones.

    This answers "what equals x" for the asked nodes without spelling out every group's pairs.
    """
    asked = nodes.select("node").distinct().join(components, "node").select("node", "canonical")
    others = components.select(F.col("node").alias("same"), "canonical")
    return asked.join(others, "canonical").where(F.col("node") != F.col("same")).select("node", "same")


def value_groups(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """``(s, o)`` pairs that tie each group's values to the group's least one.

    Rows with the same ``key`` name the same thing by ``value``; n values give n - 1 pairs, whose
    components are those of all n*n.
    """
    distinct = store(rows.select(*key, F.col(value).alias("v")).distinct())
    groups = store(
        distinct.df.groupBy(*key)
        .agg(F.min("v").alias("m"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
    ).df
    return (
        join_counted(distinct.df, groups, key, distinct.rows)
        .where(F.col("v") != F.col("m"))
        .select(F.col("v").alias("s"), F.col("m").alias("o"))
        .distinct()
    )


def canonical_terms(graph: DataFrame, components: DataFrame) -> DataFrame:
    """Triples moved onto the canonical subject and object (eq-rep-s, eq-rep-o).

    Column ``changed`` tells which ones were not canonical before.
    """
    moved = components.where(F.col("node") != F.col("canonical"))
    subject = moved.select(F.col("node").alias("s"), F.col("canonical").alias("s2"))
    object_ = moved.select(F.col("node").alias("o"), F.col("canonical").alias("o2"))
    return (
        graph.join(subject, "s", "left")
        .join(object_, "o", "left")
        .select(
            F.coalesce("s2", "s").alias("s"), "p", F.coalesce("o2", "o").alias("o"),
            (F.col("s2").isNotNull() | F.col("o2").isNotNull()).alias("changed"),
        )
    )


def moved_triples(graph: DataFrame, changed: Stored, components: Stored) -> DataFrame:
    """The triples about changed(node, canonical), moved onto the canonical subject and object.

    All other triples stay where they are: the changed nodes are the small side of both joins.
    """
    nodes = changed.df.select("node")
    about = union_all([
        graph.join(changed.side(nodes.withColumnRenamed("node", end)), end, "left_semi").select(*TRIPLE)
        for end in ("s", "o")])
    every = components.side(components.df.where(F.col("node") != F.col("canonical")))
    for end in ("s", "o"):
        about = about.join(every.select(F.col("node").alias(end), F.col("canonical").alias("to")), end, "left").withColumn(
            end, F.coalesce("to", end)).drop("to")
    return about.select(*TRIPLE)
