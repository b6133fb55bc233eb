"""Selections, projections and set operations on graphs ``(s, p, o)``.

Every operation returns a set of triples unless its name says otherwise, and every predicate is a
column expression, so it reaches the Parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgweave.functions import terms as t
from kgweave.functions.terms import TRIPLE
from kgweave.plans.workspace import store

# Predicates whose triples belong to the terminology, and classes whose instances do.
TERMINOLOGICAL_PREDICATES = [
    t.SUB_CLASS, t.EQUIVALENT_CLASS, t.DISJOINT_CLASS,
    t.INTERSECTION, t.UNION, t.COMPLEMENT, t.SOME_VALUES, t.ALL_VALUES, t.HAS_VALUE,
    t.MAX_CARDINALITY, t.MIN_CARDINALITY, t.CARDINALITY,
    t.SUB_PROPERTY, t.EQUIVALENT_PROPERTY, t.DISJOINT_PROPERTY, t.DOMAIN, t.RANGE, t.INVERSE_OF,
]
TERMINOLOGICAL_TYPES = [
    t.OBJECT_PROPERTY, t.DATA_PROPERTY, t.FUNCTIONAL, t.INVERSE_FUNCTIONAL, t.SYMMETRIC,
    t.ASYMMETRIC, t.REFLEXIVE, t.IRREFLEXIVE, t.TRANSITIVE, t.CLASS, t.RDFS_CLASS, t.RESTRICTION,
]
RDFS_SCHEMA = [t.SUB_CLASS, t.SUB_PROPERTY, t.DOMAIN, t.RANGE]
HORST_SCHEMA_PREDICATES = [
    t.SUB_CLASS, t.SUB_PROPERTY, t.DOMAIN, t.RANGE, t.EQUIVALENT_PROPERTY, t.EQUIVALENT_CLASS,
    t.INVERSE_OF, t.SOME_VALUES, t.ALL_VALUES, t.HAS_VALUE, t.ON_PROPERTY,
]
HORST_SCHEMA_TYPES = [t.TRANSITIVE, t.FUNCTIONAL, t.INVERSE_FUNCTIONAL, t.SYMMETRIC]
SPLIT_PREDICATES = [
    t.SUB_CLASS, t.SUB_PROPERTY, t.DOMAIN, t.RANGE,
    t.EQUIVALENT_CLASS, t.EQUIVALENT_PROPERTY, t.ALL_VALUES, t.SOME_VALUES, t.INVERSE_OF,
    t.ON_PROPERTY, t.HAS_VALUE, t.CARDINALITY, t.MIN_CARDINALITY, t.MAX_CARDINALITY,
    t.MAX_QUALIFIED, t.COMPLEMENT, t.UNION, t.INTERSECTION,
]


# --- selections ------------------------------------------------------------------------------

def find(graph: DataFrame, s: str | None = None, p: str | None = None,
         o: str | None = None) -> DataFrame:
    for name, term in (("s", s), ("p", p), ("o", o)):
        if term is not None:
            graph = graph.where(F.col(name) == term)
    return graph.select(*TRIPLE)


def is_variable(term: str) -> bool:
    return term.startswith("?")


def pattern_filter(pattern: tuple[str, str, str]) -> Column:
    """Condition for a triple to match; a variable used twice asks for equal terms."""
    condition = F.lit(True)
    first_use: dict[str, str] = {}
    for name, term in zip(TRIPLE, pattern):
        if not is_variable(term):
            condition = condition & (F.col(name) == term)
        elif term in first_use:
            condition = condition & (F.col(name) == F.col(first_use[term]))
        else:
            first_use[term] = name
    return condition


def find_pattern(graph: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    return graph.where(pattern_filter(pattern)).select(*TRIPLE)


def extract_triples(graph: DataFrame, predicate: str) -> DataFrame:
    return find(graph, p=predicate)


def partition_by(graph: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows that do not (a null verdict does not pass)."""
    return graph.where(predicate), graph.where(~F.coalesce(predicate, F.lit(False)))


def is_terminological() -> Column:
    return F.col("p").isin(TERMINOLOGICAL_PREDICATES) | (
        (F.col("p") == t.TYPE) & F.col("o").isin(TERMINOLOGICAL_TYPES)
    )


def is_assertional() -> Column:
    return ~is_terminological()


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def none_of(*conditions: Column) -> Column:
    return ~any_of(*conditions)


def extract_rdfs_schema(graph: DataFrame) -> DataFrame:
    return graph.where(F.col("p").isin(RDFS_SCHEMA)).select(*TRIPLE)


def extract_owl_horst_schema(graph: DataFrame) -> DataFrame:
    return graph.where(
        F.col("p").isin(HORST_SCHEMA_PREDICATES) | F.col("o").isin(HORST_SCHEMA_TYPES)
    ).select(*TRIPLE)


def split_schema(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schema triples and instance triples."""
    return partition_by(graph, F.col("p").isin(SPLIT_PREDICATES))


def in_namespace(graph: DataFrame, namespace: str) -> DataFrame:
    """Type triples with a class of the namespace and other triples with a predicate of it."""
    subject_to_test = F.when(F.col("p") == t.TYPE, F.col("o")).otherwise(F.col("p"))
    return graph.where(subject_to_test.startswith(namespace))


# --- projections -----------------------------------------------------------------------------

def project_pair(graph: DataFrame, key: str, value: str) -> DataFrame:
    """Key/value view of a graph: ``project_pair(g, "s", "po")`` gives s with struct(p, o)."""
    def shape(names: str, alias: str) -> Column:
        if len(names) == 1:
            return F.col(names).alias(alias)
        return F.struct(*[F.col(n) for n in names]).alias(alias)

    return graph.select(shape(key, "key"), shape(value, "value"))


def swap_pair(pairs: DataFrame) -> DataFrame:
    first, second = pairs.columns
    return pairs.select(F.col(second).alias(first), F.col(first).alias(second))


def subject_object(graph: DataFrame, predicate: str) -> DataFrame:
    return graph.where(F.col("p") == predicate).select("s", "o")


def with_predicate(pairs: DataFrame, predicate: str) -> DataFrame:
    return pairs.select("s", F.lit(predicate).alias("p"), "o")


# --- sets ------------------------------------------------------------------------------------

def union(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select(*TRIPLE).union(second.select(*TRIPLE)).distinct()


def union_of(graphs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [g.select(*TRIPLE) for g in graphs]).distinct()


def intersection(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select(*TRIPLE).intersect(second.select(*TRIPLE))


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select(*TRIPLE).subtract(second.select(*TRIPLE))


def bag_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs off equal rows and keeps the rest of the first bag, duplicates included."""
    return first.select(*TRIPLE).exceptAll(second.select(*TRIPLE))


def new_facts(candidates: DataFrame, known: DataFrame) -> DataFrame:
    return candidates.select(*TRIPLE).distinct().join(known, TRIPLE, "left_anti")


def size(graph: DataFrame) -> int:
    return graph.count()


def same_graph(first: DataFrame, second: DataFrame) -> bool:
    """Whether both hold the same set of triples."""
    return difference(first, second).isEmpty() and difference(second, first).isEmpty()


def sort_triples(graph: DataFrame) -> DataFrame:
    return graph.orderBy(*TRIPLE)


def multi_map(pairs: DataFrame) -> DataFrame:
    """``(key, values)`` of a schema-sized relation ``(s, o)``."""
    return pairs.groupBy(F.col("s").alias("key")).agg(
        F.sort_array(F.collect_set("o")).alias("values")
    )


def multi_map_chunks(pairs: DataFrame, size: int = 10_000) -> DataFrame:
    """``(key, chunk, values)`` of any relation ``(s, o)``: each key's values once, in sorted arrays of ``size`` or fewer.

    Values of a key with more than ``size`` are dealt over groups by their hash before they are counted
    off, so no task and no row holds them all. ``chunk`` is 0 for keys that need one only; it is not consecutive.
    """
    distinct = store(pairs.select(F.col("s").alias("key"), F.col("o").alias("value")).where("value IS NOT NULL").distinct())
    large = store(distinct.df.groupBy("key").agg(F.ceil(F.count("*") / size).alias("groups")).where(F.col("groups") > 1))
    marks = large.side(large.df.select(F.col("key").alias("_key"), "groups"))
    dealt = distinct.df.join(marks, F.col("key").eqNullSafe(F.col("_key")), "left").select(
        "key", "value", F.coalesce(F.pmod(F.xxhash64("value"), "groups"), F.lit(0)).alias("group"))
    ahead = Window.partitionBy("key", "group").orderBy("value")
    parts = dealt.withColumn("part", F.floor((F.row_number().over(ahead) - 1) / size))
    return (
        parts.groupBy("key", F.struct("group", "part").alias("place"))
        .agg(F.array_sort(F.collect_list("value")).alias("values"))
        .select("key", (F.shiftleft("place.group", 32) + F.col("place.part")).alias("chunk"), "values"))
