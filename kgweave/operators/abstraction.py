"""Individuals grouped by what is said of them: classes, outgoing and incoming predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.functions import terms as t
from kgweave.plans.workspace import store

SIGNATURE = ["types", "out_props", "in_props"]


# Classes and predicates that are marked in words of 64 bits; of more, the sets are collected as text.
MARKED = 1024


def compute_types(graph: DataFrame) -> DataFrame:
    """``(individual, types, out_props, in_props)``, the last three sorted arrays.

    The sets hold predicates and classes, not neighbours, and are combined before the shuffle, so
    a node with very many triples costs no more than its distinct predicates. rdf:type counts as
    an outgoing predicate but not as an incoming one. Where ``MARKED`` bits are enough for all values,
    a node's sets are bits while they are shuffled, and each combination of bits is spelled out once.
    """
    is_type = F.col("p") == t.TYPE
    out = F.struct(F.col("s").alias("individual"), F.lit(True).alias("outgoing"), F.col("p").alias("p"),
                   F.when(is_type, F.col("o")).alias("cls"))
    into = F.when(~is_type, F.struct(F.col("o").alias("individual"), F.lit(False).alias("outgoing"),
                                     F.col("p").alias("p"), F.lit(None).cast("string").alias("cls")))
    sides = graph.select(F.explode(F.array(out, into)).alias("e")).where("e IS NOT NULL").select("e.*")
    named = F.array(F.struct(F.when(F.col("outgoing"), "out_props").otherwise("in_props").alias("kind"), F.col("p").alias("value")),
                    F.struct(F.lit("types").alias("kind"), F.col("cls").alias("value")))
    values = store(sides.select("outgoing", "p", "cls").distinct()
                   .select(F.explode(named).alias("e")).select("e.*").dropna().distinct())
    if values.rows > MARKED:
        return sides.distinct().groupBy("individual").agg(
            F.sort_array(F.collect_set("cls")).alias("types"),
            F.sort_array(F.collect_set(F.when(F.col("outgoing"), F.col("p")))).alias("out_props"),
            F.sort_array(F.collect_set(F.when(~F.col("outgoing"), F.col("p")))).alias("in_props"),
        )
    places = sorted(((r.kind, r.value) for r in values.df.collect()), key=lambda r: (r[0], r[1].encode()))
    words = [f"word{k}" for k in range(max(1, -(-len(places) // 64)))]

    def marks(column: str, kinds: list[str]) -> DataFrame:
        rows = [(kind == "out_props", value, i // 64, _bit(i)) for i, (kind, value) in enumerate(places) if kind in kinds]
        return F.broadcast(graph.sparkSession.createDataFrame(
            rows, f"outgoing boolean, {column} string, {column}_word int, {column}_bit long"))

    marked = sides.join(marks("p", ["out_props", "in_props"]), ["outgoing", "p"], "left").join(
        marks("cls", ["types"]).drop("outgoing"), "cls", "left")
    both = store(marked.groupBy("individual").agg(*[F.bit_or(
        F.when(F.col("p_word") == k, F.col("p_bit")).otherwise(0).bitwiseOR(F.when(F.col("cls_word") == k, F.col("cls_bit")).otherwise(0))
    ).alias(word) for k, word in enumerate(words)]))
    kinds = store(both.df.select(*words).distinct())
    spelled = kinds.df.select(*words, *[F.array_compact(F.array(*[
        F.when(F.col(words[i // 64]).bitwiseAND(F.lit(_bit(i))) != 0, F.lit(value))
        for i, (kind, value) in enumerate(places) if kind == name], F.lit(None).cast("string"))).alias(name) for name in SIGNATURE])
    return both.df.join(kinds.side(spelled), words).select("individual", *SIGNATURE)


def _bit(place: int) -> int:
    """The bit of a place in its word, as a signed 64-bit number."""
    bit = place % 64
    return 1 << bit if bit < 63 else -(1 << 63)


def type_groups(signatures: DataFrame) -> DataFrame:
    """``(signature, individual)``: one row per member, so that no group has to fit in one row."""
    text = F.concat_ws("|", *[F.concat_ws(" ", c) for c in SIGNATURE])
    return signatures.select(F.sha2(text, 256).alias("signature"), *SIGNATURE, "individual")


def signature_sizes(signatures: DataFrame) -> DataFrame:
    return signatures.groupBy(*SIGNATURE).agg(F.count("*").alias("individuals"))
