"""RDF lists as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.functions.terms import FIRST, NIL, REST
from kgweave.plans.workspace import store


class CyclicList(ValueError):
    pass


def unfold_list(graph: DataFrame) -> DataFrame:
    """``(head, pos, member)`` for every list, ``pos`` counted from 1.

    A list begins at a cell that no other cell points at, or that something other than a cell points at.

    Each open cell takes over the pointer of the cell it points at, which doubles the distance it
    covers, so a list of n cells takes log2(n) rounds. A cell is settled once it points at its
    head; open cells of one list all point at different cells, so no join key becomes frequent.
    """
    cells = graph.where(F.col("p") == FIRST).select(
        F.col("s").alias("cell"), F.col("o").alias("member")
    ).distinct()
    links = graph.where((F.col("p") == REST) & (F.col("o") != NIL)).select(
        F.col("o").alias("cell"), F.col("s").alias("before")
    ).distinct()
    heads = cells.select("cell").distinct().join(links, "cell", "left_anti")
    followers = links.join(
        heads.select(F.col("cell").alias("before"), F.lit(True).alias("at_head")), "before", "left"
    )
    state = store(
        heads.select("cell", F.col("cell").alias("at"), F.lit(0).cast("long").alias("dist"),
                     F.lit(True).alias("settled"))
        .union(followers.select("cell", F.col("before").alias("at"), F.lit(1).cast("long").alias("dist"),
                                F.coalesce("at_head", F.lit(False)).alias("settled")))
    )
    reach = 1
    while not state.df.where("NOT settled").isEmpty():
        if reach > state.rows:
            raise CyclicList("an rdf:rest chain runs in a circle")
        target = state.df.select(
            F.col("cell").alias("at"), F.col("at").alias("next"), F.col("dist").alias("more"),
            F.col("settled").alias("next_settled"),
        )
        moved = state.df.where("NOT settled").join(target, "at").select(
            "cell", F.col("next").alias("at"), (F.col("dist") + F.col("more")).alias("dist"),
            F.col("next_settled").alias("settled"),
        )
        state = store(state.df.where("settled").unionByName(moved))
        reach *= 2
    pointed = store(links.select(F.col("cell").alias("o")).distinct())
    inner = graph.where(~F.col("p").isin(FIRST, REST)).join(pointed.side(), "o", "left_semi").select(
        F.col("o").alias("cell")).distinct()
    start = state.df.join(inner, "cell").groupBy("cell").agg(F.min(F.struct("at", "dist")).alias("x")).select(
        F.col("cell").alias("head"), F.col("x.at").alias("at"), F.col("x.dist").alias("skip"))
    tails = state.df.join(start, "at").where(F.col("dist") >= F.col("skip")).select(
        "cell", F.col("head").alias("at"), (F.col("dist") - F.col("skip")).alias("dist"))
    return state.df.select("cell", "at", "dist").union(tails).join(cells, "cell").select(
        F.col("at").alias("head"), (F.col("dist") + 1).alias("pos"), "member"
    )
