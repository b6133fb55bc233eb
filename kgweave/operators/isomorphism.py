"""Graph equality up to the names of blank nodes.

**Colours.** Every blank node starts with the colour of its ground surroundings and takes over, round after round,
the colours of the blank nodes around it, each link with its predicate and direction. A round adds up hashes per
node (combined before the shuffle, links to frequent nodes stay in place), so colours depend on no name. Rounds
end when the number of colours stands still. Different colour counts settle that the graphs differ, already before
the first round. Names of blank nodes are replaced by their 64-bit hashes as the graphs are read, so that long names
are not shuffled with every triple; where two names of a graph share a hash, the names stay.

**Components.** Blank nodes that are linked to each other form components; equal graphs have equally many
components of each make. A colour is settled in its component if one node has it, or if all nodes that have it
touch no blank node but such single ones: these are interchangeable. While a component has other colours, the
least of its rarest one is given to one node as a colour of its own, and colours are refined again.

**Exact check.** Once all colours are settled, a component's triples are written with colours for names.
Components of one make must hold the same such triples equally often, in both graphs; these are counts, so
neither pairs of components nor whole components are ever put side by side in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions.terms import TRIPLE
from kgweave.operators.components import connected_components
from kgweave.plans.skew import join_counted
from kgweave.plans.workspace import Stored, store, union_all


class Undecided(RuntimeError):
    """Nodes that refinement cannot tell apart are not interchangeable either, or too many had to be singled out."""


def is_blank(term: Column) -> Column:
    return term.startswith("_:")


def _lanes(value: Column) -> list[Column]:
    """Sums of a 64-bit hash that do not depend on the order of rows: each half on its own, far from overflow."""
    return [F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(value, 32)).alias("high"),
            F.count("*").alias("rows")]


def _short_names(graphs: list[DataFrame]) -> DataFrame:
    """``(g, s, p, o)`` with blank nodes named by their hashes; or as they are, where these do not tell them apart."""
    named = union_all([df.select(F.lit(g).alias("g"), *TRIPLE) for g, df in enumerate(graphs)])
    ends = named.select("g", F.explode(F.array("s", "o")).alias("node")).where(is_blank(F.col("node"))).distinct()
    shared = ends.groupBy("g", F.xxhash64("node").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    if not shared.isEmpty():
        return named

    def short(end: str) -> Column:
        return F.when(is_blank(F.col(end)), F.concat(F.lit("_:"), F.base64(F.unhex(F.lpad(F.hex(F.xxhash64(end)), 16, "0"))).substr(1, 11))).otherwise(F.col(end)).alias(end)

    return named.select("g", short("s"), "p", short("o"))


def _links(triples: DataFrame) -> DataFrame:
    """``(g, node, way, p, other)``: each triple as its blank ends see it."""
    out = triples.where(is_blank(F.col("s"))).select("g", F.col("s").alias("node"), F.lit("out").alias("way"), "p", F.col("o").alias("other"))
    into = triples.where(is_blank(F.col("o"))).select("g", F.col("o").alias("node"), F.lit("in").alias("way"), "p", F.col("s").alias("other"))
    return out.union(into)


def _refined(colours: Stored, links: Stored) -> Stored:
    """Colours ``(g, node, colour, n)`` after as many rounds as split any; ``n`` is the number of links to the node."""
    classes = colours.df.select("colour").distinct().count()
    while not links.empty:
        around = join_counted(
            links.df, colours.df.select("g", F.col("node").alias("other"), F.col("colour").alias("seen"), "n"),
            ["g", "other"], links.rows)
        sums = around.groupBy("g", "node").agg(*_lanes(F.xxhash64("way", "p", "seen")))
        colours = store(colours.df.join(sums, ["g", "node"], "left").select(
            "g", "node", F.xxhash64("colour", "low", "high", "rows").alias("colour"), "n"))
        before, classes = classes, colours.df.select("colour").distinct().count()
        if classes == before:
            break
    return colours


def _as_often(df: DataFrame, keys: list[str]) -> bool:
    """Whether both graphs have equally many rows of each key."""
    return df.groupBy(*keys).agg(F.sum(F.when(F.col("g") == 0, 1).otherwise(-1)).alias("more")).where("more <> 0").isEmpty()


def _made(members: DataFrame) -> DataFrame:
    """``(g, comp, make)``: what the colours of a component's nodes add up to."""
    sums = members.groupBy("g", "comp").agg(*_lanes(F.xxhash64("colour")))
    return sums.select("g", "comp", F.concat_ws(" ", "low", "high", "rows").alias("make"))


def _unsettled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(g, comp, colour, size)`` of colours whose nodes still have to be told apart."""
    sizes = members.groupBy("g", "comp", "colour").agg(F.count("*").alias("size"))
    sized = members.join(sizes, ["g", "comp", "colour"])
    shared = sized.where("size > 1")
    ends = links.join(shared.select("g", F.col("node").alias("other")), ["g", "other"]).select("g", "node")
    return shared.join(ends.distinct(), ["g", "node"], "left_semi").select("g", "comp", "colour", "size").distinct()


def same_graph(first: DataFrame, second: DataFrame, max_picks: int = 100) -> bool:
    """Whether the graphs hold the same triples under some renaming of blank nodes.

    Triples are sets: repeated rows count once. True and False are exact; ``Undecided`` is raised where
    nodes with the same surroundings at every distance are not interchangeable after all, or where a
    component needs more than ``max_picks`` of them singled out. Two empty graphs are the same.
    """
    both = store(_short_names([first, second]).distinct())
    named = is_blank(F.col("s")) | is_blank(F.col("o"))
    if not _as_often(both.df.where(~named), TRIPLE) or not _as_often(both.df.where(named), ["p"]):
        return False
    around = _links(both.df.where(named))
    links = store(around.where(is_blank(F.col("other"))))
    ground = F.when(~is_blank(F.col("other")), F.col("other"))
    degrees = links.df.groupBy("g", F.col("other").alias("node")).agg(F.count("*").alias("n"))
    start = around.groupBy("g", "node").agg(*_lanes(F.xxhash64("way", "p", ground))).select(
        "g", "node", F.xxhash64("low", "high", "rows").alias("colour"))
    colours = store(start.join(degrees, ["g", "node"], "left").select(
        "g", "node", "colour", F.coalesce("n", F.lit(0)).alias("n")))
    if colours.empty:
        return True
    # A round keeps apart what differs already, so counts that differ now differ at the end.
    if not _as_often(colours.df, ["colour"]):
        return False
    colours = _refined(colours, links)
    if not _as_often(colours.df, ["colour"]):
        return False
    tag = F.concat(F.col("g").cast("string"), F.lit(" "), F.col("node"))
    other = F.concat(F.col("g").cast("string"), F.lit(" "), F.col("other"))
    alone = colours.df.select(tag.alias("s"), tag.alias("o"))
    comps = store(connected_components(links.df.select(tag.alias("s"), other.alias("o")).union(alone)).select(
        F.col("node").alias("tag"), F.col("canonical").alias("comp")))

    def members() -> Stored:
        return store(colours.df.withColumn("tag", tag).join(comps.df, "tag").drop("tag"))

    nodes, picks = members(), 0
    if not _as_often(_made(nodes.df), ["make"]):
        return False
    while True:
        open_ = store(_unsettled(nodes.df, links.df))
        if open_.empty:
            break
        if picks == max_picks:
            raise Undecided(f"more than {max_picks} nodes of a component had to be singled out")
        rarest = open_.df.groupBy("g", "comp").agg(F.min(F.struct("size", "colour")).alias("x")).select("g", "comp", "x.colour")
        chosen = nodes.df.join(rarest, ["g", "comp", "colour"]).groupBy("g", "comp").agg(F.min("node").alias("node"))
        picked = colours.df.join(chosen.select("g", "node", F.lit(True).alias("own")), ["g", "node"], "left")
        colours = _refined(store(picked.select(
            "g", "node", F.xxhash64("colour", F.coalesce("own", F.lit(False))).alias("colour"), "n")), links)
        nodes, picks = members(), picks + 1
    made = store(_made(nodes.df))
    coloured = nodes.df.join(made.side(), ["g", "comp"])
    # A number for each colour of a make, and how many nodes of either graph have it.
    numbers = store(coloured.groupBy("make", "colour").agg(*[
        F.sum((F.col("g") == g).cast("long")).alias(f"all{g}") for g in (0, 1)]).withColumn("id", F.monotonically_increasing_id()))
    ids = store(coloured.join(numbers.side(), ["make", "colour"]).select("g", "node", "id"))
    shown = both.df.where(named)
    for end in ("s", "o"):
        shown = shown.join(ids.side(ids.df.select("g", F.col("node").alias(end), F.col("id").alias(f"{end}_id"))), ["g", end], "left")
    shown = shown.select("g", "p", "s_id", "o_id", *[
        F.when(F.col(f"{end}_id").isNull(), F.col(end)).alias(end) for end in ("s", "o")])
    held = shown.groupBy("s", "s_id", "p", "o", "o_id").agg(*[F.sum((F.col("g") == g).cast("long")).alias(f"n{g}") for g in (0, 1)])
    # Each component of a make must hold the triple once for each node of the less single of its colours.
    for end in ("s", "o"):
        held = held.join(numbers.side(numbers.df.select(F.col("id").alias(f"{end}_id"), *[
            F.col(f"all{g}").alias(f"{end}_all{g}") for g in (0, 1)])), f"{end}_id", "left")
    uneven = (F.col("n0") != F.col("n1")) | (F.col("n0") != F.greatest("s_all0", "o_all0")) | (F.col("n1") != F.greatest("s_all1", "o_all1"))
    equal = held.where(uneven).isEmpty() and _as_often(made.df, ["make"])
    if not equal and picks:
        raise Undecided("nodes with the same surroundings are not interchangeable")
    return equal
