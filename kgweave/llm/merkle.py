"""Merkle manifest of a table, with proofs for any set of its rows.

Leaves stand in the order of their keys, one tree per group and one tree over the groups' roots. An
inner node is the hash of up to two consecutive nodes; the last one of a level may have one child only.

**Positions.** The rows' digests are sorted over all tasks (``repartitionByRange`` by group and key, so
a group with a third of all rows is spread like any other), written, and numbered by adding the counts
of the parts before. Only digests and keys are shuffled, never the rows themselves.

**Nodes.** ``BLOCK`` consecutive leaves of a group form a leaf partition. A leaf partition is
hashed ``HEIGHT`` levels; the partitions' roots are the leaves of the next round. A round divides the
number of nodes by ``BLOCK``, so a group of 10^12 leaves takes four rounds.

**Octopus multiproof.** Each leaf partition works out which node coordinates the proofs of its wanted
leaves need and cannot be derived from these leaves: the minimal union, every coordinate once. It fetches
them once in one join, derives the inner nodes that its proofs share, and expands them to one proof per leaf
locally. All of it is array functions over a partition's bounded list of leaves. Coordinates near a root are wanted by many partitions but are few, so their nodes are a broadcast
side (at most ``TOP_NODES``, counted); coordinates further down are wanted by a bounded number of partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgweave.llm.tables import Scratch

HEIGHT = 10
BLOCK = 1 << HEIGHT
TOP_NODES = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(column: Column) -> Column:
    """``-`` for null, otherwise the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: Column) -> Column:
    """Lower-case hex SHA-256 of the fields of a row."""
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def _levels(size: str) -> str:
    """The numbers of the levels below the root of a tree, as an array; none for a lone leaf."""
    return f"filter(sequence(0, 63), l -> l < 63 AND shiftright({size} - 1, l) > 0)"


def _node(left: str, right: str) -> str:
    return f"sha2(concat({left}, coalesce({right}, '')), 256)"


def numbered(rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """A stored table of ``rows`` with ``pos``, the place from 0 within its group, and ``size``, the group's rows.

    The sort is over all tasks; a group's rows may lie in any number of them.
    """
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    stored = scratch.keep(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()))
    # a row per group and part; a part holds the rows of several groups or one group several parts
    parts = stored.groupBy(F.col(group).alias("_own"), F.col("_part").alias("_at")).agg(
        F.min("_nth").alias("_first"), F.count("*").alias("_rows"))
    ahead = Window.partitionBy("_own").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "*", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("_own")).alias("size"))
    return (
        stored.join(parts, F.col(group).eqNullSafe(F.col("_own")) & (F.col("_part") == F.col("_at")))
        .withColumn("pos", F.col("_nth") - F.col("_first") + F.col("_before"))
        .drop("_own", "_at", "_part", "_nth", "_first", "_rows", "_before")
    )


def _grown(digests: str, levels: str) -> str:
    """The levels of a block from its digests on, each an array of nodes."""
    last = "element_at(found, -1)"
    pair = _node(f"get({last}, 2 * j)", f"get({last}, 2 * j + 1)")
    return (f"aggregate({levels}, array({digests}), (found, up) -> "
            f"concat(found, array(transform(sequence(0, (size({last}) - 1) div 2), j -> {pair}))))")


def inner_nodes(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """All nodes ``(tree, size, level, pos, digest)`` of the trees over ``(tree, size, pos, digest)``, leaves included."""
    level, parts = 0, []
    nodes = scratch.keep(leaves.select("tree", "size", F.lit(0).alias("level"), "pos", "digest"))
    while True:
        parts.append(nodes)
        open_ = nodes.where((F.col("level") == level) & (F.col("size") > F.lit(1 << level)))
        if open_.isEmpty():
            break
        # up to the block's root, or to the tree's where that comes first
        wanted = f"filter(sequence(1, {HEIGHT}), up -> shiftright(size - 1, {level} + up - 1) > 0)"
        blocks = open_.groupBy("tree", "size", F.shiftright("pos", HEIGHT).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("own"))
        grown = blocks.select("tree", "size", "block", F.expr(_grown("own.digest", wanted)).alias("found"))
        nodes = scratch.keep(
            grown.select("tree", "size", "block", F.posexplode("found").alias("up", "row")).where("up > 0")
            .select("tree", "size", "block", "up", F.posexplode("row").alias("i", "digest"))
            .select("tree", "size", (F.col("up") + F.lit(level)).alias("level"),
                    F.expr(f"shiftright(block * {BLOCK}L, up) + i").alias("pos"), "digest"))
        level += HEIGHT
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def roots(nodes: DataFrame) -> DataFrame:
    """``(tree, size, digest)`` of each tree."""
    top = F.expr("pos = 0 AND shiftleft(1L, level) >= size AND (level = 0 OR shiftleft(1L, level - 1) < size)")
    return nodes.where(top).select("tree", "size", "digest")


def missing(wanted: str, size: str) -> str:
    """The ``(level, pos)`` that proofs of the wanted positions need and that these do not yield, each once.

    Both arguments are SQL: an array of positions, and the leaves of the tree.
    """
    have = f"transform({wanted}, p -> shiftright(p, l))"
    siblings = f"array_except(transform({have}, p -> p ^ 1L), {have})"
    inside = f"filter({siblings}, p -> p <= shiftright({size} - 1, l))"
    return f"flatten(transform({_levels(size)}, l -> transform({inside}, p -> struct(l AS level, p AS pos))))"


def _nodes_by_level(leaves: str, fetched: str, size: str) -> str:
    """Per level a map from position to node: what is fetched, and what the leaves and these yield."""
    def level(number: str, own: str) -> str:
        got = f"transform(filter({fetched}, f -> f.level = {number}), f -> struct(f.at, f.node))"
        return f"map_from_entries(concat({own}, {got}))"

    below = "element_at(found, -1)"
    derived = (f"transform(array_distinct(transform({leaves}, w -> shiftright(w.pos, l + 1))), p -> struct(p AS at, "
               f"{_node(f'element_at({below}, 2 * p)', f'element_at({below}, 2 * p + 1)')} AS node))")
    first = level("0", f"array_distinct(transform({leaves}, w -> struct(w.pos AS at, w.digest AS node)))")
    return f"aggregate({_levels(size)}, array({first}), (found, l) -> concat(found, array({level('l + 1', derived)})), "


def expanded(leaves: str, fetched: str, size: str) -> str:
    """Each leaf with its ``proof``: the sibling at every level up to the root, empty where there is none.

    ``leaves`` and ``fetched`` are arrays of structs ``(pos, digest, presented)`` and ``(level, at, node)``. Inner nodes
    that several proofs share are hashed once.
    """
    sibling = "coalesce(element_at(found[l], shiftright(w.pos, l) ^ 1L), '')"
    proof = f"transform({_levels(size)}, l -> {sibling})"
    return (_nodes_by_level(leaves, fetched, size)
            + f"found -> transform({leaves}, w -> struct(w.pos, w.digest, w.presented, {proof} AS proof)))")


def climbed(digest: str, pos: str, proof: str) -> str:
    """The root that follows from a digest at a position and its siblings."""
    step = f"CASE WHEN shiftright({pos}, step.l) % 2 = 1 THEN concat(step.h, at) ELSE concat(at, step.h) END"
    return (f"aggregate(transform({proof}, (h, l) -> struct(h, l)), {digest}, (at, step) -> sha2({step}, 256))")


@dataclass(frozen=True)
class Manifest:
    """Trees of a table: ``leaves`` (the rows' columns, tree, size, pos, digest) and all ``nodes``.

    ``subroots`` (group, tree, digest) are the leaves of the tree numbered ``TOP``, whose root is ``root``.
    """

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    subroots_number: int
    root: str | None
    scratch: Scratch


TOP = -1  # number of the tree over the groups' roots; those of the groups follow from 0


def build(rows: DataFrame, group: str, order: list[str]) -> Manifest:
    """The manifest of ``rows`` with a column ``digest``; ``group`` may be null, ``order`` sorts within it.

    Rows that are alike in ``order`` stand by digest. Nulls come first. Without rows there is no root.
    """
    scratch = Scratch(rows.sparkSession)
    rows = scratch.keep(rows)
    placed = numbered(rows, group, [*order, "digest"], scratch)
    sizes = scratch.keep(placed.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_size")))
    trees = scratch.keep(
        numbered(sizes.withColumn("_all", F.lit(0)), "_all", ["_group"], scratch)
        .select("_group", F.col("pos").alias("tree")))
    leaves = scratch.keep(placed.join(trees, F.col(group).eqNullSafe(F.col("_group"))).drop("_group"))
    scratch.drop(rows)
    below = inner_nodes(leaves, scratch)
    number = sizes.count()
    subroots = scratch.keep(roots(below).join(trees, "tree").select(F.col("_group").alias(group), "tree", "digest"))
    above = inner_nodes(subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(number).cast("long").alias("size"), F.col("tree").alias("pos"),
        "digest"), scratch)
    root = roots(above).first()
    return Manifest(leaves, below.unionByName(above), subroots, number, root.digest if root else None, scratch)


def prove(manifest: Manifest, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows ``(tree, size, pos, digest, presented)`` with ``proof_sha256`` and ``folded_root``.

    The proof belongs to the manifest's leaf ``digest``; the folded root is recomputed from the digest
    ``presented`` for it. Any set of leaves may be wanted.
    """
    top, scratch = manifest.subroots_number, manifest.scratch
    parts = scratch.keep(
        wanted.groupBy("tree", "size", F.shiftright("pos", HEIGHT).alias("block"))
        .agg(F.collect_list(F.struct("pos", "digest", "presented")).alias("leaves")))
    own = f"transform({missing('leaves.pos', 'size')}, c -> struct(tree AS in_tree, c.level, c.pos))"
    above = f"transform({missing('array(tree)', f'{top}L')}, c -> struct({TOP}L AS in_tree, c.level, c.pos))"
    asked = scratch.keep(parts.select("tree", "block", F.expr(f"inline(concat({own}, {above}))")))
    # level l of a tree is asked for by at most 2 ** (l - HEIGHT) partitions below it: split where few nodes are left
    nodes = manifest.nodes.select(F.col("tree").alias("in_tree"), "level", "pos", F.col("digest").alias("node"))
    counts = {r.level: r.n for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}
    cut = next(level for level in range(max(counts, default=0) + 2)
               if sum(n for at, n in counts.items() if at >= level) <= TOP_NODES)
    high = (F.col("level") >= cut) | (F.col("in_tree") == TOP) if top <= TOP_NODES // 2 else F.col("level") >= cut
    keys = ["in_tree", "level", "pos"]
    fetched = asked.where(high).join(F.broadcast(nodes.where(high)), keys).unionByName(
        asked.where(~high).join(nodes.where(~high), keys))
    fetched = scratch.keep(fetched.groupBy("tree", "block").agg(
        F.collect_list(F.struct("in_tree", "level", F.col("pos").alias("at"), "node")).alias("fetched")))
    nothing = "CAST(array() AS array<struct<in_tree: bigint, level: int, at: bigint, node: string>>)"
    joined = parts.join(fetched, ["tree", "block"], "left").select(
        "tree", "size", "leaves", F.expr(f"filter(coalesce(fetched, {nothing}), f -> f.in_tree = tree)").alias("below"),
        F.expr(f"map_from_entries(transform(filter(coalesce(fetched, {nothing}), f -> f.in_tree = {TOP}), "
               "f -> struct(f.level, f.node)))").alias("above"))
    proofs = joined.select(
        "tree", F.expr(f"transform({_levels(f'{top}L')}, l -> coalesce(element_at(above, l), ''))").alias("above"),
        F.expr(f"inline({expanded('leaves', 'below', 'size')})"))
    subroot = climbed("presented", "pos", "proof")
    return proofs.select(
        "tree", "pos", "digest", F.expr("sha2(array_join(concat(proof, above), ''), 256)").alias("proof_sha256"),
        F.expr(climbed(subroot, "tree", "above")).alias("folded_root"))


def manifest_of(docs: DataFrame) -> tuple[Manifest, DataFrame]:
    """The manifest of ``documents`` rows by ``lang``, and each row with its proof.

    The rows carry ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and
    ``verified``. A row presents its own digest, or that of a row with ``n_chars`` one higher where 7
    divides the crc32 of its id. Nulls count as such in the digest; a null id is never tampered with,
    a null ``n_chars`` stays null under tampering. Null languages form a group of their own, the first.
    Rows with the same id stand by digest; equal rows are equal leaves, each with its own proof. Other
    columns are not read. An empty table gives no rows.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    fields = [F.col(c) for c in FIELDS]
    longer = [F.col(c) + F.lit(1).cast("long") if c == "n_chars" else F.col(c) for c in FIELDS]
    rows = docs.select(
        "doc_id", F.col("lang").alias("_lang"), digest(*fields).alias("digest"),
        F.when(tampered & F.col("n_chars").isNotNull(), digest(*longer)).alias("_other"))
    manifest = build(rows, "_lang", ["doc_id"])
    presented = manifest.leaves.select(
        "tree", "size", "pos", "digest", F.coalesce("_other", "digest").alias("presented"), "doc_id")
    proofs = prove(manifest, presented.drop("doc_id")).select("tree", "pos", "proof_sha256", "folded_root")
    subroots = manifest.subroots.select("tree", F.col("digest").alias("subroot"))
    root = F.lit(manifest.root).cast("string")
    return manifest, (
        presented.join(proofs, ["tree", "pos"]).join(subroots, "tree")
        .select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root",
                (F.col("folded_root") == root).alias("verified")))
