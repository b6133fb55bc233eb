"""Transitive closure and generic fixpoints.

``doubling`` composes what is known with itself, so a path of length n needs about log2(n) rounds;
``linear`` extends the last round by one base edge, which derives fewer duplicates on shallow data.
Both are semi-naive and give the same pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.functions.terms import TRIPLE
from kgweave.plans.skew import join_split
from kgweave.plans.workspace import BROADCAST_ROWS, FactTable, Stored, run_to_fixpoint, spread, store


TINY_ROWS = 5_000


class EmptyPropertyList(ValueError):
    pass


def compose(left: DataFrame, right: DataFrame, group: list[str], rows: int = 0) -> DataFrame:
    """Pairs (a, c) with (a, b) on the left and (b, c) on the right, inside the same group.

    ``rows`` bounds either side where both are large and stored; nodes with many links are then split.
    """
    first = left.select(*group, F.col("s"), F.col("o").alias("mid"))
    second = right.select(*group, F.col("s").alias("mid"), F.col("o"))
    keys = [*group, "mid"]
    joined = join_split(first, second, keys, rows) if rows else first.join(second, keys)
    return joined.select(*group, "s", "o")


@dataclass(frozen=True)
class Closed:
    """A closed relation and its number of rows."""

    known: DataFrame
    rows: int


def close_into_table(pairs: DataFrame, group: list[str], strategy: str = "doubling",
                     max_rounds: int | None = None) -> Closed | FactTable:
    """The closure of ``(*group, s, o)``.

    Nodes that nothing leads to, such as the leaves of a hierarchy, are in the middle of no path. A large
    relation is closed without them; they then take over in one join what their next nodes reach, so that
    no round compares new pairs with theirs.
    """
    if max_rounds is not None:
        return _close_in_rounds(pairs, group, strategy, max_rounds)
    edges = store(pairs.select(*group, "s", "o").distinct())
    if edges.rows <= TINY_ROWS:
        return _close_in_rounds(edges.df, group, strategy)
    ends = edges.df.select(*group, F.col("o").alias("s"))
    inner = store(edges.df.select(*group, "s").intersect(ends))
    keys = [*group, "s"]
    core = _close_in_rounds(edges.df.join(inner.side(), keys, "left_semi"), group, strategy)
    first = store(edges.df.join(inner.side(), keys, "left_anti").select(*group, "s", "o"))
    reached = first.df
    if core.rows and not first.empty:
        rows = 0 if core.rows <= BROADCAST_ROWS else max(core.rows, first.rows)
        on = Stored(core.known, core.rows).side() if not rows else core.known
        reached = store(first.df.union(compose(first.df, on, group, rows)).distinct()).df
    return Closed(core.known.unionByName(reached), core.rows + reached.count())


def _close_in_rounds(pairs: DataFrame, group: list[str], strategy: str, max_rounds: int | None = None) -> FactTable:
    if strategy not in ("doubling", "linear"):
        raise ValueError(f"unknown closure strategy {strategy!r}")
    table = FactTable(pairs.sparkSession, [*group, "s", "o"])
    table.append(pairs)

    def step(t: FactTable) -> DataFrame:
        delta = t.delta_side(t.delta)
        rows = t.rows if t.delta_rows > BROADCAST_ROWS else 0
        if strategy == "linear" and not t.first_round:
            return compose(delta, t.base, group, rows)
        if t.first_round:
            found = compose(t.known, delta, group, rows)
        else:
            found = compose(delta, t.known, group, rows).union(compose(t.known, delta, group, rows))
        if strategy == "doubling" and max_rounds is None and t.rows <= TINY_ROWS:
            # On a terminology a second doubling costs less than another round's jobs. Where rounds
            # are limited, each is one composition at every size.
            wider = t.known.union(found).distinct()
            found = found.union(compose(wider, wider, group))
        return found

    return run_to_fixpoint(table, step, max_rounds)


def closure(pairs: DataFrame, strategy: str = "doubling",
            max_rounds: int | None = None) -> DataFrame:
    """Transitive closure of ``(s, o)``; a cycle makes its members reach themselves."""
    return close_into_table(pairs, [], strategy, max_rounds).known


def closure_by_group(rows: DataFrame, group: str, strategy: str = "doubling",
                     max_rounds: int | None = None) -> DataFrame:
    """Closure of ``(group, s, o)`` within each group, all groups in one loop."""
    return close_into_table(rows, [group], strategy, max_rounds).known


def closure_of_predicate(graph: DataFrame, predicate: str, strategy: str = "doubling") -> DataFrame:
    pairs = graph.where(F.col("p") == predicate).select("s", "o")
    return closure(pairs, strategy).select("s", F.lit(predicate).alias("p"), "o")


def transitive_reasoner(graph: DataFrame, properties: list[str],
                        strategy: str = "doubling") -> DataFrame:
    """The graph plus the closure of each listed property."""
    if not properties:
        raise EmptyPropertyList("list the properties to close")
    rows = graph.where(F.col("p").isin(properties))
    closed = close_into_table(rows.select("p", "s", "o"), ["p"], strategy).known
    rest = graph.where(~F.col("p").isin(properties))
    rest = spread(rest.select(*TRIPLE), TRIPLE, rest.count()).distinct()
    return rest.unionByName(closed.select(*TRIPLE))


def fixpoint(df: DataFrame, step, max_rounds: int | None = None, by_rows: bool = False) -> DataFrame:
    """``df`` united with ``step(known)`` again and again until nothing is new.

    ``step`` gets the whole relation each round; exceeding ``max_rounds`` raises. ``by_rows`` says that each of
    its results follows from one row of the relation, as in a join with a fixed table: then a round gets
    the last round's rows only, as those before have given theirs.
    """
    table = FactTable(df.sparkSession, df.columns)
    table.append(df)
    return run_to_fixpoint(table, lambda t: step(t.delta_side(t.delta) if by_rows else t.known), max_rounds).known


def fixpoint_of_new(df: DataFrame, step, max_rounds: int | None = None) -> DataFrame:
    """``df`` united with what follows from it, where each round derives from the last round's rows only.

    ``step(new, known)`` gets the rows that the last round found and all rows, these included, and must return
    at least what follows from known rows of which one or more are new. ``new`` is marked for broadcast where
    its counted rows allow it. ``known`` is bucketed by its columns once it is large, so a round shuffles its
    candidates and not the relation. Duplicates may be returned; exceeding ``max_rounds`` raises.
    """
    table = FactTable(df.sparkSession, df.columns)
    table.append(df)
    return run_to_fixpoint(table, lambda t: step(t.delta_side(t.delta), t.known), max_rounds).known
