"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.plans.workspace import store

# A key is heavy when it holds more than 1/HEAVY_SHARE of the rows. The counts add up to the
# number of rows, so there can never be more than HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1000


def join_counted(rows: DataFrame, summary: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``summary``, which has one row per key.

    ``summary`` carries in column ``n`` how many of the ``total`` rows have its key. The few heavy
    keys are broadcast, so their rows stay where they are; all others meet in a shuffled join.
    """
    limit = max(1, total // HEAVY_SHARE)
    heavy = F.broadcast(summary.where(F.col("n") > limit))
    light = summary.where(F.col("n") <= limit)
    spread = rows.join(heavy, keys)
    even = rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys)
    return spread.unionByName(even)


# Rows of one key that a task may hold on either side before the key is split.
HEAVY_ROWS = 100_000


def join_split(left: DataFrame, right: DataFrame, keys: list[str], rows: int, heavy_rows: int | None = None) -> DataFrame:
    """Inner join in which a frequent key is dealt to many tasks, whichever side it is frequent on.

    A key with m rows on the left and n on the right becomes a grid of about m/h times n/h cells, h being
    ``heavy_rows`` or more: a left row goes to one grid row, all columns of it, a right row to one grid
    column. A key is heavy beyond h rows on a side, and h is at least 1/HEAVY_SHARE of ``rows``, the number
    of rows of the longer side or more; so at most 2 * HEAVY_SHARE heavy keys are broadcast. All others meet
    in a plain shuffled join. Null keys match nothing. Both sides are read more than once: pass stored ones.
    """
    limit = max(HEAVY_ROWS if heavy_rows is None else heavy_rows, rows // HEAVY_SHARE)

    def frequent(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > limit)

    heavy = store(frequent(left, "_m").join(frequent(right, "_n"), keys, "full").dropna(subset=keys).select(
        *keys, *[F.ceil(F.coalesce(F.col(n), F.lit(1)) / limit).cast("int").alias(c) for n, c in (("_m", "_rows"), ("_n", "_columns"))]))
    if heavy.empty:
        return left.join(right, keys)
    grid = F.broadcast(heavy.df)
    names = F.broadcast(heavy.df.select(*keys))

    def cells(df: DataFrame, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*df.columns), F.col(own))
        spread = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return df.join(grid, keys).withColumn("_own", place.cast("int")).withColumn("_other", spread).drop("_rows", "_columns") \
            .withColumnsRenamed({"_own": f"{own}_at", "_other": f"{other}_at"})

    split = cells(left, "_rows", "_columns").join(
        cells(right, "_columns", "_rows"), [*keys, "_rows_at", "_columns_at"]).drop("_rows_at", "_columns_at")
    even = left.join(names, keys, "left_anti").join(right.join(names, keys, "left_anti"), keys)
    return even.unionByName(split)
