"""Intermediate tables: where a lineage is cut and how large a table is known to be.

Every loop of the engine writes each round to a table below the folder that the cluster names in
``spark.checkpoint.dir``. A lost executor then costs a re-read of files, never a re-run of earlier
rounds, and the plan of round *n* is as small as that of round 1. The tables live in a database of
their own, so ``release`` drops them and their files together.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codec of the intermediate tables: they are read a few times only, and terms of one kind are much alike.
CODEC = "zstd"

# Rows a side may have to be broadcast: three short strings each, so well below 100 MB.
BROADCAST_ROWS = 300_000


# With it, Spark deletes the shuffle files of an execution when that ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def own_shuffles(spark: SparkSession):
    """What is written inside leaves no shuffle files: only the written table is read again.

    Otherwise the files of all rounds stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class FixpointNotReached(RuntimeError):
    """A loop was still producing facts when its round limit was hit."""


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="kgweave-")
    spark.conf.set("kgweave.local.folder", folder)
    return folder


@dataclass(frozen=True)
class Stored:
    """A written table together with its exact row count."""

    df: DataFrame
    rows: int
    name: str | None = None

    @property
    def empty(self) -> bool:
        return self.rows == 0

    def side(self, df: DataFrame | None = None) -> DataFrame:
        """This table, or a selection of its rows, as a join side.

        Broadcast when the counted rows are few; otherwise left to a shuffled join, where the
        adaptive planner picks the strategy and splits skewed partitions.
        """
        df = self.df if df is None else df
        return F.broadcast(df) if self.rows <= BROADCAST_ROWS else df


class Workspace:
    """The tables of one session."""

    _open: dict[str, "Workspace"] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.database = "kgweave_" + uuid.uuid4().hex[:12]
        self._made = 0
        folder = spark.conf.get("kgweave.local.folder", None) or shared_folder(spark)
        path = f"{folder.rstrip('/')}/{self.database}".replace("'", "''")
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{path}'")

    @classmethod
    def of(cls, spark: SparkSession) -> "Workspace":
        app = spark.sparkContext.applicationId
        if app not in cls._open:
            cls._open[app] = cls(spark)
        return cls._open[app]

    def new_name(self) -> str:
        self._made += 1
        return f"{self.database}.t{self._made}"

    def store(self, df: DataFrame) -> Stored:
        name = self.new_name()
        with own_shuffles(self.spark):
            df.write.format("parquet").option("compression", CODEC).saveAsTable(name)
        table = self.spark.table(name)
        return Stored(table, table.count(), name)

    def drop(self, stored: Stored) -> None:
        """Delete a table that nothing reads any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {stored.name}")

    def release(self) -> None:
        """Drop all tables of this session; DataFrames that still read them become unusable."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
        self._open.pop(self.spark.sparkContext.applicationId, None)


def store(df: DataFrame) -> Stored:
    return Workspace.of(df.sparkSession).store(df)


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions: with any fewer, every join with a table shuffles the table."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class FactTable:
    """A growing, duplicate-free relation that remembers which rows the last round found.

    While it is small, a round is a plain table and the known rows are a broadcast side. Once it
    has outgrown that it becomes one table, bucketed by all columns and partitioned by the round:
    last round's rows are then a partition read, and "not known yet" is an anti-join to which the
    bucketed side brings its partitioning along, so that only new candidates are shuffled. All
    columns form the key, hence no bucket is larger than another because of a frequent term.

    ``large`` skips the small form where the input is known to be a whole graph.
    """

    COMPACT_AFTER = 6

    def __init__(self, spark: SparkSession, columns: list[str], large: bool = False):
        self.spark = spark
        self.columns = columns
        self.large = large
        self.rounds = 0
        self.rows = 0
        self.delta_rows = 0
        self._parts: list[DataFrame] = []
        self._name = Workspace.of(spark).new_name() if large else None
        self._delta: DataFrame | None = None
        self._base: DataFrame | None = None

    @property
    def known(self) -> DataFrame:
        if self.large:
            return self.spark.table(self._name).select(*self.columns)
        return union_all(self._parts)

    @property
    def delta(self) -> DataFrame:
        """Rows of the last round."""
        return self._delta

    @property
    def base(self) -> DataFrame:
        """Rows of the first round."""
        return self._base

    @property
    def first_round(self) -> bool:
        return self.rounds == 1

    def delta_side(self, df: DataFrame, fan_out: int = 1) -> DataFrame:
        """Rows made from the last round's, at most ``fan_out`` from each, as a join side.

        Broadcast when the counted rows allow it; otherwise left to a shuffled join.
        """
        return F.broadcast(df) if self.delta_rows * fan_out <= BROADCAST_ROWS else df

    def append(self, candidates: DataFrame) -> int:
        """Write the candidates that are new as the next round; returns how many there were."""
        fresh = candidates.select(*self.columns).distinct()
        if self.rounds:
            known = self.known if self.rows > BROADCAST_ROWS else F.broadcast(self.known)
            fresh = fresh.join(known, self.columns, "left_anti").select(*self.columns)
        if self.large:
            self._write_round(fresh, self.rounds)
            self._delta = self._round(self.rounds)
            self.delta_rows = self._delta.count()
        else:
            stored = store(fresh)
            self._delta, self.delta_rows = stored.df, stored.rows
            self._parts.append(stored.df)
        self.rows += self.delta_rows
        if self._base is None:
            self._base = self._delta
        self.rounds += 1
        if not self.large and self.rows > BROADCAST_ROWS:
            self._enlarge()
        elif len(self._parts) > self.COMPACT_AFTER:
            self._parts = [store(self.known).df]
        return self.delta_rows

    def restart(self, rows: DataFrame) -> int:
        """Begin with rows that carry a flag ``changed``; only the changed ones count as new.

        The others must be closed under the rules already. A row that comes both ways is old.
        """
        merged = rows.groupBy(*self.columns).agg(F.min("changed").alias("changed"))
        self._write_round(merged, F.col("changed").cast("int"))
        self._delta = self._round(1)
        self.delta_rows = self._delta.count()
        self._base = self._delta
        self.rows = self.known.count()
        self.rounds = 2
        return self.delta_rows

    def _round(self, number: int) -> DataFrame:
        return self.spark.table(self._name).where(F.col("found_in") == number).select(*self.columns)

    def _write_round(self, rows: DataFrame, number: int | Column) -> None:
        number = F.lit(number) if isinstance(number, int) else number
        with own_shuffles(self.spark):
            (
                rows.select(*self.columns, number.alias("found_in"))
                .write.format("parquet").option("compression", CODEC)
                .partitionBy("found_in")
                .bucketBy(bucket_count(self.spark), *self.columns)
                .mode("append")
                .saveAsTable(self._name)
            )

    def _enlarge(self) -> None:
        # The rows are distinct already: one exchange puts them into their buckets.
        rows = self.known.repartition(*self.columns)
        self._name = Workspace.of(self.spark).new_name()
        self._write_round(rows, 0)
        self.large = True
        self._parts = []


def run_to_fixpoint(table: FactTable, step, max_rounds: int | None = None) -> FactTable:
    """Feed each round's new rows to ``step`` until a round finds nothing.

    ``step(table)`` returns the candidate rows that follow from ``table.delta`` (with the rest of
    ``table.known``), or ``None`` when nothing can follow.
    """
    done = 0
    while table.delta_rows:
        candidates = step(table)
        if candidates is None:
            return table
        if max_rounds is not None and done == max_rounds:
            if candidates.join(table.known, table.columns, "left_anti").isEmpty():
                return table
            raise FixpointNotReached(f"no fixpoint after {max_rounds} rounds")
        table.append(candidates)
        done += 1
    return table


def union_all(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for df in frames[1:]:
        result = result.unionByName(df)
    return result


# Rows that a task of ``spread`` is dealt.
SPREAD_ROWS = 1_000_000


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` to as many tasks as keep the rows of each few.

    What then meets equal rows by these keys needs no further shuffle, and a task that reads a file keeps none of
    its rows in memory, which would spill where files are large. The keys must not hold a very frequent value.
    """
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SPREAD_ROWS))
    return df.repartition(tasks, *keys)
