"""The growing fact table of triples, laid out by round and by predicate.

Predicates fall into ``GROUPS`` groups by a hash that the driver can compute too, and ``rdf:type`` has one
to itself. A rule that asks for some predicates gives them as literals; they prune the partitions and reach
the scan as ``p IN (...)``, so a round does not read triples that none of its rules asks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.functions.terms import TRIPLE, TYPE
from kgweave.plans.workspace import BROADCAST_ROWS, CODEC, FactTable, Stored, Workspace, own_shuffles, union_all

GROUPS = 32
# Rows that one shuffle of a round may hold, and the most shuffles, one after the other, that a round is dealt to.
SLICE_ROWS, MOST_SLICES = 100_000_000, 4


def group_column(p: Column) -> Column:
    return F.when(p == TYPE, GROUPS).otherwise(F.crc32(p.cast("binary")) % GROUPS).cast("int")


def group_of(predicate: str) -> int:
    return GROUPS if predicate == TYPE else zlib.crc32(predicate.encode()) % GROUPS


def _slices(rows: int) -> list[Callable[[DataFrame], DataFrame]]:
    """Selections of triples that share none and together are all: as many as keep the shuffle of each small.

    The files of a shuffle are deleted when its part is written, so they never lie on disk all at once.
    """
    n = max(1, min(MOST_SLICES, -(-rows // SLICE_ROWS)))
    if n == 1:
        return [lambda df: df]
    return [lambda df, i=i: df.where(F.pmod(F.xxhash64(*TRIPLE), F.lit(n)) == i) for i in range(n)]


class TripleTable(FactTable):
    """A ``FactTable`` of triples that can be read by predicate.

    After the first round candidates are stored first. What is known is then read only in the groups
    that the candidates fall into, and where these are few they are the broadcast side of the
    "not known yet" test, so that known triples are neither shuffled nor sorted.

    There are no buckets: with a file for each round, group and bucket, opening files would take longer
    than any rule, whatever the size. A task of a round writes one file for each group it has rows of.
    """

    def __init__(self, spark: SparkSession):
        super().__init__(spark, TRIPLE, large=True)
        self._new_groups: set[int] = set()
        self._passing: list[Stored] = []

    @property
    def derived(self) -> DataFrame:
        """Known triples but those that ``begin`` was told are given."""
        return self.spark.table(self._name).where("NOT given").select(*TRIPLE)

    def passing(self, stored: Stored) -> Stored:
        """A table that only the next round's candidates read: dropped once they are appended."""
        self._passing.append(stored)
        return stored

    def begin(self, given: DataFrame, more: list[DataFrame]) -> int:
        """The first round: a graph, and what else is known; a triple that comes both ways is given."""
        rows = [given.select(*TRIPLE, F.lit(True).alias("given"))]
        rows += [df.select(*TRIPLE, F.lit(False).alias("given")) for df in more]
        every = union_all(rows)
        self._add([part(every).groupBy(*TRIPLE).agg(F.max("given").alias("given")) for part in _slices(given.count())])
        return self.delta_rows

    def asked(self, predicates: list[str] | None, new: bool = False) -> DataFrame:
        """Known triples, or those of the last round, with one of the predicates; None stands for any."""
        table = self.spark.table(self._name)
        if new:
            table = table.where(F.col("found_in") == self.rounds - 1)
        if predicates is not None:
            groups = sorted({group_of(p) for p in predicates})
            table = table.where(F.col("grp").isin(groups) & F.col("p").isin(list(predicates)))
        return table.select(*TRIPLE)

    def has_new(self, predicates: list[str] | None) -> bool:
        """Whether the last round may hold such triples; no means no."""
        return bool(self._new_groups) if predicates is None else any(group_of(p) in self._new_groups for p in predicates)

    def append(self, candidates: DataFrame) -> int:
        candidates = candidates.select(*TRIPLE).distinct()
        if not self.rounds:
            self._add([candidates])
            return self.delta_rows
        name = Workspace.of(self.spark).new_name()
        with own_shuffles(self.spark):
            candidates.write.format("parquet").option("compression", CODEC).saveAsTable(name)
        stored = self.spark.table(name)
        counts = stored.groupBy(group_column(F.col("p")).alias("grp")).count().collect()
        known = self.spark.table(self._name).where(F.col("grp").isin([r.grp for r in counts])).select(*TRIPLE)
        if sum(r["count"] for r in counts) <= BROADCAST_ROWS:
            old = known.join(F.broadcast(stored), TRIPLE, "left_semi")
            fresh = [stored.join(F.broadcast(old), TRIPLE, "left_anti")]
        else:
            fresh = [part(stored).join(part(known), TRIPLE, "left_anti") for part in _slices(self.rows)]
        self._add([df.select(*TRIPLE) for df in fresh])
        self.spark.sql(f"DROP TABLE {name}")
        while self._passing:
            Workspace.of(self.spark).drop(self._passing.pop())
        return self.delta_rows

    def _add(self, fresh: list[DataFrame]) -> None:
        """Write a round, whose parts share no row, one part after the other."""
        for part in fresh:
            self._write_round(part, self.rounds)
        self._delta = self._round(self.rounds)
        counts = (self.spark.table(self._name).where(F.col("found_in") == self.rounds)
                  .groupBy("grp").count().collect())
        self._new_groups = {r.grp for r in counts}
        self.delta_rows = sum(r["count"] for r in counts)
        self.rows += self.delta_rows
        if self._base is None:
            self._base = self._delta
        self.rounds += 1

    def _write_round(self, rows: DataFrame, number: int) -> None:
        given = F.col("given") if "given" in rows.columns else F.lit(False).alias("given")
        with own_shuffles(self.spark):
            (
                rows.select(*TRIPLE, given, F.lit(number).alias("found_in"), group_column(F.col("p")).alias("grp"))
                .write.format("parquet").option("compression", CODEC)
                .partitionBy("found_in", "grp")
                .mode("append")
                .saveAsTable(self._name)
            )
