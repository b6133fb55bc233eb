"""What the operators on documents share: stored tables that can be dropped, and word columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.plans.workspace import Workspace

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables below ``spark.checkpoint.dir`` that one operator needs between its jobs.

    ``keep`` writes a table and reads it back, so that a lost executor costs a re-read. ``drop``
    deletes what later steps no longer read; what the result reads stays until the session's
    ``Workspace`` is released.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.workspace = Workspace.of(spark)
        self._names: dict[int, str] = {}

    def keep(self, df: DataFrame, buckets: int = 0, key: str = "") -> DataFrame:
        name = self.workspace.new_name()
        writer = df.write.format("parquet").option("compression", "zstd")
        if buckets:
            writer = writer.bucketBy(buckets, key)
        writer.saveAsTable(name)
        table = self.spark.table(name)
        self._names[id(table)] = name
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            name = self._names.pop(id(table), None)
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lowered(text: Column) -> Column:
    """Lower case for A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and characters beyond ASCII; none for null."""
    return F.array_remove(F.split(lowered(text), NO_WORD), "")


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")).cast("long")
