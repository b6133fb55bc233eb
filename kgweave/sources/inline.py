"""Small constant relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def inline(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Rows of strings as an inline table, which the optimizer can fold, prune and size."""
    if not rows:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))

    def quote(value):
        if value is None:
            return "CAST(NULL AS STRING)"
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def triples(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return inline(spark, rows, ["s", "p", "o"])
