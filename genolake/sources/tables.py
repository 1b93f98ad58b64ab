"""Tables of a catalogue: made anew, added to, and asked by a condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_table(rows: DataFrame, name: str, path: str | None = None) -> None:
    """The table holds these rows and nothing else afterwards."""
    rows.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    writer = rows.write.format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def insert_rows(rows: DataFrame, name: str) -> None:
    """Add rows, their columns matched by name."""
    target = rows.sparkSession.table(name)
    rows.select(*target.columns).write.insertInto(name)


def rows_where(spark: SparkSession, name: str, column: str, value) -> DataFrame:
    return spark.table(name).filter(F.col(column) == F.lit(value))
