"""Read-quality reports as long tables (dataset, module, ...) and their pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(quality: DataFrame) -> DataFrame:
    return quality.groupBy("dataset").agg(F.sum("n").alias("total"))


def quality_pivot(quality: DataFrame, most: int = 50, percent: bool = False) -> DataFrame:
    """Sequences per mean quality 1..most, one column each; the columns are known, so no pass looks for them."""
    cells = [F.coalesce(F.sum(F.when(F.col("quality") == q, F.col("n"))), F.lit(0)).alias(f"q{q}") for q in range(1, most + 1)]
    wide = quality.groupBy("dataset").agg(F.sum("n").alias("total"), *cells)
    if percent:
        return wide.select("dataset", *[F.round(F.try_divide(100.0 * F.col(f"q{q}"), F.col("total")), 6).alias(f"q{q}") for q in range(1, most + 1)])
    return wide.drop("total")


def length_bins(lengths: DataFrame) -> DataFrame:
    """Length classes "a-b" by their lower end, with 0 where a dataset has none."""
    low = lengths.select("dataset", F.element_at(F.split("length", "-"), 1).cast("int").alias("length"), "n")
    grid = low.select("dataset").distinct().crossJoin(low.select("length").distinct())
    return grid.join(low.groupBy("dataset", "length").agg(F.sum("n").alias("n")), ["dataset", "length"], "left").select("dataset", "length", F.coalesce("n", F.lit(0)).alias("n"))


def padded(series: DataFrame) -> DataFrame:
    """Values by position for every dataset; shorter runs are padded with 0 at the end."""
    ends = series.agg(F.max("position").alias("last"))
    grid = series.select("dataset").distinct().crossJoin(F.broadcast(ends)).select("dataset", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("position"))
    return grid.join(series, ["dataset", "position"], "left").select("dataset", "position", F.coalesce("value", F.lit(0.0)).alias("value"))


def parse_report(text: DataFrame) -> DataFrame:
    """(dataset, text) of whole reports to long cells: module, row, column name and value."""
    modules = text.select("dataset", F.posexplode(F.split("text", "(?m)^>>")).alias("k", "body")).filter("k > 0 and not startswith(body, 'END_MODULE')")
    lines = modules.select("dataset", "k", F.filter(F.split("body", "\n"), lambda x: x != "").alias("lines"))
    head = lines.select("dataset", F.translate(F.element_at(F.split(F.element_at("lines", 1), "\t"), 1), " ", "_").alias("module"), F.slice("lines", 2, F.size("lines")).alias("rows"))
    # Of several comment lines (as in the duplication module) the last one holds the names.
    names = F.element_at(F.filter("rows", lambda x: F.startswith(x, F.lit("#"))), -1)
    named = head.filter(F.size(F.filter("rows", lambda x: F.startswith(x, F.lit("#")))) > 0).select("dataset", "module", F.split(F.substring(names, F.lit(2), F.length(names)), "\t").alias("names"), F.posexplode(F.filter("rows", lambda x: ~F.startswith(x, F.lit("#")))).alias("row", "line"))
    cells = named.select("dataset", "module", "row", F.posexplode(F.arrays_zip("names", F.split("line", "\t").alias("values"))).alias("col", "cell"))
    return cells.select("dataset", "module", "row", F.col("cell.names").alias("name"), F.col("cell.values").alias("value"), F.expr("try_cast(cell.values AS DOUBLE)").alias("number"))
