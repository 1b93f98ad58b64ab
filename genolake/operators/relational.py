"""Plain table operations with the meaning that the file tools give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_named(rows: DataFrame, names: DataFrame, on: str) -> DataFrame:
    return rows.join(names.select(on), on, "left_semi")


def drop_named(rows: DataFrame, names: DataFrame, on: str) -> DataFrame:
    return rows.join(names.select(on), on, "left_anti")


def override(rows: DataFrame, new: DataFrame, on: str, column: str, by: str) -> DataFrame:
    """``column`` takes the value of ``by`` where the other table has one."""
    return rows.join(new.select(on, by), on, "left").withColumn(column, F.coalesce(by, column)).drop(by)


def first_occurrences(rows: DataFrame, on: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*on).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def zip_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by record number; names must agree up to the first space."""
    both = first.join(second, "file_pos")
    same = F.substring_index("read_id1", " ", 1) == F.substring_index("read_id2", " ", 1)
    return both.withColumn("name", F.when(same, F.substring_index("read_id1", " ", 1)).otherwise(F.raise_error(F.concat(F.lit("mates differ: "), "read_id1", F.lit(" / "), "read_id2")).cast("string")))


def sample_union(files: DataFrame, kinds: tuple[str, ...] = ("phenotype", "genotype")) -> DataFrame:
    """Every sample of several files with its place in each file and its place in the union: phenotypes first, by first appearance.

    files: (kind, subgroup, sample, pos).
    """
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    first = files.groupBy("sample").agg(F.min(F.struct(rank.alias("kind"), "subgroup", "pos")).alias("first"))
    return files.select("sample", "kind", "subgroup", "pos").join(first, "sample")


def samples_in_order(files: DataFrame, kinds: tuple[str, ...] = ("phenotype", "genotype")) -> DataFrame:
    """(sample, place): the union's samples counted from 0; file by file, so no window sees the samples of two files."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    first = files.groupBy("sample").agg(F.min(F.struct(rank.alias("kind"), "subgroup", "pos")).alias("first")).select("sample", "first.*")
    sizes = first.groupBy("kind", "subgroup").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("kind", "subgroup").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per file
    own = F.row_number().over(Window.partitionBy("kind", "subgroup").orderBy("pos", "sample")) - 1
    return first.withColumn("own", own).join(before, ["kind", "subgroup"]).select("sample", (F.col("own") + F.col("before")).alias("place"))


def aligned(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Both tables by name; a different number of names, or a name without its like, is an error."""
    both = left.join(right, on, "full_outer")
    names = left.select(on).distinct().withColumn("_l", F.lit(1)).join(right.select(on).distinct().withColumn("_r", F.lit(1)), on, "full_outer")
    alone = names.agg(F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("_alone"))
    checked = both.crossJoin(F.broadcast(alone))  # one row
    return checked.filter(F.coalesce(F.assert_true(F.col("_alone") == 0, "names differ between the tables").cast("boolean"), F.lit(True))).drop("_alone")


def union_distinct(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def out_of_order(rows: DataFrame, group: str, pos: str, key: str) -> DataFrame:
    """Rows of a group whose ``key`` is smaller than that of the row before them; none means sorted."""
    before = F.lag(key).over(Window.partitionBy(group).orderBy(pos))
    return rows.withColumn("before", before).filter(F.col(key) < F.col("before"))


def without_columns(rows: DataFrame, pattern: str) -> DataFrame:
    """Columns whose names match a pattern are dropped."""
    import re

    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if not re.search(pattern, c)])


def without_positions(rows: DataFrame, positions: DataFrame, column: str = "pos") -> DataFrame:
    """Rows whose place is not in a list of places to discard."""
    return rows.join(positions.select(column).distinct(), column, "left_anti")


def moved_or_removed(markers: DataFrame, new: DataFrame, removed: DataFrame, on: str) -> DataFrame:
    """Markers to go on with: without a removal list, those that have new coordinates; with one, those that are not on it."""
    if removed.isEmpty():
        return markers.join(new.select(on), on, "left_semi")
    return markers.join(removed.select(on), on, "left_anti")


def inverted(pairs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(value, keys) of a table of keys and values."""
    return pairs.groupBy(value).agg(F.sort_array(F.collect_set(key)).alias("keys"))


def in_all_groups(rows: DataFrame, item: str, group: str) -> DataFrame:
    k = F.broadcast(rows.agg(F.count_distinct(group).alias("k")))
    return rows.groupBy(item).agg(F.count_distinct(group).alias("m")).crossJoin(k).filter("m = k").select(item)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """What one side has alone, labelled."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def labelled_union(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        df = df.withColumn("origin", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def transposed(cells: DataFrame) -> DataFrame:
    """(row, col, value) with rows and columns exchanged; ragged rows are cut to the shortest."""
    width = F.broadcast(cells.groupBy("row").agg(F.max("col").alias("w")).agg(F.min("w").alias("w")))
    return cells.crossJoin(width).filter("col <= w").select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def concatenated(lines: DataFrame) -> DataFrame:
    """(grp, pos) order of the lines of several files of a group, file after file."""
    sizes = lines.groupBy("grp", "file").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return lines.join(before, ["grp", "file"]).select("grp", (F.col("before") + F.col("line_no")).alias("pos"), "line")


def elapsed(seconds):
    """Seconds as days, hours, minutes and seconds."""
    s = seconds.cast("long")
    return F.format_string("%dd %02dh %02dm %02ds", F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)


def assert_unique(rows: DataFrame, on: list[str]) -> DataFrame:
    """The rows; an error when a key occurs twice."""
    twice = rows.groupBy(*on).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("_n"))
    return rows.crossJoin(F.broadcast(twice)).filter(F.coalesce(F.assert_true(F.col("_n") <= 1, f"duplicate {on}").cast("boolean"), F.lit(True))).drop("_n")
