"""Gene by marker association."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from genolake.functions.distributions import smallest_of, t_pvalue
from genolake.operators.blocks import cross_products
from genolake.operators.statistics import bh, storey
from genolake.session import checkpoint

MOST_INDIVIDUALS = 5_000
MOST_COVARIATES = 1_000
#: The smaller of two packed matrices goes to all tasks up to this size.
BROADCAST_BYTES = 256 << 20


def cis_pairs(genes: DataFrame, snps: DataFrame, distance: int = 1_000_000) -> DataFrame:
    """Range join: markers within ``distance`` of a gene's start, met by chromosome and bin.

    A gene is sent to its bin and the two next to it, so each pair meets exactly once.
    """
    g = genes.withColumn("bin", F.explode(F.array(*[F.floor(F.col("tss") / distance) + k for k in (-1, 0, 1)])))
    s = snps.withColumn("bin", F.floor(F.col("pos") / distance))
    return g.join(s, ["chrom", "bin"]).filter(F.abs(F.col("pos") - F.col("tss")) <= distance).select("gene", "snp", "chrom", (F.col("pos") - F.col("tss")).alias("offset"))


def _cohort(cells: DataFrame, most: int = MOST_INDIVIDUALS) -> list:
    """The individuals in order, once their number is known to be small."""
    inds = [r[0] for r in cells.select("ind").distinct().orderBy("ind").limit(most + 1).collect()]
    if len(inds) > most:
        raise ValueError(f"at most {most} individuals")
    return inds


def projected(values: DataFrame, item: str, value: str, covariates: DataFrame | None = None, covariance: DataFrame | None = None) -> DataFrame:
    """(item, ind, value): what is left of each item's values after its least-squares fit on the mean and the covariates.

    covariates: (ind, name, c). covariance: (ind1, ind2, v) of the errors, both ways; values and covariates are whitened by it
    first. Matrices are individuals by individuals at most, and items are projected one by one in the tasks. An
    individual without a covariate is left out; so is an item that misses one of those who stay.
    """
    import numpy as np

    spark = values.sparkSession
    inds = _cohort(values)
    names: list = []
    if covariates is not None:
        rows = covariates.select("ind", "name", "c").limit(MOST_INDIVIDUALS * MOST_COVARIATES + 1).collect()
        names = sorted({r["name"] for r in rows})
        if len(names) > MOST_COVARIATES:
            raise ValueError(f"at most {MOST_COVARIATES} covariates")
        known = {(r["ind"], r["name"]): float(r["c"]) for r in rows if r["c"] is not None}
        inds = [i for i in inds if all((i, n) in known for n in names)]
    design = np.array([[1.0, *(known[i, n] for n in names)] for i in inds]) if names else np.ones((len(inds), 1))
    white = np.eye(len(inds))
    if covariance is not None:
        place = {i: k for k, i in enumerate(inds)}
        errors = np.zeros((len(inds), len(inds)))
        for r in covariance.collect():  # bounded by the cohort
            if r["ind1"] in place and r["ind2"] in place:
                errors[place[r["ind1"]], place[r["ind2"]]] = r["v"]
        lengths, vectors = np.linalg.eigh(errors)
        white = vectors @ np.diag(lengths**-0.5) @ vectors.T
    x = white @ design
    shared = spark.sparkContext.broadcast((inds, white - x @ np.linalg.pinv(x) @ white))
    kind = values.schema[item].dataType.simpleString()

    def run(table):
        import numpy as np
        import pyarrow as pa

        inds, matrix = shared.value
        found = dict(zip(table.column("ind").to_pylist(), table.column("value").to_pylist(), strict=True))
        y = np.array([found.get(i) for i in inds], dtype=float)
        keep = len(inds) if len(inds) and not np.isnan(y).any() else 0
        return pa.table({"item": table.column("item").slice(0, 1).take(pa.array([0] * keep, pa.int32())), "ind": pa.array(inds[:keep], table.column("ind").type), "value": pa.array((matrix @ y)[:keep] if keep else [], pa.float64())})

    cells = values.select(F.col(item).alias("item"), "ind", F.col(value).cast("double").alias("value"))
    out = cells.groupBy("item").applyInArrow(run, f"item {kind}, ind {values.schema['ind'].dataType.simpleString()}, value double")
    return out.toDF(item, "ind", value)


def pair_tests(pairs: DataFrame, expression: DataFrame, doses: DataFrame, covariates: DataFrame | None = None, covariance: DataFrame | None = None) -> DataFrame:
    """r and t of the pairs: (gene, snp) with (gene, ind, v) and (snp, ind, g), in sums per pair.

    With covariates or a covariance of the errors both sides, over the individuals that both have, are projected first,
    and ``df`` counts the covariates.
    """
    if covariates is None and covariance is None:
        lost, r = 2, F.corr(F.col("v").cast("double"), F.col("g").cast("double"))
        left, right = expression, doses
    else:
        lost = 2 + (0 if covariates is None else covariates.select("name").distinct().count())
        shared = expression.select("ind").intersect(doses.select("ind"))
        left, right = (projected(df.join(shared, "ind", "left_semi"), c, v, covariates, covariance) for df, c, v in ((expression, "gene", "v"), (doses, "snp", "g")))
        size = F.sqrt(F.sum(F.col("v") * F.col("v")) * F.sum(F.col("g") * F.col("g")))
        r = F.when(size > 1e-9, F.sum(F.col("v") * F.col("g")) / size)
    joined = pairs.select("gene", "snp").join(left.select("gene", "ind", "v"), "gene").join(right.select("snp", "ind", "g"), ["snp", "ind"])
    out = joined.groupBy("gene", "snp").agg(F.count("*").alias("n"), r.alias("r"))
    df = F.col("n") - lost
    out = out.filter(F.col("r").isNotNull() & (df > 0)).withColumn("df", df)
    return out.withColumn("t", F.try_divide(F.col("r") * F.sqrt("df"), F.sqrt(1 - F.col("r") * F.col("r"))))


def all_pair_tests(expression: DataFrame, doses: DataFrame, least_t: float = 0.0, at_once: int = 256) -> DataFrame:
    """(gene, snp, n, r, t) of every gene and marker with abs(t) of ``least_t`` or more: products of blocks of both matrices.

    A block of genes meets a block of markers as two dense matrices. The smaller of the two, if it has at most ``BROADCAST_BYTES``, goes to all tasks and
    the blocks of the other stream past it; beyond that, pairs of blocks are dealt. Pairs under the threshold are never rows.
    """
    inds, spark = _cohort(doses), expression.sparkSession
    shared = spark.sparkContext.broadcast({i: k for k, i in enumerate(inds)})
    one, two = (df.schema[c].dataType.simpleString() for df, c in ((expression, "gene"), (doses, "snp")))

    def packed(cells: DataFrame, item: str, value: str, kind: str) -> DataFrame:
        blocks = max(1, -(-cells.select(item).distinct().count() // at_once))

        def run(table):
            import numpy as np
            import pyarrow as pa

            place = shared.value
            items = sorted(set(table.column("item").to_pylist()))
            row = {x: k for k, x in enumerate(items)}
            m = np.full((len(items), len(place)), np.nan)
            for x, i, v in zip(*(table.column(c).to_pylist() for c in ("item", "ind", "value")), strict=True):
                if i in place and v is not None:
                    m[row[x], place[i]] = v
            return pa.table({"items": pa.array([items], pa.list_(table.column("item").type)), "cells": pa.array([m.tobytes()], pa.binary())})

        rows = cells.select(F.pmod(F.xxhash64(item), F.lit(blocks)).alias("block"), F.col(item).alias("item"), "ind", F.col(value).cast("double").alias("value"))
        return rows.groupBy("block").applyInArrow(run, f"items array<{kind}>, cells binary")

    def tested(genes, y, snps, x, kinds):
        import numpy as np
        import pyarrow as pa

        here, there = ~np.isnan(y), ~np.isnan(x)
        a, b = here.astype(float), there.astype(float)
        raw, x = np.where(here, y, 0), np.where(there, x, 0)
        y = np.where(here, y - np.nanmean(y, axis=1, keepdims=True), 0)
        n, sy, sx = a @ b.T, y @ b.T, a @ x.T
        yy, xx = (raw * raw) @ b.T, a @ (x * x).T
        with np.errstate(divide="ignore", invalid="ignore"):
            vy, vx, xy = (y * y) @ b.T - sy * sy / n, xx - sx * sx / n, y @ x.T - sy * sx / n
            r = np.clip(xy / np.sqrt(vy * vx), -1, 1)
            t = r * np.sqrt(n - 2) / np.sqrt(1 - r * r)
        # A constant has no correlation; what is one is measured by the values' own size, whatever their unit.
        i, j = np.nonzero((n > 2) & (vy > 1e-24 * yy) & (vx > 1e-12 * xx) & (np.abs(t) >= least_t))
        return pa.RecordBatch.from_arrays([pa.array([genes[q] for q in i], kinds[0]), pa.array([snps[q] for q in j], kinds[1]), pa.array(n[i, j].astype(np.int64)), pa.array(r[i, j]), pa.array(t[i, j])], names=["gene", "snp", "n", "r", "t"])

    n_inds, schema = len(inds), f"gene {one}, snp {two}, n long, r double, t double"
    kinds = [to_arrow_type(df.schema[c].dataType) for df, c in ((expression, "gene"), (doses, "snp"))]
    sides = [checkpoint(packed(expression, "gene", "v", one)), checkpoint(packed(doses, "snp", "g", two))]
    sizes = [s.agg(F.coalesce(F.sum(F.length("cells")), F.lit(0))).first()[0] for s in sides]
    small = 0 if sizes[0] <= sizes[1] else 1

    def both(one_side, other_side):
        """Blocks of the side that streams and of the other, as genes and markers."""
        (a, x), (b, y) = ((items, np.frombuffer(cells).reshape(-1, n_inds)) for items, cells in (one_side, other_side))
        return tested(a, x, b, y, kinds) if small else tested(b, y, a, x, kinds)

    import numpy as np

    if sizes[small] <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast([(r["items"], bytes(r["cells"])) for r in sides[small].collect()])

        def stream(batches: Iterator) -> Iterator:
            for batch in batches:
                for items, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for other in held.value:
                        yield both((items, cells), other)

        return sides[1 - small].mapInArrow(stream, schema)

    def meet(batches: Iterator) -> Iterator:
        for batch in batches:
            for k in range(batch.num_rows):
                items, cells, items2, cells2 = (batch.column(c)[k].as_py() for c in range(4))
                yield both((items, cells), (items2, cells2))

    return sides[1 - small].crossJoin(sides[small].toDF("items2", "cells2")).mapInArrow(meet, schema)


def with_pvalues(tests: DataFrame, most: float | None = None) -> DataFrame:
    """Two-sided p of t, and only tests of at most ``most``."""
    df = F.col("df") if "df" in tests.columns else F.col("n") - 2
    out = tests.withColumn("p", t_pvalue(F.col("t"), df))
    return out if most is None else out.filter(F.col("p") <= most)


def anova_tests(pairs: DataFrame, expression: DataFrame, doses: DataFrame) -> DataFrame:
    """F of the pairs: the genotypes as classes, by sums per class. (gene, snp, n, df1, df2, f)"""
    joined = pairs.select("gene", "snp").join(expression.select("gene", "ind", "v"), "gene").join(doses.select("snp", "ind", "g"), ["snp", "ind"])
    per = joined.groupBy("gene", "snp", "g").agg(F.count("*").alias("k"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("*")).alias("w"))
    tests = per.groupBy("gene", "snp").agg(F.sum("k").alias("n"), F.count("*").alias("classes"), F.sum("w").alias("within"), (F.sum(F.col("k") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("k") * F.col("m")), F.lit(2)) / F.sum("k")).alias("between"))
    tests = tests.withColumn("df1", F.col("classes") - 1).withColumn("df2", F.col("n") - F.col("classes")).filter("df1 > 0 and df2 > 0 and within > 0")
    return tests.select("gene", "snp", "n", "df1", "df2", ((F.col("between") / F.col("df1")) / (F.col("within") / F.col("df2"))).alias("f"))


def error_covariance(values: DataFrame, covariates: DataFrame | None = None) -> DataFrame:
    """(item1, item2, v): maximum-likelihood covariance of the errors of several traits, their residuals' cross-products over N."""
    left = projected(values, "item", "value", covariates)
    n = F.broadcast(left.agg(F.count_distinct("ind").alias("n_inds")))  # one row
    return cross_products(left, "item", "ind", "value").crossJoin(n).select(F.col("row1").alias("item1"), F.col("row2").alias("item2"), (F.col("cross") / F.col("n_inds")).alias("v"))


def egenes(tests: DataFrame, method: str) -> DataFrame:
    """(gene, value): genes with the value that is compared with the false-discovery rate.

    1a: smallest BH value; 1b: smallest Storey value; 2: Storey over per-gene Bonferroni minima; 3: Storey over the
    Beta(1, N) probability of the smallest p.
    """
    if method == "1a":
        return bh(tests).groupBy("gene").agg(F.min("q").alias("value"))
    if method == "1b":
        return storey(tests).groupBy("gene").agg(F.min("qvalue").alias("value"))
    per = tests.groupBy("gene").agg(F.count("*").alias("n"), F.min("p").alias("low"))
    if method == "2":
        best = per.select("gene", F.least(F.lit(1.0), F.col("low") * F.col("n")).alias("p"))
    elif method == "3":
        best = per.select("gene", smallest_of(F.col("low"), F.col("n")).alias("p"))
    else:
        raise ValueError("method is 1a, 1b, 2 or 3")
    return storey(best, "p", "gene").select("gene", F.col("qvalue").alias("value"))


def best_marker(tests: DataFrame) -> DataFrame:
    return tests.groupBy("gene").agg(F.min_by("snp", F.struct("p", "snp")).alias("snp"), F.min("p").alias("p"))


def tests_per_gene(tests: DataFrame) -> DataFrame:
    return tests.groupBy("gene").agg(F.count("*").alias("n_tests"))


def gene_rank(tests: DataFrame) -> DataFrame:
    return tests.withColumn("rank", F.row_number().over(Window.partitionBy("gene").orderBy("p", "snp")))
