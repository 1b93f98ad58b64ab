"""Gene expression: counts, RPKM, imputation of missing values, confounders, principal components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.operators.blocks import gram, packed_columns


def gene_counts(exons: DataFrame) -> DataFrame:
    return exons.groupBy("gene", "sample").agg(F.sum("n").alias("n_reads"))


def gene_spans(exons: DataFrame) -> DataFrame:
    return exons.groupBy("gene").agg(F.min("exon_start").alias("gene_start"), F.max("exon_end").alias("gene_end"), F.sum(F.col("exon_end") - F.col("exon_start")).alias("gene_length"))


def library_sizes(exons: DataFrame) -> DataFrame:
    return exons.groupBy("sample").agg(F.sum("n").alias("library_size"))


def rpkm(exons: DataFrame) -> DataFrame:
    """Reads per kilobase and million reads; 0 for an empty library. Samples are few, genes may be many."""
    c = gene_counts(exons).join(gene_spans(exons), "gene").join(library_sizes(exons), "sample")
    value = F.try_divide(1e9 * F.col("n_reads"), F.col("library_size").cast("double") * F.col("gene_length"))
    return c.select("gene", "sample", F.round(F.coalesce(value, F.lit(0.0)), 2).alias("rpkm"))


def impute_means(values: DataFrame) -> DataFrame:
    """Every individual for every gene that all subgroups have; what is missing is the gene's mean in the subgroup."""
    groups = values.select("subgroup").distinct()
    n = F.broadcast(groups.agg(F.count("*").alias("k")))
    common = values.groupBy("gene").agg(F.count_distinct("subgroup").alias("m")).crossJoin(n).filter("m = k").select("gene")
    means = values.groupBy("subgroup", "gene").agg(F.avg("v").alias("mean"))
    inds = values.select("ind").distinct()
    grid = means.join(common, "gene", "left_semi").crossJoin(inds)
    return grid.join(values, ["subgroup", "gene", "ind"], "left").select("subgroup", "gene", "ind", F.coalesce("v", "mean").alias("v"), F.col("v").isNull().alias("imputed"))


def residuals(values: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """What is left of ``y`` after a straight line on ``x``, per group."""
    fit = values.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return values.join(fit, by).withColumn("residual", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))


def remove_confounders(values: DataFrame, confounders: DataFrame, most_entries: int = 1 << 24) -> DataFrame:
    """Residuals of each gene on several confounders, after centring and scaling.

    values: (gene, ind, v); confounders: (ind, name, c), what is missing counts as 0. The confounders are one matrix, whose size is checked, and go
    to the tasks with their inverse normal equations; a gene's values meet them in the task where the gene is.
    """
    import numpy as np

    spark = values.sparkSession
    rows = confounders.filter("c is not null").limit(most_entries + 1).collect()
    if len(rows) > most_entries:
        raise ValueError(f"at most {most_entries} values of confounders")
    inds, names = ({x: k for k, x in enumerate(sorted({r[c] for r in rows}))} for c in ("ind", "name"))
    if len(inds) * len(names) > most_entries:
        raise ValueError(f"at most {most_entries} individuals times confounders")
    design = np.zeros((len(inds), len(names)))
    for r in rows:
        design[inds[r["ind"]], names[r["name"]]] += r["c"]
    shared = spark.sparkContext.broadcast((inds, design, np.linalg.pinv(design.T @ design)))

    def left(table):
        import numpy as np
        import pyarrow as pa

        inds, design, inverse = shared.value
        v = np.array(table.column("v").to_pylist(), dtype=float)
        known = ~np.isnan(v)
        spread = v[known].std(ddof=1) if known.sum() > 1 else 0.0
        y = np.where(known, v - v[known].mean(), 0) / spread if spread > 0 else np.zeros(len(v))
        place = [inds.get(i, -1) for i in table.column("ind").to_pylist()]
        c = np.concatenate([design, np.zeros((1, design.shape[1]))])[place]
        return pa.table({"gene": table.column("gene"), "ind": table.column("ind"), "residual": pa.array(np.where(known, y - c @ (inverse @ (c.T @ y)), 0.0))})

    kinds = [values.schema[c].dataType.simpleString() for c in ("gene", "ind")]
    cells = values.select("gene", "ind", F.col("v").cast("double").alias("v"))
    return cells.groupBy("gene").applyInArrow(left, f"gene {kinds[0]}, ind {kinds[1]}, residual double")


def components(values: DataFrame, most_samples: int = 5000) -> DataFrame:
    """Principal components of the samples: variances, shares and cumulative shares.

    Spark sums the samples-by-samples covariance of centred and scaled columns; its size is that of a cohort.
    """
    import numpy as np

    inds = sorted(r[0] for r in values.select("ind").distinct().limit(most_samples + 1).collect())
    if len(inds) > most_samples:
        raise ValueError(f"at most {most_samples} samples")
    s = values.groupBy("ind").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    z = values.join(F.broadcast(s), "ind").select("gene", "ind", F.coalesce(F.try_divide(F.col("v") - F.col("m"), F.col("s")), F.lit(0.0)).alias("z"))
    ones = z.withColumn("z", F.lit(1.0))
    counts = gram(packed_columns(ones, inds, "gene"), len(inds))  # genes that two samples share
    cov = gram(packed_columns(z, inds, "gene"), len(inds)) / np.maximum(1, counts - 1)
    variances = np.clip(np.linalg.eigvalsh(cov)[::-1], 0, None)
    share = variances / variances.sum() if variances.sum() else variances
    rows = [(k + 1, float(v), float(p), float(c)) for k, (v, p, c) in enumerate(zip(variances, share, np.cumsum(share), strict=True))]
    return values.sparkSession.createDataFrame(rows, "pc int, variance double, share double, cumulative double")


def enough_components(pcs: DataFrame, share: float | None = None, least_drop: float | None = None) -> int:
    """How many components to keep: the first that reach a cumulative share, or up to the first drop below a bound."""
    rows = pcs.orderBy("pc").collect()  # one row per sample of a cohort
    if share is not None:
        return next((r["pc"] for r in rows if r["cumulative"] >= share), len(rows))
    return next((a["pc"] for a, b in zip(rows, rows[1:], strict=False) if a["share"] - b["share"] < least_drop), len(rows))
