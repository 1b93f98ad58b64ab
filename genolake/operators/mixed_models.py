"""Linear mixed models of records of individuals, fitted from grouped sufficient statistics.

The model is ``y = X b + Z u (+ W v) + e`` with fixed columns X, a random effect of the individual and, if wanted, a second random factor with few
levels. Given the ratio of variances, an individual with n records enters the normal equations through the sums of its rows alone, weighed
by a number that depends on n. So Spark sums the products of all rows, and the products of individuals' sums by the number of their records: one small
matrix per different number of records, whatever the number of individuals. The individual effects are thus absorbed, the second factor stays as columns with a ridge,
and the likelihood (ML or restricted) of any ratios, and of any choice of the fixed columns, is computed from these matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a model, and different numbers of records of individuals, whose matrices come to the driver.
MOST_COLUMNS = 200
MOST_GROUPS = 20_000


@dataclass
class Statistics:
    names: list[str]  # columns; the response is the last
    n_rows: int
    rows: object  # products of all rows
    sizes: object  # numbers of records
    individuals: object  # individuals with so many records
    sums: object  # products of their sums


def outer_sums(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, n, at, total): number of rows and summed products of every pair of columns, per key; ``at`` counts through the matrix."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            keys = batch.column(0).to_numpy()
            x = np.stack([batch.column(i + 1).to_numpy() for i in range(len(columns))], axis=1)
            for k in np.unique(keys).tolist():
                part = x[keys == k]
                n, total = held.get(k, (0, 0.0))
                held[k] = n + len(part), total + part.T @ part
        for k, (n, total) in held.items():
            size = len(columns) ** 2
            yield pa.RecordBatch.from_arrays([pa.array([k] * size, pa.int64()), pa.array([n] * size, pa.int64()), pa.array(range(size), pa.int32()), pa.array(total.ravel())], names=["key", "n", "at", "total"])

    parts = df.select(F.col(key).cast("long").alias("key"), *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, "key long, n long, at int, total double")
    return parts.groupBy("key", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _matrices(df: DataFrame, size: int) -> tuple:
    import numpy as np

    # Bounded: the columns and the different keys are checked before.
    rows = df.orderBy("key", "at").collect()
    keys = sorted({r["key"] for r in rows})
    out, counts, place = np.zeros((len(keys), size * size)), np.zeros(len(keys)), {k: i for i, k in enumerate(keys)}
    for r in rows:
        out[place[r["key"]], r["at"]] = r["total"]
        counts[place[r["key"]]] = r["n"]
    return np.array(keys, dtype=float), counts, out.reshape(len(keys), size, size)


def statistics(records: DataFrame, columns: dict[str, Column], response: str, individual: str = "ind") -> Statistics:
    """Sufficient statistics of a model with these columns. Rows with a null in any of them, or without an individual, are left out."""
    if len(columns) + 1 > MOST_COLUMNS:
        raise ValueError(f"at most {MOST_COLUMNS} columns")
    names = [*columns, "_y"]
    rows = records.select(F.col(individual).alias("_ind"), *[c.cast("double").alias(n) for n, c in columns.items()], F.col(response).cast("double").alias("_y")).dropna()
    per = rows.groupBy("_ind").agg(F.count("*").alias("_n"), *[F.sum(f"`{n}`").alias(n) for n in names])
    if per.select("_n").distinct().limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"individuals have more than {MOST_GROUPS} different numbers of records")
    _, total, whole = _matrices(outer_sums(rows.withColumn("_k", F.lit(0)), names, "_k"), len(names))
    sizes, individuals, sums = _matrices(outer_sums(per, names, "_n"), len(names))
    return Statistics(names, int(total[0]) if len(total) else 0, whole[0] if len(whole) else None, sizes, individuals, sums)


def levels(records: DataFrame, factor: str, first: bool = True) -> dict[str, Column]:
    """Columns of 0 and 1 for the levels of a factor; without ``first`` all but the smallest level, which is the reference."""
    found = sorted(r[0] for r in records.select(factor).dropna().distinct().limit(MOST_COLUMNS + 1).collect())
    return {f"{factor}={x}": F.when(F.col(factor).isNotNull(), (F.col(factor) == F.lit(x)).cast("double")) for x in (found if first else found[1:])}


def _logdet(m) -> tuple[float, int]:
    """log determinant on the space where the matrix is not zero, and its dimension."""
    import numpy as np

    if not len(m):
        return 0.0, 0
    values = np.linalg.eigvalsh(m)
    values = values[values > 1e-10 * max(values.max(), 1e-300)]
    return float(np.log(values).sum()), len(values)


def evaluate(s: Statistics, fixed: list[str], ratio: float, reml: bool, random: list[str] = (), random_ratio: float = 0.0) -> dict:
    """-2 log likelihood and estimates at given ratios of the random effects' variances to the error's."""
    import numpy as np

    weight = ratio / (1 + ratio * s.sizes)
    m = s.rows - np.tensordot(weight, s.sums, axes=1)
    x, z, y = [s.names.index(c) for c in fixed], [s.names.index(c) for c in random], len(s.names) - 1
    logdet = float((s.individuals * np.log1p(ratio * s.sizes)).sum())
    if z and random_ratio > 0:
        inner = m[np.ix_(z, z)] + np.eye(len(z)) / random_ratio
        logdet += float(np.linalg.slogdet(np.eye(len(z)) + random_ratio * m[np.ix_(z, z)])[1])
        m = m - m[:, z] @ np.linalg.solve(inner, m[z, :])
    xx, xy = m[np.ix_(x, x)], m[x, y]
    beta = np.linalg.pinv(xx, rcond=1e-10, hermitian=True) @ xy
    rss = max(float(m[y, y] - beta @ xy), 1e-300)
    x_logdet, rank = _logdet(xx)
    free = s.n_rows - (rank if reml else 0)
    var_e = rss / free
    deviance = free * (math.log(2 * math.pi * var_e) + 1) + logdet + (x_logdet if reml else 0.0)
    return {"deviance": deviance, "rank": rank, "var_e": var_e, "var_ind": ratio * var_e, "var_random": random_ratio * var_e if z else None, "beta": dict(zip(fixed, beta.tolist(), strict=True))}


def _search(value, low: float = -14.0, high: float = 10.0) -> float:
    """Ratio with the smallest value: a grid of its logarithm, golden section around the best, and zero."""
    import numpy as np

    grid = np.linspace(low, high, 49)
    top = int(np.argmin([value(math.exp(g)) for g in grid]))
    a, b, g = grid[max(0, top - 1)], grid[min(48, top + 1)], (5**0.5 - 1) / 2
    for _ in range(60):
        p, q = b - g * (b - a), a + g * (b - a)
        a, b = (a, q) if value(math.exp(p)) < value(math.exp(q)) else (p, b)
    best = math.exp((a + b) / 2)
    return best if value(best) < value(0.0) else 0.0


def fit(s: Statistics, fixed: list[str], reml: bool = True, random: list[str] = ()) -> dict:
    """The most likely ratios, one after the other until they stay, with the estimates there."""
    ratio, other = 1.0, 0.0
    for _ in range(50 if random else 1):
        before = ratio, other
        ratio = _search(lambda r, o=other: evaluate(s, fixed, r, reml, random, o)["deviance"])
        if random:
            other = _search(lambda o, r=ratio: evaluate(s, fixed, r, reml, random, o)["deviance"])
        if all(abs(a - b) <= 1e-9 * (1 + a) for a, b in zip(before, (ratio, other), strict=True)):
            break
    out = evaluate(s, fixed, ratio, reml, random, other)
    variances = 2 + bool(random)
    out["df"] = out["rank"] + variances
    out["aic"], out["bic"] = out["deviance"] + 2 * out["df"], out["deviance"] + math.log(max(1, s.n_rows)) * out["df"]
    return out


MODELS = "model string, method string, n long, df int, log_likelihood double, aic double, bic double, chisq double, chisq_df int, p double, intercept double, var_ind double, var_year double, var_e double, h2 double, h2_design double, cv_g double"


def compare_models(pheno: DataFrame, trait: str = "trait1", year: str = "year", covariate: str = "trait3") -> DataFrame:
    """One row per model and method: mean; with fixed years; with years and the covariate; and with years as a second random factor.

    Models with more fixed effects are compared with the one before by the likelihood ratio (ML). ``h2`` is the share of the individuals' variance in
    theirs and the error's, ``h2_design`` that of the mean number of records, ``cv_g`` the individuals' deviation over the intercept.
    """
    from genolake.functions.distributions import chi2_upper

    years = levels(pheno, year)
    columns = {"(mean)": F.lit(1.0), covariate: F.col(covariate).cast("double"), **years}
    s = statistics(pheno, columns, trait)
    spark = pheno.sparkSession
    if not s.n_rows:
        return spark.createDataFrame([], MODELS)
    per_ind = s.n_rows / float(s.individuals.sum())
    contrasts = list(years)[1:]
    nested = {"mean": ["(mean)"], "mean + year": ["(mean)", *contrasts], f"mean + year + {covariate}": ["(mean)", *contrasts, covariate]}
    plans = [(name, "ML", fixed, ()) for name, fixed in nested.items()]
    plans += [(name, "REML", fixed, ()) for name, fixed in nested.items()] + [("mean + (year)", "REML", ["(mean)"], tuple(years))]
    rows, last = [], None
    for name, method, fixed, random in plans:
        f = fit(s, fixed, method == "REML", list(random))
        chisq = df = p = None
        if method == "ML":
            if last:
                chisq, df = max(0.0, last["deviance"] - f["deviance"]), f["df"] - last["df"]
                p = float(chi2_upper(chisq, df)) if df > 0 else None
            last = f
        mean, g, e = f["beta"]["(mean)"], f["var_ind"], f["var_e"]
        rows.append((name, method, s.n_rows, f["df"], -f["deviance"] / 2, f["aic"], f["bic"], chisq, df, p, mean, g, f["var_random"], e, g / (g + e), g / (g + e / per_ind), math.sqrt(g) / mean if mean else None))
    return spark.createDataFrame(rows, MODELS)
