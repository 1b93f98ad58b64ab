"""Multiple testing, summaries and small models.

Windows over all tests would bring every row to one task. Ranks are therefore taken within ranges of sorted values
(dealt by ``repartitionByRange``) and shifted by the sizes of the ranges before, which are few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genolake.operators.skew import hand_back
from genolake.session import checkpoint, partitions

LAMBDAS = tuple(round(0.05 * k, 2) for k in range(19))


def steady_mean(value: str) -> Column:
    """The mean of doubles, the same in whatever order the rows come.

    Values are summed as decimals of twenty places, which hold all digits of a double of 0.001 to 10**8; where a group has others, it is the plain mean.
    """
    size = F.abs(F.col(value).cast("double"))
    held = (size <= 1e8) & ((size >= 1e-3) | (size == 0))
    exact = F.sum(F.when(held, F.col(value).cast("double")).try_cast("decimal(38,20)")).cast("double") / F.count(value)
    return F.when(F.count_if(~held) == 0, exact).otherwise(F.avg(value))


def ranked(df: DataFrame, value: str, key: str) -> DataFrame:
    """Adds ``rk``, the 1-based rank by (value, key) over the whole table, and ``range_no``.

    Ranges follow quantiles of the values; each is ranked by a task of its own. Rows tied in value share a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(value, [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    place = F.lit(0)
    if cuts:  # how many cuts lie below the value: found in the sorted list by the tasks, not by a join
        place = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda a, c: a + (F.col(value) > c).cast("int"))
    dealt = df.withColumn("range_no", place)
    sizes = dealt.groupBy("range_no").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    own = F.row_number().over(Window.partitionBy("range_no").orderBy(value, key))
    return dealt.withColumn("own", own).join(F.broadcast(before), "range_no").withColumn("rk", F.col("own") + F.col("before")).drop("own", "before")


def bonferroni(tests: DataFrame) -> DataFrame:
    n = tests.groupBy("gene").agg(F.count("*").alias("n_tests"))
    return tests.join(n, "gene").select("gene", "snp", F.least(F.lit(1.0), F.col("p") * F.col("n_tests")).alias("p_adj"))


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, size, below, range_no): the distinct values, how many rows have each, and how many have a smaller one.

    Tied rows are one row here, so they never meet in a task; ranges of values are dealt once and kept in the checkpoint folder.
    """
    n = partitions(df.sparkSession)
    sizes = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("size"))
    dealt = checkpoint(sizes.repartitionByRange(n, value).select(value, "size", F.spark_partition_id().alias("range_no")))
    per = dealt.groupBy("range_no").agg(F.sum("size").alias("all"))  # one row per range
    before = per.select("range_no", F.coalesce(F.sum("all").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("size").over(Window.partitionBy("range_no").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    return dealt.withColumn("own", own).join(F.broadcast(before), "range_no").select(value, "size", (F.col("own") + F.col("before")).alias("below"), "range_no")


def bh(tests: DataFrame, p: str = "p", key: str = "snp", scale: Column | None = None) -> DataFrame:
    """Adds ``q``: the smallest m*p/rank from here upwards, at most 1, times ``scale``.

    Tied tests have one q, that of the last of them, so it is computed per distinct p and handed back.
    """
    found = tests.filter(F.col(p).isNotNull())
    ranks = value_ranks(found, p)
    m = F.broadcast(ranks.agg(F.sum("size").alias("m")))
    r = ranks.crossJoin(m).withColumn("raw", F.col("m") * F.col(p) / (F.col("below") + F.col("size")))
    lows = r.groupBy("range_no").agg(F.min("raw").alias("low"))
    after = lows.select("range_no", F.min("low").over(Window.orderBy(F.desc("range_no")).rowsBetween(Window.unboundedPreceding, -1)).alias("after"))
    own = F.min("raw").over(Window.partitionBy("range_no").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    low = F.least(F.col("own_low"), F.coalesce("after", F.lit(float("inf"))), F.lit(1.0))
    q = r.withColumn("own_low", own).join(F.broadcast(after), "range_no").select(p, "size", (low * scale if scale is not None else low).alias("q"))
    return hand_back(found, q, p, "size").select(*tests.columns, "q")


def pi0(tests: DataFrame, p: str = "p") -> DataFrame:
    """One row: Storey's share of true null tests, by the closed-form bootstrap error over a grid."""
    counts = tests.agg(F.count(p).alias("m"), *[F.count_if(F.col(p) >= x).cast("double").alias(f"w{k}") for k, x in enumerate(LAMBDAS)])
    grid = counts.select(F.col("m").cast("double").alias("m"), F.explode(F.array(*[F.struct(F.lit(x).alias("lam"), F.col(f"w{k}").alias("w")) for k, x in enumerate(LAMBDAS)])).alias("g"))
    est = grid.select("m", "g.lam", "g.w", (F.col("g.w") / (F.col("m") * (1 - F.col("g.lam")))).alias("est"))
    low = est.agg(F.percentile("est", 0.1).alias("q10"))
    mse = est.crossJoin(low).withColumn("mse", F.col("w") / (F.col("m") * F.col("m") * (1 - F.col("lam")) * (1 - F.col("lam"))) * (1 - F.col("w") / F.col("m")) + (F.col("est") - F.col("q10")) * (F.col("est") - F.col("q10")))
    return mse.agg(F.least(F.min_by("est", F.struct("mse", "lam")), F.lit(1.0)).alias("pi0"))


def storey(tests: DataFrame, p: str = "p", key: str = "snp") -> DataFrame:
    return bh(tests, p, key).crossJoin(F.broadcast(pi0(tests, p))).withColumn("qvalue", F.col("q") * F.col("pi0")).drop("q", "pi0")


def fdr_at(tests: DataFrame, threshold: float) -> DataFrame:
    n = tests.agg(F.count("p").alias("m"), F.count_if(F.col("p") <= threshold).alias("hits"))
    return n.crossJoin(pi0(tests)).select(F.lit(threshold).alias("threshold"), "hits", F.least(F.lit(1.0), F.try_divide(F.col("pi0") * F.col("m") * threshold, F.col("hits"))).alias("fdr"))


def histogram(tests: DataFrame, bins: int = 99) -> DataFrame:
    return tests.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def six_numbers(df: DataFrame, value: str, by: str) -> DataFrame:
    p = lambda x: F.percentile(value, x)
    return df.groupBy(by).agg(F.min(value).alias("min"), p(0.25).alias("q1"), p(0.5).alias("median"), F.avg(value).alias("mean"), p(0.75).alias("q3"), F.max(value).alias("max"))


def average_ranks(df: DataFrame, value: str, by: str) -> DataFrame:
    """Adds ``<value>_rank`` within ``by``; ties share the mean of their ranks."""
    tied = df.groupBy(by, value).agg(F.count("*").alias("_t"))
    below = F.coalesce(F.sum("_t").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = tied.withColumn(f"{value}_rank", below + (F.col("_t") + 1) / 2).drop("_t")
    return df.join(ranks, [by, value])


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    r = average_ranks(average_ranks(df, x, by), y, by)
    return r.groupBy(by).agg(F.corr(f"{x}_rank", f"{y}_rank").alias("spearman"))


def ols(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Slope, share of variance explained, residual deviation, standard error and t of a line per group."""
    s = df.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    s = s.filter("n > 2 and sxx > 0").withColumn("sigma", F.sqrt((1 - F.coalesce("r2", F.lit(1.0))) * F.col("syy") / (F.col("n") - 2)))
    s = s.withColumn("se", F.col("sigma") / F.sqrt("sxx"))
    return s.withColumn("t", F.try_divide("slope", "se")).drop("sxx", "syy")


def ols_multi(df: DataFrame, xs: list[str], y: str, by: str) -> DataFrame:
    """Linear regression on an intercept and several predictors per group, in one aggregation.

    Columns: ``by``, n, intercept, for each predictor ``b_<x>``, ``se_<x>`` and ``t_<x>``, then r2 and sigma. The normal equations are the centred sums of
    products; they are solved by a Cholesky factorisation in expressions. Rows with a null are left out, and so are groups without a residual degree of
    freedom or with predictors that depend on each other (a pivot below 1e-10 of its sum of squares).
    """
    p, name = len(xs), [*xs, y]
    value = [F.col(c).cast("double") for c in name]
    pairs = [(i, j) for i in range(p + 1) for j in range(i + 1)]
    cells = df.select(by, *[v.alias(f"v{i}") for i, v in enumerate(value)]).dropna(subset=[f"v{i}" for i in range(p + 1)])
    sums = [(F.covar_pop(f"v{i}", f"v{j}") * F.count("*")).alias(f"s{i}_{j}") for i, j in pairs]
    m = cells.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(p + 1)], *sums)
    c = F.col
    total = lambda terms: sum(terms, F.lit(0.0))
    for j in range(p):  # L, column by column; the last row, of y, is what is projected on it
        pivot = c(f"s{j}_{j}") - total(c(f"l{j}_{k}") * c(f"l{j}_{k}") for k in range(j))
        m = m.withColumn(f"l{j}_{j}", F.when(pivot > 1e-10 * c(f"s{j}_{j}"), F.sqrt(pivot)))
        m = m.select("*", *[((c(f"s{i}_{j}") - total(c(f"l{i}_{k}") * c(f"l{j}_{k}") for k in range(j))) / c(f"l{j}_{j}")).alias(f"l{i}_{j}") for i in range(j + 1, p + 1)])
    for i in range(p):  # the inverse of L, row by row
        m = m.select("*", *[(F.lit(1.0) / c(f"l{i}_{i}") if i == j else -total(c(f"l{i}_{k}") * c(f"w{k}_{j}") for k in range(j, i)) / c(f"l{i}_{i}")).alias(f"w{i}_{j}") for j in range(i + 1)])
    for j in range(p):
        m = m.withColumn(f"b_{xs[j]}", total(c(f"w{i}_{j}") * c(f"l{p}_{i}") for i in range(j, p)))
    rss = F.greatest(F.lit(0.0), c(f"s{p}_{p}") - total(c(f"l{p}_{k}") * c(f"l{p}_{k}") for k in range(p)))
    m = m.filter((c("n") > p + 1) & total(c(f"b_{x}") for x in xs).isNotNull()).withColumn("sigma", F.sqrt(rss / (c("n") - p - 1))).withColumn("r2", 1 - F.try_divide(rss, c(f"s{p}_{p}")))
    m = m.withColumn("intercept", c(f"m{p}") - total(c(f"b_{x}") * c(f"m{j}") for j, x in enumerate(xs)))
    for j, x in enumerate(xs):
        m = m.withColumn(f"se_{x}", c("sigma") * F.sqrt(total(c(f"w{i}_{j}") * c(f"w{i}_{j}") for i in range(j, p)))).withColumn(f"t_{x}", F.try_divide(c(f"b_{x}"), c(f"se_{x}")))
    return m.select(by, "n", "intercept", *[f"{k}_{x}" for x in xs for k in ("b", "se", "t")], "r2", "sigma")


# Coefficients of the published approximation (Royston, 1995) for the Shapiro-Wilk weights and the law of W.
SHAPIRO_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
SHAPIRO_NEXT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
SHAPIRO_MEAN = (0.0038915, -0.083751, -0.31082, -1.5861)
SHAPIRO_SPREAD = (0.0030302, -0.082676, -0.4803)
SHAPIRO_SMALL_MEAN = (-0.0006714, 0.025054, -0.39978, 0.5440)
SHAPIRO_SMALL_SPREAD = (-0.0020322, 0.062767, -0.77857, 1.3822)


def _polynomial(x: float, coefficients: tuple[float, ...]) -> float:
    out = 0.0
    for a in coefficients:
        out = out * x + a
    return out


def shapiro_wilk(df: DataFrame, value: str, ranks_at_once: int = 100_000) -> DataFrame:
    """One row (n, w, z, p): Shapiro-Wilk test of normality of a column, for n of 3 or more (else null).

    Weights depend on ranks alone. Ranks are those of the distinct values (``value_ranks``); a tied value takes the weights of
    all its ranks, which are summed in stretches dealt over the tasks. Only sums come to the driver.
    """
    from statistics import NormalDist

    from genolake.functions.distributions import normal_quantile_sql

    schema = "n long, w double, z double, p double"
    ranks = value_ranks(df.select(F.col(value).cast("double").alias("x")), "x")
    tally = ranks.agg(F.sum("size").alias("n"), (F.sum(F.col("size") * F.col("x")) / F.sum("size")).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    n = tally["n"] or 0
    if n < 3 or tally["low"] == tally["high"]:
        return df.sparkSession.createDataFrame([(n, None, None, None)], schema)
    cut = ranks.select("x", F.col("below").alias("first"), (F.col("below") + F.col("size") - 1).alias("last"))
    cut = cut.select("x", "last", F.explode(F.sequence(F.col("first"), F.col("last"), F.lit(ranks_at_once))).alias("first"))
    cut = cut.select("x", "first", F.least("last", F.col("first") + ranks_at_once - 1).alias("last")).repartition(partitions(df.sparkSession))
    each = cut.select("x", F.explode(F.sequence("first", "last")).alias("i")).withColumn("u", F.expr(f"(i + 0.625E0) / ({n} + 0.25E0)"))
    each = each.select("x", "i", F.expr(normal_quantile_sql("u")).alias("m"))
    edge = F.when(F.col("i") == 0, "first").when(F.col("i") == 1, "second").when(F.col("i") == n - 1, "last").when(F.col("i") == n - 2, "next").otherwise("middle")
    found = {r["edge"]: r for r in each.groupBy(edge.alias("edge")).agg(F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("x")).alias("mx"), F.min("x").alias("x"), F.max("m").alias("m")).collect()}
    spread = ranks.agg(F.sum(F.col("size") * (F.col("x") - F.lit(tally["mean"])) * (F.col("x") - F.lit(tally["mean"]))).alias("s")).first()["s"]
    mm, u = sum(r["mm"] for r in found.values()), n**-0.5
    top, after = (NormalDist().inv_cdf((k + 0.625) / (n + 0.25)) for k in (n - 1, n - 2))
    last = top / mm**0.5 + u * _polynomial(u, SHAPIRO_LAST)
    if n == 3:
        last = 0.5**0.5
    wx = last * (tally["high"] - tally["low"])
    if n > 5:
        second = after / mm**0.5 + u * _polynomial(u, SHAPIRO_NEXT)
        phi = (mm - 2 * top * top - 2 * after * after) / (1 - 2 * last * last - 2 * second * second)
        wx += second * (found["next"]["x"] - found["second"]["x"]) + found["middle"]["mx"] / phi**0.5
    elif n > 3:
        phi = (mm - 2 * top * top) / (1 - 2 * last * last)
        wx += sum(r["mx"] for e, r in found.items() if e not in ("first", "last")) / phi**0.5
    w = min(1.0, wx * wx / spread)
    if n == 3:
        p = max(0.0, 6 / math.pi * (math.asin(w**0.5) - math.asin(0.75**0.5)))
        return df.sparkSession.createDataFrame([(n, w, None, p)], schema)
    if n < 12:
        gamma = 0.459 * n - 2.273
        y = -math.log(gamma - math.log1p(-w)) if w < 1 and gamma > math.log1p(-w) else -math.inf
        mean, dev = _polynomial(n, SHAPIRO_SMALL_MEAN), math.exp(_polynomial(n, SHAPIRO_SMALL_SPREAD))
    else:
        y = math.log1p(-w) if w < 1 else -math.inf
        mean, dev = _polynomial(math.log(n), SHAPIRO_MEAN), math.exp(_polynomial(math.log(n), SHAPIRO_SPREAD))
    z = (y - mean) / dev
    return df.sparkSession.createDataFrame([(n, w, z, 0.5 * math.erfc(z / 2**0.5))], schema)


def log10_sum(df: DataFrame, value: str, by: str) -> DataFrame:
    """log10 of the mean of 10**value, kept in range by the largest value."""
    top = df.groupBy(by).agg(F.max(value).alias("_top"))
    return df.join(top, by).groupBy(by).agg((F.log10(F.avg(F.pow(F.lit(10.0), F.col(value) - F.col("_top")))) + F.max("_top")).alias("log10_mean"))


def log10_weighted_sum(df: DataFrame, value: str, weight: str, by: str) -> DataFrame:
    """log10 of the weighted sum of 10**value, kept in range by the largest value."""
    top = df.groupBy(by).agg(F.max(value).alias("_top"))
    terms = F.col(weight) * F.pow(F.lit(10.0), F.col(value) - F.col("_top"))
    return df.join(top, by).groupBy(by).agg((F.log10(F.sum(terms)) + F.max("_top")).alias("log10_sum"))


def normal_scores(df: DataFrame, value: str, key: str, by: str) -> DataFrame:
    """Rank-based inverse normal transformation within groups."""
    from genolake.functions.distributions import normal_quantile_sql

    w = Window.partitionBy(by)
    r = df.withColumn("i", F.row_number().over(w.orderBy(value, key))).withColumn("n", F.count("*").over(w))
    a = "(CASE WHEN n <= 10 THEN 0.375E0 ELSE 0.5E0 END)"
    return r.withColumn("_p", F.expr(f"(i - {a}) / (n + 1E0 - 2E0 * {a})")).withColumn("score", F.expr(normal_quantile_sql("_p"))).drop("i", "n", "_p")
