"""Breeding programmes: phenotypes, budgets, registration, mixed models and genomic prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.operators.blocks import conjugate_gradients, gram, gram_times, packed_columns
from genolake.operators.skew import hand_back
from genolake.operators.statistics import steady_mean, value_ranks
from genolake.session import checkpoint


#: Individuals up to which a cohort is a matrix: one pass over the markers instead of one per round.
DENSE = 5000


def yield_loss(pheno: DataFrame, share: float = 0.2) -> DataFrame:
    """The pathogen takes a share of the yield of susceptible plants."""
    hit = F.col("pathogen") & (F.col("trait3") == 1)
    return pheno.withColumn("trait1", F.when(hit, F.col("trait1") * (1 - share)).otherwise(F.col("trait1")))


def pathogen_years(pheno: DataFrame, first: int = 2005, every: int = 3) -> DataFrame:
    return pheno.withColumn("pathogen_year", (F.col("year") - first) % every == 0)


def individual_means(pheno: DataFrame) -> DataFrame:
    return pheno.groupBy("ind").agg(steady_mean("trait1").alias("trait1"), steady_mean("trait2").alias("trait2"), F.count("*").alias("n"))


def best_controls(means: DataFrame, share: float = 0.1) -> DataFrame:
    """The best tenth by trait 1, if above the mean in trait 2. The cut is a value, found without a global sort."""
    n = means.count()
    k = -(-n // round(1 / share))
    top = means.orderBy(F.desc("trait1"), "ind").limit(k)
    mean2 = means.agg(F.avg("trait2").alias("mean2"))
    return top.crossJoin(F.broadcast(mean2)).filter("trait2 > mean2").select("ind", "trait1", "trait2")


def registered(candidates: DataFrame, controls: DataFrame, gain: float = 1.03, least2: float = 14.0) -> DataFrame:
    """Candidates that beat the controls' mean of trait 1 and reach a level of trait 2, with their yield and its rank, the highest first.

    Equal yields (to nine decimals) share a rank, and the next one counts them all. Ranks are taken per distinct yield and handed back
    to rows that are kept, as a yield that is computed once more may be rounded to another one.
    """
    mean = controls.agg(F.avg("trait1").alias("control1"))
    ok = (F.col("trait1") >= gain * F.col("control1")) & (F.col("trait2") >= least2)
    rows = candidates.crossJoin(F.broadcast(mean)).select("ind", "trait1", "trait2", (F.col("trait1") * F.col("trait2") / 100).alias("yield"), ok.alias("registered"))
    rows = checkpoint(rows.withColumn("_low", -F.round("yield", 9)))
    ranks = value_ranks(rows, "_low").select("_low", "size", (F.col("below") + 1).alias("rank"))
    ranked = hand_back(rows.filter("_low is not null"), ranks, "_low", "size").unionByName(rows.filter("_low is null"), allowMissingColumns=True)
    return ranked.drop("_low")


def budget(ledger: DataFrame, costs: dict[str, float]) -> DataFrame:
    """Cost per breeder and task with totals per breeder and over all."""
    price = F.coalesce(F.create_map(*[F.lit(x) for kv in costs.items() for x in kv])[F.col("task")], F.lit(0.0))
    spent = ledger.withColumn("cost", F.col("quantity") * price)
    return spent.rollup("breeder", "task").agg(F.sum("quantity").alias("quantity"), F.sum("cost").alias("cost"))


def requests_in_order(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Crosses whose parents exist and whose child does not yet."""
    have = existing.select("ind").distinct()
    ok = requests.join(have.withColumnRenamed("ind", "parent1"), "parent1", "left_semi")
    second = have.withColumnRenamed("ind", "parent2").withColumn("_two", F.lit(True))
    ok = ok.join(second, "parent2", "left").filter("parent2 is null or _two").drop("_two")
    return ok.join(have.withColumnRenamed("ind", "child"), "child", "left_anti")


def variance_components(pheno: DataFrame, trait: str = "trait1") -> DataFrame:
    """Mixed model with a mean and a random individual effect, by restricted maximum likelihood.

    Individuals enter by their number of records and sums; those that agree in the number of records add up to one row,
    so what the search reads is as long as there are different numbers, not individuals.
    """
    import numpy as np

    per = pheno.filter(F.col(trait).isNotNull()).groupBy("ind").agg(F.count("*").alias("n"), F.avg(trait).alias("m"), F.sum(F.col(trait) * F.col(trait)).alias("ss"))
    rows = per.groupBy("n").agg(F.count("*").alias("k"), F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("s2"), F.sum(F.col("ss") - F.col("n") * F.col("m") * F.col("m")).alias("within")).orderBy("n").collect()
    n, k, s, s2, within = (np.array([float(r[c]) for r in rows]) for c in ("n", "k", "s", "s2", "within"))
    total, inds = float((n * k).sum()), float(k.sum())

    def deviance(ratio: float) -> tuple[float, float, float]:
        w = n / (1 + ratio * n)
        mu = (w * s).sum() / (w * k).sum()
        rss = within.sum() + (w * (s2 - 2 * mu * s + k * mu * mu)).sum()
        sigma = rss / (total - 1)
        return (total - 1) * np.log(max(sigma, 1e-300)) + (k * np.log1p(ratio * n)).sum() + np.log((w * k).sum()), mu, sigma

    low, high = -12.0, 12.0  # log of the ratio; golden section
    g = (5**0.5 - 1) / 2
    for _ in range(80):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if deviance(np.exp(a))[0] < deviance(np.exp(b))[0] else (a, high)
    ratio = float(np.exp((low + high) / 2))
    dev, mu, sigma = deviance(ratio)
    va, mean_n = ratio * sigma, total / inds
    row = (float(mu), float(va), float(sigma), float(va / (va + sigma)), float(va / (va + sigma / mean_n)), float(dev))
    return pheno.sparkSession.createDataFrame([row], "mu double, var_g double, var_e double, h2 double, h2_design double, deviance double")


def blups(pheno: DataFrame, mu: float, var_g: float, var_e: float, trait: str = "trait1") -> DataFrame:
    """Predicted effects of individuals, given the variances."""
    per = pheno.groupBy("ind").agg(F.count(trait).alias("n"), F.avg(trait).alias("m"))
    return per.select("ind", "n", (F.col("n") * var_g / (F.col("n") * var_g + var_e) * (F.col("m") - mu)).alias("blup"))


def reml_ratio(values, ones, y) -> float:
    """Ratio of error to genetic variance with the highest restricted likelihood, for a model of a mean and one random effect.

    values: eigenvalues of the relationship; ones and y: the mean's column and the phenotype in its eigenvectors. The
    likelihood is profiled on a grid of the ratio's logarithm, then around its top.
    """
    import numpy as np

    values = np.clip(values, 0, None)

    def likelihood(log_ratio: float) -> float:
        w = 1 / (values + np.exp(log_ratio))
        xx = (w * ones * ones).sum()
        rest = y - ones * ((w * ones * y).sum() / xx)
        return -0.5 * ((len(y) - 1) * np.log((w * rest * rest).sum()) - np.log(w).sum() + np.log(xx))

    low, high = np.log(1e-5 * max(values.max(), 1e-9)), np.log(1e5 * max(values.max(), 1e-9))
    for _ in range(6):
        grid = np.linspace(low, high, 41)
        top = int(np.argmax([likelihood(x) for x in grid]))
        low, high = grid[max(0, top - 1)], grid[min(40, top + 1)]
    return float(np.exp((low + high) / 2))


def _cohort(doses: DataFrame, pheno: DataFrame, most_inds: int):
    """(individuals, phenotypes, centred doses, blocks of them) of a cohort of bounded size."""
    import numpy as np

    ys = {r["ind"]: r["y"] for r in pheno.limit(most_inds + 1).collect()}
    if len(ys) > most_inds:
        raise ValueError(f"at most {most_inds} individuals")
    inds = sorted(ys)
    freq = doses.groupBy("snp").agg(F.avg("g").alias("c"))
    z = doses.join(freq, "snp").select("ind", "snp", (F.col("g") - F.col("c")).alias("z"))
    return inds, np.array([ys[i] for i in inds], dtype=float), z, checkpoint(packed_columns(z, inds))


def _estimated(k, y) -> float:
    import numpy as np

    values, vectors = np.linalg.eigh(k)
    return reml_ratio(values, vectors.T @ np.ones(len(y)), vectors.T @ y)


def ridge_effects(doses: DataFrame, pheno: DataFrame, penalty: float | None = None, most_inds: int = 5000, dense: int = DENSE):
    """Ridge-regression marker effects. doses: (ind, snp, g); pheno: (ind, y). Returns (effects DataFrame, mean).

    Without a penalty it is the ratio of variances by REML, from the cohort's matrix, so ``most_inds`` is a bound of memory. With a penalty, a cohort of more than ``dense`` individuals is
    solved by conjugate gradients over blocks of markers, and ``most_inds`` may be millions: the driver holds vectors only. The results are the same.
    """
    import numpy as np

    inds, y, _, blocks = _cohort(doses, pheno, most_inds)
    mean = float(y.mean())
    if penalty is None or len(inds) <= dense:
        k = gram(blocks, len(inds))
        alpha = np.linalg.solve(k + (_estimated(k, y) if penalty is None else penalty) * np.eye(len(inds)), y - mean)
    else:
        alpha = conjugate_gradients(blocks, (y - mean)[:, None], np.array([float(penalty)]))[:, 0]
    sent = doses.sparkSession.sparkContext.broadcast(alpha)
    kind = doses.schema["snp"].dataType.simpleString()

    def effects(batches):
        import pyarrow as pa

        for batch in batches:
            for names, raw in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([names.values, pa.array(np.frombuffer(raw).reshape(-1, len(sent.value)) @ sent.value)], names=["snp", "effect"])

    return blocks.mapInArrow(effects, f"snp {kind}, effect double"), mean


def additive_variance(doses: DataFrame, var_u: float) -> DataFrame:
    """(sum_het, var_a): summed heterozygosity of the markers, and the additive variance of markers whose effects have variance ``var_u``."""
    per = doses.groupBy("snp").agg((F.avg("g") / 2).alias("f"))
    return per.agg(F.sum(2 * F.col("f") * (1 - F.col("f"))).alias("sum_het")).select("sum_het", (F.col("sum_het") * var_u).alias("var_a"))


def ridge_variances(doses: DataFrame, pheno: DataFrame, most_inds: int = 5000) -> DataFrame:
    """One row: variance of marker effects and of errors by REML, their ratio (the penalty), and the additive variance of the markers."""
    import numpy as np

    inds, y, _, blocks = _cohort(doses, pheno, most_inds)
    values, vectors = np.linalg.eigh(gram(blocks, len(inds)))
    ones, turned = vectors.T @ np.ones(len(inds)), vectors.T @ y
    penalty = reml_ratio(values, ones, turned)
    weight = 1 / (np.clip(values, 0, None) + penalty)
    rest = turned - ones * ((weight * ones * turned).sum() / (weight * ones * ones).sum())
    var_u = float((weight * rest * rest).sum() / (len(inds) - 1))
    found = additive_variance(doses, var_u)
    return found.select(F.lit(var_u).alias("var_u"), F.lit(var_u * penalty).alias("var_e"), F.lit(penalty).alias("penalty"), "sum_het", "var_a")


def predict(doses: DataFrame, effects: DataFrame, mean: float) -> DataFrame:
    freq = doses.groupBy("snp").agg(F.avg("g").alias("c"))
    return doses.join(freq, "snp").join(effects, "snp").groupBy("ind").agg((F.sum((F.col("g") - F.col("c")) * F.col("effect")) + mean).alias("predicted"))


def cross_validate(doses: DataFrame, pheno: DataFrame, penalty: float | None = None, folds: int = 5, repeats: int = 10, most_inds: int = 5000, dense: int = DENSE) -> DataFrame:
    """Error and correlation per repeat and fold; folds are dealt by a hash of individual and repeat.

    The cohort's matrix is summed once and goes to the tasks, to which the folds are dealt; without a penalty each fold has its own by REML. With
    a penalty and more than ``dense`` individuals, all folds are solved together by conjugate gradients over blocks of markers, without such a matrix.
    """
    import numpy as np

    spark = doses.sparkSession
    inds, y, _, blocks = _cohort(doses, pheno, most_inds)
    dealt = pheno.select("ind", *[F.pmod(F.xxhash64("ind", F.lit(r)), F.lit(folds)).alias(f"f{r}") for r in range(repeats)])
    fold_of = {r["ind"]: r for r in dealt.collect()}  # bounded by the cohort
    fold = np.array([[fold_of[i][f"f{r}"] for i in inds] for r in range(repeats)]).reshape(repeats, len(inds))
    plans = [(r, f) for r in range(repeats) for f in range(folds) if (fold[r] == f).any() and (fold[r] != f).sum() > 1]
    schema = "rep int, fold int, n long, rmspe double, r double"

    def scored(rep, f, predicted, truth):
        spread = predicted.std() * truth.std()
        r = float(((predicted - predicted.mean()) * (truth - truth.mean())).mean() / spread) if spread > 0 else None
        return rep, f, len(truth), float(np.sqrt(((predicted - truth) ** 2).mean())), r

    if not plans:
        return spark.createDataFrame([], schema)
    if penalty is not None and len(inds) > dense:
        masks = np.stack([fold[r] != f for r, f in plans], axis=1).astype(float)
        means = (y @ masks) / masks.sum(axis=0)
        alpha = conjugate_gradients(blocks, (y[:, None] - means) * masks, np.full(len(plans), float(penalty)), masks)
        fitted = gram_times(blocks, alpha) + means
        rows = [scored(r, f, fitted[fold[r] == f, k], y[fold[r] == f]) for k, (r, f) in enumerate(plans)]
        return spark.createDataFrame(rows, schema)
    shared = spark.sparkContext.broadcast((gram(blocks, len(inds)), y, fold))

    def solve(batches):
        import pyarrow as pa

        k, y, fold = shared.value
        for batch in batches:
            rows = []
            for rep, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                test, train = np.flatnonzero(fold[rep] == f), np.flatnonzero(fold[rep] != f)
                mean, own = y[train].mean(), k[np.ix_(train, train)]
                ratio = _estimated(own, y[train]) if penalty is None else penalty
                predicted = mean + k[np.ix_(test, train)] @ np.linalg.solve(own + ratio * np.eye(len(train)), y[train] - mean)
                rows.append(scored(rep, f, predicted, y[test]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["rep", "fold", "n", "rmspe", "r"])

    return spark.createDataFrame(plans, "rep int, fold int").repartition(len(plans)).mapInArrow(solve, schema)


def marker_scan(doses: DataFrame, pheno: DataFrame, var_ratio: float | None = None, most_inds: int = 5000) -> DataFrame:
    """Mixed-model scan of single markers: phenotype and doses are rotated by the relationship's eigenvectors, then
    each marker has a weighted regression of its own. Blocks of markers are rotated as matrices in their tasks.

    ``var_ratio`` is genetic over error variance; without it, it is estimated by REML.
    """
    import numpy as np

    from genolake.functions.distributions import t_pvalue

    inds, y, _, blocks = _cohort(doses, pheno, most_inds)
    kin = gram(blocks, len(inds))
    kin /= max(1e-9, np.trace(kin) / len(inds))
    values, vectors = np.linalg.eigh(kin)
    ones, yt = vectors.T @ np.ones(len(inds)), vectors.T @ (y - y.mean())
    ratio = 1 / reml_ratio(values, ones, yt) if var_ratio is None else var_ratio
    weight = 1 / (ratio * np.clip(values, 0, None) + 1)
    shared = doses.sparkSession.sparkContext.broadcast((vectors, weight, ones, yt))

    def run(batches):
        import pyarrow as pa

        vectors, w, o, y = shared.value
        for batch in batches:
            for names, raw in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw).reshape(-1, len(y)) @ vectors
                sums = [(x * x) @ w, x @ (w * o), np.full(len(x), (w * o * o).sum()), x @ (w * y), np.full(len(x), (w * o * y).sum()), np.full(len(x), (w * y * y).sum())]
                yield pa.RecordBatch.from_arrays([names.values, pa.array(np.full(len(x), len(y))), *map(pa.array, sums)], names=["snp", "n", "xx", "xo", "oo", "xy", "oy", "yy"])

    kind = doses.schema["snp"].dataType.simpleString()
    m = blocks.mapInArrow(run, f"snp {kind}, n long, xx double, xo double, oo double, xy double, oy double, yy double")
    c = F.col
    det = c("xx") * c("oo") - c("xo") * c("xo")
    m = m.filter(det > 1e-9).withColumn("beta", (c("xy") * c("oo") - c("xo") * c("oy")) / det).withColumn("mu", (c("oy") * c("xx") - c("xo") * c("xy")) / det)
    m = m.withColumn("rss", c("yy") - c("beta") * c("xy") - c("mu") * c("oy")).withColumn("se", F.sqrt(F.greatest(c("rss"), F.lit(1e-12)) / (c("n") - 2) * c("oo") / det))
    return m.withColumn("t", c("beta") / c("se")).select("snp", "n", "beta", "se", t_pvalue(c("t"), c("n") - 2).alias("p_wald"))


def variance_budget(mu: float, cv_g: float, low: float, h2: float, sum_het: float) -> dict[str, float]:
    """Variances of a simulated trait from its mean, its lowest value, heritability and heterozygosity."""
    total, additive = ((mu - low) / 3) ** 2, (cv_g * mu) ** 2
    error = (1 - h2) / h2 * additive
    return {"var_p": total, "var_a": additive, "var_e": error, "var_year": total - additive - error, "var_beta": additive / (2 * sum_het)}
