"""Statistical operators against independent computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolake.functions import distributions as dist
from genolake.operators import association as assoc
from genolake.operators import breeding as br
from genolake.operators import expression as ex
from genolake.operators import genotypes as gt
from genolake.operators import relational as rel
from genolake.operators import statistics as st
from genolake.operators import variants as va


def test_distributions(spark):
    assert np.allclose(dist.incomplete_beta(2.0, 3.0, [0.1, 0.5, 0.9]), [0.0523, 0.6875, 0.9963], atol=1e-6)
    assert np.allclose(dist.t_two_sided([0.0, 2.228139, 1.0], [10, 10, 1]), [1.0, 0.05, 0.5], atol=1e-6)
    assert np.allclose(dist.f_upper([4.964603], 1, 10), [0.05], atol=1e-6)
    got = spark.sql("SELECT " + ", ".join(dist.normal_quantile_sql(f"{p}E0") + f" AS q{i}" for i, p in enumerate((0.5, 0.975, 0.001)))).first()
    assert np.allclose(list(got), [0, 1.959963985, -3.090232306], atol=1e-8)
    low = spark.range(1).select(dist.smallest_of(F.lit(0.01), F.lit(10)).alias("p")).first().p
    assert math.isclose(low, 1 - 0.99**10)


def test_bh_and_ranks(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.uniform(size=400), 2)  # many ties
    df = spark.createDataFrame([(i % 7, i, float(x)) for i, x in enumerate(p)], "gene int, snp int, p double")
    ranks = {r.snp: r.rk for r in st.ranked(df, "p", "snp").collect()}
    order = sorted(range(400), key=lambda i: (p[i], i))
    assert ranks == {i: k + 1 for k, i in enumerate(order)}
    q = {r.snp: r.q for r in st.bh(df).collect()}
    running, expected = 1.0, {}
    for k in range(399, -1, -1):
        running = min(running, 400 * p[order[k]] / (k + 1))
        expected[order[k]] = running
    assert all(math.isclose(q[i], expected[i], abs_tol=1e-12) for i in q)
    storey = {r.snp: r.qvalue for r in st.storey(df).collect()}
    share = st.pi0(df).first().pi0
    assert 0 < share <= 1 and all(math.isclose(storey[i], share * q[i], abs_tol=1e-12) for i in q)
    for method in ("1a", "1b", "2", "3"):
        assert assoc.egenes(df, method).count() == 7
    with pytest.raises(ValueError):
        assoc.egenes(df, "4")


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(0, x, y) for x, y in ((1.0, 2.0), (2.0, 2.0), (2.0, 3.0), (3.0, 1.0), (4.0, 5.0))], "g int, x double, y double")
    rx, ry = [1, 2.5, 2.5, 4, 5], [2.5, 2.5, 4, 1, 5]
    assert math.isclose(st.spearman(df, "x", "y", "g").first().spearman, np.corrcoef(rx, ry)[0, 1])


def test_linear_models(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=50), rng.normal(size=50)
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, y, strict=True)], "g int, x double, y double")
    r = st.ols(df, "x", "y", "g").first()
    slope, inter = np.polyfit(x, y, 1)
    rss = ((y - slope * x - inter) ** 2).sum()
    assert np.allclose([r.slope, r.sigma, r.r2], [slope, np.sqrt(rss / 48), 1 - rss / ((y - y.mean()) ** 2).sum()])


def test_confounders_and_components(spark):
    rng = np.random.default_rng(3)
    v, c = rng.normal(size=(6, 20)), rng.normal(size=(20, 2))
    values = spark.createDataFrame([(g, i, float(v[g, i])) for g in range(6) for i in range(20)], "gene int, ind int, v double")
    conf = spark.createDataFrame([(i, f"c{k}", float(c[i, k])) for i in range(20) for k in range(2)], "ind int, name string, c double")
    z = (v - v.mean(1, keepdims=True)) / v.std(1, ddof=1, keepdims=True)
    expected = z.T - c @ np.linalg.lstsq(c, z.T, rcond=None)[0]
    got = {(r.gene, r.ind): r.residual for r in ex.remove_confounders(values, conf).collect()}
    assert all(math.isclose(got[g, i], expected[i, g], abs_tol=1e-9) for g in range(6) for i in range(20))
    pcs = ex.components(values).collect()
    cols = (v - v.mean(0)) / v.std(0, ddof=1)
    assert np.allclose([r.variance for r in pcs], np.clip(np.linalg.eigvalsh(np.cov(cols.T))[::-1], 0, None), atol=1e-9)
    assert math.isclose(pcs[-1].cumulative, 1.0)


def test_relationships_are_symmetric_sums(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, size=(8, 30))
    doses = spark.createDataFrame([(i, s, s // 10, int(g[i, s])) for i in range(8) for s in range(30)], "ind int, snp int, block int, g int")
    f = g.mean(0) / 2
    z = g - 2 * f
    expected = z @ z.T / (2 * f * (1 - f)).sum()
    assert all(math.isclose(r.relationship, expected[r.ind1, r.ind2], abs_tol=1e-9) for r in gt.relationships(doses).collect())
    assert all(-1e-12 <= r.r2 <= 1 + 1e-12 for r in gt.linkage(doses).collect())


def test_greedy(spark):
    snps = spark.createDataFrame([(i, "c1", p) for i, p in enumerate((5, 6, 10, 16, 17, 30))] + [(9, "c2", 1)], "snp long, chrom string, pos long")
    assert sorted((r.chrom, r.chunk_start, r.n_snps) for r in gt.chunks(snps, 10).collect()) == [("c1", 5, 3), ("c1", 16, 2), ("c1", 30, 1), ("c2", 1, 1)]
    assert sorted(r.pos for r in gt.thin(snps, 10).collect()) == [1, 5, 16, 30]


def test_cis_pairs_meet_once(spark):
    genes = spark.createDataFrame([(1, "c", 1000), (2, "c", 50)], "gene int, chrom string, tss long")
    snps = spark.createDataFrame([(i, "c", i * 10) for i in range(0, 250)], "snp int, chrom string, pos long")
    got = [(r.gene, r.snp) for r in assoc.cis_pairs(genes, snps, 300).collect()]
    expected = [(g, s) for g, t in ((1, 1000), (2, 50)) for s in range(250) if abs(s * 10 - t) <= 300]
    assert sorted(got) == sorted(expected)


def test_mixed_models(spark):
    rng = np.random.default_rng(5)
    u = rng.normal(scale=2.0, size=200)
    rows = [(i, float(10 + u[i] + rng.normal(scale=1.0))) for i in range(200) for _ in range(1 + i % 6)]
    pheno = spark.createDataFrame(rows, "ind int, trait1 double")
    r = br.variance_components(pheno).first()
    assert abs(r.var_g - u.var(ddof=1)) < 0.8 and abs(r.var_e - 1) < 0.15 and abs(r.mu - 10) < 0.5
    effects = {x.ind: x.blup for x in br.blups(pheno, r.mu, r.var_g, r.var_e).collect()}
    assert np.corrcoef([effects[i] for i in range(200)], u)[0, 1] > 0.85
    g = rng.integers(0, 3, size=(60, 40))
    y = g[:, :5].sum(1) + rng.normal(scale=0.3, size=60)
    doses = spark.createDataFrame([(i, s, int(g[i, s])) for i in range(60) for s in range(40)], "ind int, snp int, g int")
    ys = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "ind int, y double")
    got, mean = br.ridge_effects(doses, ys, 2.0)
    z = g - g.mean(0)
    expected = z.T @ np.linalg.solve(z @ z.T + 2.0 * np.eye(60), y - y.mean())
    assert all(math.isclose(x.effect, expected[x.snp], abs_tol=1e-8) for x in got.collect())
    scan = {x.snp: x.p_wald for x in br.marker_scan(doses, ys, 0.0).collect()}
    X = np.column_stack([np.ones(60), z[:, 0]])
    beta, rss = np.linalg.lstsq(X, y - y.mean(), rcond=None)[:2]
    t = beta[1] / np.sqrt(rss[0] / 58 * np.linalg.inv(X.T @ X)[1, 1])
    assert math.isclose(scan[0], dist.t_two_sided([t], [58])[0], rel_tol=1e-6)
    assert br.cross_validate(doses, ys, 2.0, folds=2, repeats=1).count() == 2


def test_variants_and_pedigrees(spark):
    g = spark.createDataFrame([(1, 1, 30, 50, 0), (1, 2, 30, 50, 0), (1, 3, 30, 50, 1), (2, 1, 30, 50, 1), (2, 2, 30, 50, 2), (2, 3, 30, 50, 1), (2, 4, 5, 50, 1)], "site int, ind int, dp int, gq int, gt int")
    trios = spark.createDataFrame([(3, 1, 2)], "child int, mother int, father int")
    assert [(r.site, r.child) for r in va.mendelian_violations(va.mask_genotypes(g), trios).collect()] == [(1, 3)]
    assert va.mask_genotypes(g).filter("gt is null").count() == 1
    assert {r.site: r.n_alleles for r in va.allelicity(g).collect()} == {1: 2, 2: 2}


def test_relational(spark):
    a = spark.createDataFrame([(0, "x 1", "A"), (1, "y 1", "C")], "file_pos long, read_id1 string, seq1 string")
    b = spark.createDataFrame([(0, "x 2", "G"), (1, "z 2", "T")], "file_pos long, read_id2 string, seq2 string")
    assert rel.zip_mates(a.filter("file_pos = 0"), b).first().name == "x"
    with pytest.raises(Exception, match="mates differ"):
        rel.zip_mates(a, b).collect()
    with pytest.raises(Exception, match="duplicate"):
        rel.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()
    files = spark.createDataFrame([("a_pheno", "s1", f"ind{i}", i - 1) for i in (1, 2, 3)] + [("b_geno", "s2", "ind1", 0), ("b_geno", "s2", "ind4", 1)], "kind string, subgroup string, sample string, pos int")
    assert rel.sample_union(files).select("sample").distinct().count() == 4
    assert math.isclose(br.variance_budget(50, 0.1, 20, 0.5, 100)["var_a"], 25)


def test_cross_products_by_blocks(spark):
    from genolake.operators.blocks import cross_products

    rng = np.random.default_rng(7)
    cells = [(int(i), int(s), float(rng.normal())) for s in range(50) for i in rng.permutation(9)[: rng.integers(1, 9)]]
    df = spark.createDataFrame([*cells, (1, 60, None)], "ind int, snp int, z double")
    by = {}
    for i, s, z in cells:
        by.setdefault(s, {})[i] = z
    expected = {}
    for col in by.values():
        for a in col:
            for b in col:
                if a <= b:
                    c, n = expected.get((a, b), (0.0, 0))
                    expected[a, b] = (c + col[a] * col[b], n + 1)
    got = {(r.row1, r.row2): (r.cross, r.n) for r in cross_products(df, "ind", "snp", "z", 7).collect()}
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k][0], expected[k][0], abs_tol=1e-9) and got[k][1] == expected[k][1] for k in got)


def test_other_relationships(spark):
    rng = np.random.default_rng(8)
    g = rng.integers(0, 3, size=(6, 20))
    g[:, 0] = 1
    doses = spark.createDataFrame([(i, s, 0, int(g[i, s])) for i in range(6) for s in range(20)], "ind int, snp int, block int, g int")
    f = g.mean(0) / 2
    z = (g - 2 * f) / np.sqrt(2 * f * (1 - f))
    expected = z @ z.T / 20
    assert all(math.isclose(r.relationship, expected[r.ind1, r.ind2], abs_tol=1e-9) for r in gt.relationships(doses, method="standardised").collect())
    with pytest.raises(ValueError):
        gt.relationships(doses, method="x")
    pcs = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.3, 0.8), (3, 0.2, 1.0)], "pc int, share double, cumulative double")
    assert ex.enough_components(pcs, share=0.75) == 2 and ex.enough_components(pcs, least_drop=0.15) == 2


def test_linkage_of_all_crosses_blocks(spark):
    rng = np.random.default_rng(8)
    g = rng.integers(0, 3, (65, 20)).astype(float)
    g[rng.random(g.shape) < 0.1] = np.nan
    g[7] = 1  # no variation
    rows = [(i, s, s // 30, None if np.isnan(g[s, i]) else int(g[s, i])) for s in range(65) for i in range(20) if (s + i) % 11]
    doses = spark.createDataFrame(rows, "ind int, snp long, block long, g int")
    held = {(s, i): x for i, s, _, x in rows if x is not None}
    expected = {}
    for a in range(65):
        for b in range(a + 1, 65):
            both = [(held[a, i], held[b, i]) for i in range(20) if (a, i) in held and (b, i) in held]
            x, y = np.array(both).T
            if x.std() > 0 and y.std() > 0:
                expected[a, b] = (len(both), np.corrcoef(x, y)[0, 1] ** 2)
    for at_once in (256, 9):
        got = {(r.snp1, r.snp2): (r.n, r.r2) for r in gt.linkage_of_all(doses, at_once).collect()}
        assert got.keys() == expected.keys() and (29, 30) in got
        assert all(got[k][0] == n and math.isclose(got[k][1], r2, abs_tol=1e-9) for k, (n, r2) in expected.items())
    assert gt.linkage_of_all(doses.limit(0)).count() == 0


def test_association_with_covariates_and_covariance(spark):
    import numpy as np

    from genolake.operators import association as assoc

    r = np.random.default_rng(6)
    n = 40
    c, g = r.normal(size=n), r.integers(0, 3, n).astype(float)
    y = 2 * c + 0.3 * g + r.normal(size=n)
    root = r.normal(size=(n, n)) / 8 + np.eye(n)
    errors = root @ root.T
    expr = spark.createDataFrame([("e", i, float(y[i])) for i in range(n)] + [("short", 1, 2.0)], "gene string, ind long, v double")
    dose = spark.createDataFrame([("m", i, float(g[i])) for i in range(n)] + [("flat", i, 1.0) for i in range(n)], "snp string, ind long, g double")
    cov = spark.createDataFrame([(i, "c", float(c[i])) for i in range(n)], "ind long, name string, c double")
    err = spark.createDataFrame([(i, j, float(errors[i, j])) for i in range(n) for j in range(n)], "ind1 long, ind2 long, v double")
    pairs = spark.createDataFrame([("e", "m"), ("e", "flat"), ("short", "m")], "gene string, snp string")

    def least_squares(w):
        x, z = w @ np.column_stack([np.ones(n), c, g]), w @ y
        beta, rss, _, _ = np.linalg.lstsq(x, z, rcond=None)
        return beta[2] / np.sqrt(rss[0] / (n - 3) * np.linalg.inv(x.T @ x)[2, 2])

    values, vectors = np.linalg.eigh(errors)
    for covariance, white in ((None, np.eye(n)), (err, vectors @ np.diag(values**-0.5) @ vectors.T)):
        got = assoc.pair_tests(pairs, expr, dose, cov, covariance).collect()
        assert [(x.gene, x.snp, x.n, x.df) for x in got] == [("e", "m", n, n - 3)]
        assert abs(got[0].t - least_squares(white)) < 1e-9
    p = assoc.with_pvalues(assoc.pair_tests(pairs, expr, dose, cov), 1.0).first().p
    assert 0 < p < 1 and assoc.with_pvalues(assoc.pair_tests(pairs, expr, dose, cov), p / 2).count() == 0
    ss = lambda v: ((v - v.mean()) ** 2).sum()
    within = sum(ss(y[g == k]) for k in range(3))
    f = assoc.anova_tests(pairs, expr, dose).collect()
    assert [(x.gene, x.snp, x.df1, x.df2) for x in f] == [("e", "m", 2, n - 3)] and abs(f[0].f - (ss(y) - within) / 2 / (within / (n - 3))) < 1e-9
    traits = spark.createDataFrame([(k, i, float(v[i])) for k, v in (("a", y), ("b", g)) for i in range(n)], "item string, ind long, value double")
    x = np.column_stack([np.ones(n), c])
    m = np.eye(n) - x @ np.linalg.pinv(x)
    expected = {("a", "a"): y @ m @ y / n, ("a", "b"): y @ m @ g / n, ("b", "b"): g @ m @ g / n}
    assert all(abs(q.v - expected[q.item1, q.item2]) < 1e-9 for q in assoc.error_covariance(traits, cov).collect())


def test_all_pairs_in_blocks(spark):
    import numpy as np

    from genolake.operators import association as assoc

    r = np.random.default_rng(7)
    expr = [(f"e{k}", i, float(r.normal())) for k in range(7) for i in range(20) if r.random() < 0.9]
    dose = [(k, i, int(r.integers(0, 3))) for k in range(9) for i in range(20) if r.random() < 0.9]
    e, d = spark.createDataFrame(expr, "gene string, ind long, v double"), spark.createDataFrame(dose, "snp long, ind long, g int")
    expected = {}
    for gene in {x[0] for x in expr}:
        for snp in {x[0] for x in dose}:
            a, b = {i: v for q, i, v in expr if q == gene}, {i: v for q, i, v in dose if q == snp}
            both = sorted(set(a) & set(b))
            x, z = np.array([a[i] for i in both]), np.array([b[i] for i in both], dtype=float)
            if len(both) > 2 and z.std() > 0:
                c = np.corrcoef(x, z)[0, 1]
                expected[gene, snp] = (len(both), c * np.sqrt((len(both) - 2) / (1 - c * c)))
    for at_once in (3, 256):
        got = {(x.gene, x.snp): (x.n, x.t) for x in assoc.all_pair_tests(e, d, at_once=at_once).collect()}
        assert got.keys() == expected.keys() and all(got[k][0] == n and abs(got[k][1] - t) < 1e-9 for k, (n, t) in expected.items())
    over = {(x.gene, x.snp) for x in assoc.all_pair_tests(e, d, 1.0).collect()}
    assert over == {k for k, (_, t) in expected.items() if abs(t) >= 1}


def test_reml_and_cross_validation(spark):
    import numpy as np

    from genolake.operators import breeding as br

    r = np.random.default_rng(8)
    n, m = 40, 120
    g = r.integers(0, 3, (n, m)).astype(float)
    y = (g - g.mean(0)) @ r.normal(size=m) / 6 + r.normal(size=n)
    doses = spark.createDataFrame([(i, k, float(g[i, k])) for i in range(n) for k in range(m)], "ind long, snp long, g double")
    pheno = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "ind long, y double")
    z = g - g.mean(0)
    k = z @ z.T
    values, vectors = np.linalg.eigh(k)
    ratio = br.reml_ratio(values, vectors.T @ np.ones(n), vectors.T @ y)

    def dense(q):  # the restricted likelihood by its definition
        v = k + q * np.eye(n)
        one = np.ones((n, 1))
        p = np.linalg.inv(v) - np.linalg.inv(v) @ one @ np.linalg.inv(one.T @ np.linalg.inv(v) @ one) @ one.T @ np.linalg.inv(v)
        return -0.5 * (np.linalg.slogdet(v)[1] + np.log((one.T @ np.linalg.inv(v) @ one)[0, 0]) + (n - 1) * np.log(y @ p @ y))

    assert all(dense(ratio) >= dense(ratio * q) - 1e-6 for q in (0.5, 0.9, 1.1, 2.0))
    effects, mean = br.ridge_effects(doses, pheno)
    u = {x.snp: x.effect for x in effects.collect()}
    expected = z.T @ np.linalg.solve(k + ratio * np.eye(n), y - y.mean())
    assert max(abs(u[q] - expected[q]) for q in range(m)) < 1e-6 and abs(mean - y.mean()) < 1e-9
    folds = br.cross_validate(doses, pheno, 30.0, folds=3, repeats=2).collect()
    assert len(folds) == 6 and all(sum(x.n for x in folds if x.rep == rep) == n for rep in (0, 1))
    scan = {x.snp: x.beta for x in br.marker_scan(doses, pheno, 0.7).collect()}
    lengths, vec = np.linalg.eigh(k / (np.trace(k) / n))
    w = 1 / (0.7 * np.clip(lengths, 0, None) + 1)
    for q in (0, 5, 60):
        x = vec.T @ np.column_stack([np.ones(n), z[:, q]])
        beta = np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * (vec.T @ (y - y.mean()))))
        assert abs(scan[q] - beta[1]) < 1e-8


def _written(spark, folder, prices):
    """orders of one marker of sixty individuals, and lineitem with the given prices by gene and individual; the doses are returned."""
    import hashlib

    spark.createDataFrame([(k, k) for k in range(60)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    g = np.array([ord(hashlib.md5(str(k).encode()).hexdigest()[0]) % 3 for k in range(60)], dtype=float)
    rows = [(gene, k, float(v)) for gene, per in enumerate(prices(g)) for k, v in enumerate(per)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{folder}/lineitem.parquet")
    return g


def test_trans_stat_over_keeps_what_is_rounded_to_the_threshold(spark, tmp_path):
    import duckdb

    from genolake.plans import catalogue

    def prices(g):
        z = (g - g.mean()) / g.std()
        w = np.random.default_rng(5).normal(size=60)
        w -= w.mean() + z * (w @ z) / 60
        w /= w.std()
        for t in (2.499994, 2.499996, -2.499996, 2.4999985, 2.51):
            r = t / np.sqrt(58 + t * t)
            yield 1000 + 50 * (r * z + np.sqrt(1 - r * r) * w)

    _written(spark, str(tmp_path), prices)
    rows = sorted((x.gene, x.snp, x.n, x.r, x.t) for x in catalogue.queries()["trans_stat_over"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows == sorted(con.execute(f"SELECT gene, snp, n, r, t FROM ({catalogue.oracle_sql()['trans_stat_over']})").fetchall())
    assert [(x[0], x[4]) for x in rows] == [(1, 2.5), (2, -2.5), (3, 2.5), (4, 2.51)]


def test_all_pairs_of_small_values(spark):
    from genolake.operators import association as assoc

    r = np.random.default_rng(9)
    v, g = r.normal(size=30), r.integers(0, 3, 30)
    doses = spark.createDataFrame([(0, i, int(g[i])) for i in range(30)], "snp int, ind int, g int")
    expr = spark.createDataFrame([(k, i, float(x)) for k, per in enumerate((v, v * 1e-9, np.full(30, 0.1), 1e7 + v)) for i, x in enumerate(per)], "gene int, ind int, v double")
    got = {x.gene: x.t for x in assoc.all_pair_tests(expr, doses).collect()}
    assert got.keys() == {0, 1, 3} and math.isclose(got[0], got[1], rel_tol=1e-9) and math.isclose(got[0], got[3], rel_tol=1e-6)


def test_linkage_of_all_packs_markers_once(spark):
    rng = np.random.default_rng(3)
    # Names are text, individuals differ from marker to marker, and some cells stand there twice.
    cells = [(f"i{i:02}", f"m{s:02}", int(rng.integers(0, 3))) for s in range(30) for i in range(s % 7, 40 - s % 5) if rng.random() < 0.8]
    cells += cells[:60]
    doses = spark.createDataFrame(cells, "ind string, snp string, g int").repartition(3)
    held = {}
    for i, s, x in cells:
        held.setdefault(s, []).append((i, x))
    expected = {}
    for a in held:
        for b in held:
            both = np.array([(x, y) for i, x in held[a] for j, y in held[b] if i == j], dtype=float)
            if a < b and both[:, 0].std() > 0 and both[:, 1].std() > 0:
                expected[a, b] = (len(both), np.corrcoef(both.T)[0, 1] ** 2)
    pairs = gt.linkage_of_all(doses, 7, 11)
    got = {(r.snp1, r.snp2): (r.n, r.r2) for r in pairs.collect()}
    assert got.keys() == expected.keys() and all(got[k][0] == n and math.isclose(got[k][1], r2, abs_tol=1e-9) for k, (n, r2) in expected.items())
    # Blocks meet without an exchange, where each cell was sent once for every group of markers.
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
