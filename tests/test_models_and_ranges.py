"""Record files by ranges, walks by jump pointers, tag indices, models, components and linkage against independent computations."""

import gzip
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolake.functions import distributions as dist
from genolake.operators import association as assoc
from genolake.operators import blocks as bl
from genolake.operators import breeding as br
from genolake.operators import expression as ex
from genolake.operators import genotypes as gt
from genolake.operators import linkage as ld
from genolake.operators import mixed_models as mm
from genolake.operators import pca
from genolake.operators import statistics as st
from genolake.operators import tag_index as ti
from genolake.operators import trimming as tr
from genolake.operators.greedy import walk
from genolake.operators.skew import hand_back
from genolake.sources import record_files as rf
from genolake.sources import text_files as tf

# --- FASTQ and FASTA ----------------------------------------------------------------------------------------


def fastq(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(r.choice("ACGTN") for _ in range(r.randrange(0, 60)))
        out.append((f"r{i} x", seq, "".join(r.choice("@+I!5") for _ in seq)))
    return out


def lines_of(records, end="\n"):
    return "".join(f"@{i}{end}{s}{end}+{end}{q}{end}" for i, s, q in records)


@pytest.mark.parametrize("size", [7, 50, 333, 4000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_in_ranges_of_any_size(tmp_path, size, end):
    records = fastq(120)
    path = tmp_path / "x.fq"
    path.write_bytes(lines_of(records, end).encode())
    total = path.stat().st_size
    found = [r for k in range(0, total, size) for r in rf.fastq_records(rf.ByteRange(str(path), k, min(total, k + size)))]
    assert [tuple(x.decode() for x in r[1:]) for r in found] == records
    assert [r[0] for r in found] == sorted(r[0] for r in found)


def test_fastq_through_spark_without_a_shuffle(spark, tmp_path):
    records = fastq(500, 2)
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.fq").write_text(lines_of(records[:300]))
    (tmp_path / "in/sub/b.fq").write_text(lines_of(records[300:400]) + "\n\n")
    with gzip.open(tmp_path / "in/c.fq.gz", "wt") as f:
        f.write(lines_of(records[400:]).rstrip("\n"))
    (tmp_path / "in/_SUCCESS").write_text("")
    (tmp_path / "in/empty.fq").write_text("")
    df = tf.read_fastq(spark, str(tmp_path / "in"), numbered=False, range_bytes=900)
    assert sorted((r.read_id, r.seq, r.qual) for r in df.collect()) == sorted(records)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() > 10 and tf.read_fastq(spark, f"file://{tmp_path}/in/*.fq*", numbered=False).count() == 400
    numbered = tf.read_fastq(spark, str(tmp_path / "in/a.fq"), range_bytes=900).orderBy("file_pos").collect()
    assert [(r.file_pos, r.read_id) for r in numbered] == [(k, i) for k, (i, _, _) in enumerate(records[:300])]
    with pytest.raises(FileNotFoundError):
        rf.find_files(str(tmp_path / "nothing"))


GOOD = "@a\nACGT\n+\nIIII\n@b\nAC\n+\n@@\n@c\nA\n+\nI\n"


@pytest.mark.parametrize(
    "text, fault",
    [
        (GOOD.replace("@b", "\n@b"), "blank line"),
        (GOOD[:-4], "ends inside"),
        (GOOD.replace("IIII", "III"), "unequal length"),
        (GOOD.replace("+\n@@", "@@\n+"), "without its"),
        (GOOD.replace("@b\n", ""), "does not begin|without its"),
        (GOOD.replace("@b", "b"), "does not begin"),
        (GOOD.replace("+\nIIII", "+other\nIIII"), "without its"),
    ],
)
def test_faults_are_errors_in_every_cut(tmp_path, text, fault):
    path = tmp_path / "bad.fq"
    path.write_text(text)
    with pytest.raises(rf.FaultyRecord, match=fault) as e:
        list(rf.fastq_records(rf.ByteRange(str(path), 0, -1)))
    assert "bad.fq at byte" in str(e.value)
    for size in range(3, len(text)):
        with pytest.raises(rf.FaultyRecord):
            for k in range(0, len(text), size):
                list(rf.fastq_records(rf.ByteRange(str(path), k, min(len(text), k + size))))


def test_fault_reaches_the_user(spark, tmp_path):
    path = tmp_path / "bad.fq"
    path.write_text(GOOD.replace("@b", "\n@b"))
    with pytest.raises(Exception, match="a blank line between records in .*bad.fq at byte 15"):
        tf.read_fastq(spark, str(path), numbered=False).collect()


@pytest.mark.parametrize("size", [5, 40, 1000])
def test_fasta_in_ranges(tmp_path, size):
    r = random.Random(3)
    seqs = [(f"s{i} y", "".join(r.choice("ACGT") for _ in range(r.randrange(0, 150)))) for i in range(30)]
    path = tmp_path / "x.fa"
    path.write_text("".join(f">{n}\n" + "".join(s[k : k + 20] + "\n" for k in range(0, len(s), 20)) for n, s in seqs))
    total = path.stat().st_size
    found = [x for k in range(0, total, size) for x in rf.fasta_records(rf.ByteRange(str(path), k, min(total, k + size)))]
    assert [(n.decode(), s.decode()) for _, n, s in found] == seqs
    path.write_text("ACGT\n>a\nA\n")
    with pytest.raises(rf.FaultyRecord, match="before the first name"):
        list(rf.fasta_records(rf.ByteRange(str(path), 0, -1)))


# --- walks --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("reach, parts", [(1, 3), (7, 5), (1000, 4)])
def test_walks_equal_the_loop(spark, reach, parts):
    r = random.Random(reach)
    rows = [(i, c, r.randrange(0, 3000) if r.random() < 0.9 else 2000) for i, c in enumerate(r.choices(["c1", "c1", "c1", "c2", "é"], k=900))]
    rows += [(2000, "alone", 5), (2001, "far", 1), (2002, "far", 900_000), (2003, "far", -50)]
    df = spark.createDataFrame(rows, "snp long, chrom string, pos long").repartition(3)
    kept, start = set(), {}
    for chrom in {c for _, c, _ in rows}:
        last = None
        for pos in sorted({p for _, c, p in rows if c == chrom}):
            if last is None or pos >= last + reach:
                last = pos
                kept.add((chrom, pos))
            start[chrom, pos] = last
    got = walk(df.union(spark.createDataFrame([(1, None, 3), (2, "c1", None)], df.schema)), reach, parts).collect()
    assert {(x.chrom, x.pos): x.start for x in got} == start and len(got) == len(start)
    assert sum(x.n for x in got) == len(rows)
    thin = gt.thin(df, reach, parts).collect()
    assert {(x.chrom, x.pos) for x in thin} == kept and len(thin) == len(kept)
    assert all(x.snp == min(i for i, c, p in rows if (c, p) == (x.chrom, x.pos)) for x in thin)
    chunks = gt.chunks(df, reach - 1, parts).collect()
    assert {(x.chrom, x.chunk_start): x.n_snps for x in chunks} == {k: sum(start[c, p] == k[1] and c == k[0] for _, c, p in rows) for k in kept}


def test_walks_of_nothing(spark):
    empty = spark.createDataFrame([], "snp long, chrom string, pos long")
    assert walk(empty, 5).count() == gt.chunks(empty).count() == 0
    with pytest.raises(ValueError):
        walk(empty, 0)


# --- tags ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [0, 1, 2])
def test_seeds_find_every_tag(spark, most):
    r = random.Random(most)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    tags = [(f"s{i}", word(r.choice([5, 6, 9])), i) for i in range(150)] + [("again", "ACGTA", 200), ("AC", "ac", 300)]
    reads = [(i, t[1].lower() + word(9) if r.random() < 0.2 else word(r.randrange(0, 20))) for i, t in enumerate(r.choices(tags, k=300))] + [(900, None)] + [(1000 + i, tags[7][1] + "AAAA") for i in range(300)]
    df = spark.createDataFrame(reads, "read_id long, seq string").repartition(3)
    sheet = spark.createDataFrame(tags, "sample string, tag string, tag_rank long")
    want = {}
    for i, s in reads:
        found = [(d, k, n, t) for n, t, k in tags if s is not None and len(s) >= len(t) and (d := sum(a != b for a, b in zip(s.upper(), t.upper(), strict=False))) <= most]
        if found:
            d, _, n, t = min(found)
            want[i] = (n, d, s[len(t) :])
    got = {x.read_id: (x.sample, x.mismatches, x.clip1) for x in ti.seeded_starts(df, sheet, most).collect()}
    assert got == want
    pairs = sorted((a[0], a[1], b[0], b[1]) for a, b in itertools.permutations(tags, 2) if a[0] != b[0] and len(a[1]) <= len(b[1]) and sum(x != y for x, y in zip(a[1].upper(), b[1].upper(), strict=False)) <= most)
    assert sorted(tuple(x) for x in ti.indistinct_pairs(sheet, most).collect()) == pairs
    assert ti.seeded_starts(df, sheet.limit(0), most).count() == ti.indistinct_pairs(sheet.limit(0), most).count() == 0


def test_hot_keys_are_handed_back(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    found = rows.groupBy("k").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    back = hand_back(rows, found, "k", "size")
    assert back.count() == 3000 and back.filter("k = -1 and least = 0").count() == 1000


def test_one_pass_writes_reads_and_log(spark, tmp_path):
    reads = spark.createDataFrame([(1, "GGGTTTA", "CCCCTATTT", "IIIIIII"), (2, "GGG", "CCC", "III")], "read_id long, seq string, seq2 string, qual string")
    adapters = spark.createDataFrame([("a", "TTT", "1"), ("b", "CTATTT", "2")], "adapter string, adp_seq string, mate string")
    path = str(tmp_path / "out")
    assert tr.write_trimmed(tr.trim_pairs(reads, adapters), path) == {"pairs": 2, "trimmed_pairs": 1, "trimmed_r1": 0, "trimmed_r2": 0}
    got = [(r.read_id, r.seq, r.qual) for r in tf.read_fastq(spark, f"{path}/kind=r1", numbered=False).orderBy("read_id").collect()]
    assert got == [("1", "GGG", "III"), ("2", "GGG", "III")]
    assert sorted(r.seq for r in tf.read_fasta(spark, f"{path}/kind=r2").collect()) == ["CCC", "CCC"]
    assert sorted(r.value for r in spark.read.text(f"{path}/kind=log").collect()) == ["1\t1\ta\t3", "1\t2\tb\t3", "2\t1\ta\t-1", "2\t2\tb\t-1"]


# --- statistics ---------------------------------------------------------------------------------------------


def test_upper_tails():
    assert math.isclose(dist.chi2_upper(3.841458820694124, 1), 0.05, rel_tol=1e-9) and math.isclose(dist.chi2_upper(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert dist.chi2_upper(0, 3) == 1.0
    for x, p in ((0.9793, 0.05), (2.0234, 0.01), (-1.2686, 0.5)):
        assert abs(dist.tracy_widom_upper(x) - p) < 2e-3


def test_regression_on_several_predictors(spark):
    r = np.random.default_rng(6)
    rows, data = [], {}
    for g in ("a", "b"):
        x = r.normal(size=(40, 3)) + 100
        y = x @ [1.0, -2.0, 0.5] + r.normal(size=40)
        data[g] = x, y
        rows += [(g, *map(float, a), float(b)) for a, b in zip(x, y, strict=True)]
    rows += [("a", None, 1.0, 1.0, 1.0), ("few", 1.0, 2.0, 3.0, 4.0)] + [("same", float(k), 2.0 * k, float(k * k), float(k)) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, y double")
    got = {x.g: x for x in st.ols_multi(df, ["x1", "x2", "x3"], "y", "g").collect()}
    assert set(got) == {"a", "b"}
    for g, (x, y) in data.items():
        design = np.column_stack([np.ones(40), x])
        beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
        sigma = math.sqrt(rss[0] / 36)
        se = sigma * np.sqrt(np.diag(np.linalg.inv(design.T @ design)))
        m = got[g]
        assert np.allclose([m.intercept, m.b_x1, m.b_x2, m.b_x3], beta, rtol=1e-6) and np.allclose([m.se_x1, m.se_x2, m.se_x3], se[1:], rtol=1e-6)
        assert math.isclose(m.sigma, sigma, rel_tol=1e-8) and math.isclose(m.r2, 1 - rss[0] / ((y - y.mean()) ** 2).sum(), rel_tol=1e-8) and math.isclose(m.t_x2, beta[2] / se[2], rel_tol=1e-6)


def test_shapiro_wilk_on_the_published_example(spark):
    # Weights of eleven men in pounds (Shapiro and Wilk, 1965): W = 0.79 there.
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    got = st.shapiro_wilk(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    assert got.n == 11 and abs(got.w - 0.78881) < 1e-4 and abs(got.p - 0.006704) < 1e-4
    r = np.random.default_rng(7)
    for sample, normal in ((r.normal(size=400), True), (r.exponential(size=400), False), (np.round(r.normal(size=300), 1), True)):
        rows = spark.createDataFrame([(float(v),) for v in sample] + [(None,)], "x double").repartition(3)
        one, two = (st.shapiro_wilk(rows, "x", k).first() for k in (100_000, 3))
        assert one.n == len(sample) and math.isclose(one.w, two.w, rel_tol=1e-12) and (one.p > 0.01) == normal
        n, s = len(sample), np.sort(sample)
        from statistics import NormalDist

        m = np.array([NormalDist().inv_cdf((k + 0.625) / (n + 0.25)) for k in range(n)])
        u, ssq = n**-0.5, (m * m).sum()
        a = m.copy()
        last, second = m[-1] / ssq**0.5 + np.polyval([*st.SHAPIRO_LAST, 0], u), m[-2] / ssq**0.5 + np.polyval([*st.SHAPIRO_NEXT, 0], u)
        a /= math.sqrt((ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        a[-1], a[-2], a[0], a[1] = last, second, -last, -second
        assert math.isclose(one.w, (a @ s) ** 2 / ((s - s.mean()) ** 2).sum(), rel_tol=1e-7)
    assert st.shapiro_wilk(spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "x double"), "x").first().w is None
    assert st.shapiro_wilk(spark.createDataFrame([], "x double"), "x").first().n == 0


def test_bh_when_all_tests_are_tied(spark):
    df = spark.range(2000).select((F.col("id") % 5).alias("gene"), F.col("id").alias("snp"), F.when(F.col("id") < 10, F.col("id") / 1e4).otherwise(1.0).alias("p"))
    got = {r.snp: r.q for r in st.bh(df).collect()}
    assert len(got) == 2000 and all(got[k] == 1.0 for k in range(10, 2000))
    p = [k / 1e4 for k in range(10)]
    assert all(math.isclose(got[k], min(1.0, min(2000 * p[j] / (j + 1) for j in range(k, 10))), abs_tol=1e-12) for k in range(10))
    ranks = st.value_ranks(df, "p").orderBy("p").collect()
    assert [(r.size, r.below) for r in ranks] == [(1, k) for k in range(10)] + [(1990, 10)]


# --- mixed models -------------------------------------------------------------------------------------------


def dense_deviance(y, x, blocks, ratios, reml):
    v = np.eye(len(y)) + sum(r * (b @ b.T) for b, r in zip(blocks, ratios, strict=True))
    inverse = np.linalg.inv(v)
    xx = x.T @ inverse @ x
    beta = np.linalg.solve(xx, x.T @ inverse @ y)
    rest = y - x @ beta
    free = len(y) - (x.shape[1] if reml else 0)
    sigma = rest @ inverse @ rest / free
    return free * (math.log(2 * math.pi * sigma) + 1) + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(xx)[1] if reml else 0), beta, sigma


def test_mixed_models_equal_dense_ones(spark):
    r = np.random.default_rng(8)
    u, w, rows = r.normal(scale=1.5, size=30), r.normal(scale=0.8, size=4), []
    for i in range(30):
        for k in range(1 + i % 5):
            year = (i + k) % 4
            rows.append((i, 2010 + year, i % 2, float(20 + u[i] + w[year] + 0.7 * (i % 2) + r.normal())))
    df = spark.createDataFrame([*rows, (None, 2010, 0, 1.0), (1, None, 1, 2.0), (1, 2010, 1, None)], "ind long, year int, trait3 int, trait1 double").repartition(3)
    y, ind, year, t3 = (np.array([row[k] for row in rows]) for k in (3, 0, 1, 2))
    zi, zy = (a[:, None] == np.unique(a)[None, :] for a in (ind, year))
    years = mm.levels(df, "year")
    s = mm.statistics(df, {"(mean)": F.lit(1.0), "trait3": F.col("trait3").cast("double"), **years}, "trait1")
    assert s.n_rows == len(rows)
    contrasts = list(years)[1:]
    x = np.column_stack([np.ones(len(y)), zy[:, 1:], t3]).astype(float)
    for ratio, reml in itertools.product((0.0, 0.4, 3.0), (False, True)):
        got = mm.evaluate(s, ["(mean)", *contrasts, "trait3"], ratio, reml)
        want = dense_deviance(y, x, [zi.astype(float)], [ratio], reml)
        assert math.isclose(got["deviance"], want[0], rel_tol=1e-9) and np.allclose(list(got["beta"].values()), want[1]) and math.isclose(got["var_e"], want[2], rel_tol=1e-9)
        both = mm.evaluate(s, ["(mean)"], ratio, reml, list(years), 0.6)
        assert math.isclose(both["deviance"], dense_deviance(y, np.ones((len(y), 1)), [zi.astype(float), zy.astype(float)], [ratio, 0.6], reml)[0], rel_tol=1e-9)
    table = {(m.model, m.method): m for m in mm.compare_models(df).collect()}
    assert len(table) == 7
    best = min((dense_deviance(y, x, [zi.astype(float)], [math.exp(g)], False)[0] for g in np.linspace(-8, 8, 400)))
    full = table["mean + year + trait3", "ML"]
    assert abs(-2 * full.log_likelihood - best) < 1e-3 and full.df == 7 and math.isclose(full.aic, -2 * full.log_likelihood + 14)
    less = table["mean + year", "ML"]
    assert math.isclose(full.chisq, 2 * (full.log_likelihood - less.log_likelihood), abs_tol=1e-9) and full.chisq_df == 1 and math.isclose(full.p, dist.chi2_upper(full.chisq, 1))
    random = table["mean + (year)", "REML"]
    grid = min(dense_deviance(y, np.ones((len(y), 1)), [zi.astype(float), zy.astype(float)], [math.exp(a), math.exp(b)], True)[0] for a in np.linspace(-4, 4, 25) for b in np.linspace(-6, 4, 25))
    assert -2 * random.log_likelihood <= grid + 1e-6 and random.var_year >= 0
    assert math.isclose(random.cv_g, math.sqrt(random.var_ind) / random.intercept) and 0 < random.h2 < random.h2_design < 1
    assert mm.compare_models(df.limit(0)).count() == 0


# --- components, confounders, linkage -----------------------------------------------------------------------


def test_leading_components_equal_numpy(spark):
    r = np.random.default_rng(9)
    v = r.normal(size=(60, 3)) @ (np.diag([6, 4, 2.5]) @ r.normal(size=(3, 25))) + r.normal(size=(60, 25))
    values = spark.createDataFrame([(g, i, float(v[g, i])) for g in range(60) for i in range(25)], "gene int, ind int, v double").repartition(3)
    loadings, parts = pca.leading_components(values, 3)
    z = (v - v.mean(0)) / v.std(0, ddof=1)
    e, u = np.linalg.eigh(np.cov(z.T))
    parts = parts.orderBy("pc").collect()
    assert np.allclose([p.variance for p in parts], e[::-1][:3], rtol=1e-8) and np.allclose([p.cumulative for p in parts], np.cumsum(e[::-1])[:3] / e.sum(), rtol=1e-8)
    got = np.zeros((25, 3))
    for x in loadings.collect():
        got[x.ind, x.pc - 1] = x.loading
    for k in range(3):
        mine = u[:, -1 - k]
        assert np.allclose(got[:, k], mine * np.sign(mine @ got[:, k]), atol=1e-5) and got[np.abs(got[:, k]).argmax(), k] > 0
    assert pca.significant(spark.createDataFrame(parts)) == 3
    noise = r.normal(size=(80, 9))  # as many vectors as samples: exact after a round
    _, table = pca.leading_components(spark.createDataFrame([(g, i, float(noise[g, i])) for g in range(80) for i in range(9)], "gene int, ind int, v double"), 2)
    assert pca.significant(table) == 0
    none, table = pca.leading_components(values.limit(0), 2)
    assert none.count() == table.count() == 0


def test_residuals_of_genes_with_holes(spark):
    rows = [(1, i, float(i * i)) for i in range(8)] + [(2, i, 3.0) for i in range(8)] + [(3, 99, 1.0), (3, 1, 2.0)]
    conf = spark.createDataFrame([(i, "c", float(i)) for i in range(8)], "ind int, name string, c double")
    got = {(r.gene, r.ind): r.residual for r in ex.remove_confounders(spark.createDataFrame(rows, "gene int, ind int, v double"), conf).collect()}
    y, c = np.arange(8.0) ** 2, np.arange(8.0)
    y = (y - y.mean()) / y.std(ddof=1)
    want = y - c * (c @ y) / (c @ c)
    assert all(math.isclose(got[1, i], want[i], abs_tol=1e-12) for i in range(8)) and all(got[2, i] == 0 for i in range(8)) and len(got) == 18


def test_pairs_are_the_same_by_broadcast_and_by_blocks(spark, monkeypatch):
    r = np.random.default_rng(10)
    v, g = r.normal(size=(9, 20)), r.integers(0, 3, size=(30, 20))
    left = spark.createDataFrame([(k, i, float(v[k, i])) for k in range(9) for i in range(20) if (k + i) % 7], "gene int, ind int, v double")
    right = spark.createDataFrame([(k, i, int(g[k, i])) for k in range(30) for i in range(20)], "snp int, ind int, g int")
    runs = []
    for most in (assoc.BROADCAST_BYTES, 0):
        monkeypatch.setattr(assoc, "BROADCAST_BYTES", most)
        runs.append(sorted((x.gene, x.snp, x.n, round(x.r, 12)) for x in assoc.all_pair_tests(left, right, 0.5, 4).collect()))
        runs.append(sorted((x.gene, x.snp, x.n, round(x.r, 12)) for x in assoc.all_pair_tests(left.withColumnRenamed("gene", "gene").limit(1000), right, 0.5, 16).collect()))
    assert runs[0] == runs[1] == runs[2] == runs[3] and runs[0]


def test_linkage_in_windows(spark):
    r = np.random.default_rng(11)
    g = r.integers(0, 3, size=(80, 30)).astype(float)
    g[40] = 1
    g[r.random(g.shape) < 0.05] = np.nan
    pos = sorted(r.integers(0, 3000, 80).tolist())
    doses = spark.createDataFrame([(s, i, None if np.isnan(g[s, i]) else int(g[s, i])) for s in range(80) for i in range(30)], "snp int, ind int, g int").repartition(3)
    snps = spark.createDataFrame([(s, "c1" if s < 60 else "c2", pos[s]) for s in range(80)], "snp int, chrom string, pos long")
    want = {}
    for a, b in itertools.combinations(range(80), 2):
        if (a < 60) == (b < 60) and pos[b] - pos[a] <= 200:
            ok = ~np.isnan(g[a]) & ~np.isnan(g[b])
            if g[a][ok].std() > 0 and g[b][ok].std() > 0:
                want[a, b] = (pos[b] - pos[a], int(ok.sum()), np.corrcoef(g[a][ok], g[b][ok])[0, 1] ** 2)
    got = {(x.snp1, x.snp2): (x.distance, x.n, x.r2) for x in ld.windowed(doses, snps, 200).collect()}
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and math.isclose(got[k][2], want[k][2], abs_tol=1e-9) for k in want)
    # Corrected: against the formula with the inverse of the relationship, and with the populations' means.
    full = np.where(np.isnan(g), np.nanmean(g, axis=1, keepdims=True), g)
    k = np.cov(r.normal(size=(30, 200))) + np.eye(30)
    kinship = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(30) for j in range(i, 30)], "ind1 int, ind2 int, relationship double")
    pops = spark.createDataFrame([(i, f"p{i % 3}") for i in range(30)], "ind int, population string")
    s = np.column_stack([np.ones(30), [i % 3 == 1 for i in range(30)], [i % 3 == 2 for i in range(30)]]).astype(float)
    inverse = np.linalg.inv(k)
    p = inverse - inverse @ s @ np.linalg.inv(s.T @ inverse @ s) @ s.T @ inverse
    got = {(x.snp1, x.snp2): x.r2 for x in ld.windowed(doses, snps, 200, kinship, pops).collect()}
    inner = full @ p @ full.T
    assert got and all(math.isclose(v, inner[a, b] ** 2 / (inner[a, a] * inner[b, b]), abs_tol=1e-8) for (a, b), v in got.items())
    assert {x for x in want if 40 not in x} <= got.keys()


# --- cohorts in blocks --------------------------------------------------------------------------------------


def test_solvers_over_blocks_equal_dense_ones(spark):
    r = np.random.default_rng(12)
    g = r.integers(0, 3, size=(40, 70))
    y = g[:, :4].sum(1) + r.normal(size=40)
    doses = spark.createDataFrame([(i, s, int(g[i, s])) for i in range(40) for s in range(70)], "ind int, snp int, g int").repartition(3)
    pheno = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "ind int, y double")
    z = g - g.mean(0)
    k = z @ z.T
    cells = doses.join(doses.groupBy("snp").agg(F.avg("g").alias("c")), "snp").select("ind", "snp", (F.col("g") - F.col("c")).alias("z"))
    blocks = bl.packed_columns(cells, list(range(40)), "snp", 9)
    assert np.allclose(bl.gram(blocks, 40), k) and np.allclose(bl.gram_times(blocks, np.eye(40)[:, :5]), k[:, :5])
    want = z.T @ np.linalg.solve(k + 60 * np.eye(40), y - y.mean())
    for dense in (0, 100):
        effects, mean = br.ridge_effects(doses, pheno, 60.0, dense=dense)
        assert math.isclose(mean, y.mean()) and all(math.isclose(x.effect, want[x.snp], abs_tol=1e-8) for x in effects.collect())
    free, _ = br.ridge_effects(doses, pheno)
    ratio = br._estimated(k, y)
    want = z.T @ np.linalg.solve(k + ratio * np.eye(40), y - y.mean())
    assert all(math.isclose(x.effect, want[x.snp], abs_tol=1e-8) for x in free.collect())
    dealt = {x.ind: (x.f0, x.f1) for x in pheno.select("ind", *[F.pmod(F.xxhash64("ind", F.lit(q)), F.lit(4)).alias(f"f{q}") for q in range(2)]).collect()}
    for penalty, dense in ((60.0, 0), (60.0, 100), (None, 100)):
        got = {(x.rep, x.fold): x for x in br.cross_validate(doses, pheno, penalty, 4, 2, dense=dense).collect()}
        assert len(got) == 8
        for (rep, f), x in got.items():
            test = np.array([dealt[i][rep] == f for i in range(40)])
            own = k[np.ix_(~test, ~test)]
            lam = penalty if penalty is not None else br._estimated(own, y[~test])
            m = y[~test].mean()
            p = m + k[np.ix_(test, ~test)] @ np.linalg.solve(own + lam * np.eye((~test).sum()), y[~test] - m)
            assert x.n == test.sum() and math.isclose(x.rmspe, np.sqrt(((p - y[test]) ** 2).mean()), rel_tol=1e-7)
    v = br.ridge_variances(doses, pheno).first()
    assert math.isclose(v.penalty, ratio) and math.isclose(v.var_e, v.var_u * ratio) and math.isclose(v.var_a, v.var_u * v.sum_het)
    f = g.mean(0) / 2
    assert math.isclose(v.sum_het, (2 * f * (1 - f)).sum())
    with pytest.raises(ArithmeticError):
        bl.conjugate_gradients(blocks, (y - y.mean())[:, None], np.array([1.0]), most_rounds=2)


def test_registration_has_ranks(spark):
    rows = [(i, float(100 + i % 3), 20.0, 5) for i in range(9)] + [(99, None, 1.0, 1)]
    means = spark.createDataFrame(rows, "ind int, trait1 double, trait2 double, n long")
    got = {x.ind: x["rank"] for x in br.registered(means, means).collect()}
    assert {got[i] for i in (2, 5, 8)} == {1} and {got[i] for i in (1, 4, 7)} == {4} and {got[i] for i in (0, 3, 6)} == {7} and got[99] is None


def test_means_do_not_depend_on_the_order(spark):
    values = [(0, 0.1), (0, 0.2), (0, 0.3), (1, 0.3), (1, 0.2), (1, 0.1), (2, 1e300), (2, 1e-300), (3, float("nan")), (3, 1.0), (4, None), (4, 4.0), (5, None), (6, 0.0), (6, -1e-5)]
    df = spark.createDataFrame(values, "ind int, v double").coalesce(1)
    got = {x.ind: x.m for x in df.groupBy("ind").agg(st.steady_mean("v").alias("m")).collect()}
    assert got[0] == got[1] == 0.6 / 3 and got[2] == 5e299 and math.isnan(got[3]) and got[4] == 4 and got[5] is None and got[6] == -5e-6


def test_ranks_find_rows_whose_yield_is_computed_again(spark):
    from pyspark.sql.functions import udf

    # A yield that comes out otherwise each time, as sums of rows that arrive in another order may.
    again = udf(lambda i: i + random.SystemRandom().random(), "double").asNondeterministic()
    means = spark.range(40).select(F.col("id").alias("ind"), again("id").alias("trait1"), F.lit(100.0).alias("trait2"))
    rows = br.registered(means, means.limit(1)).collect()
    assert sorted(x.ind for x in rows) == list(range(40)) and all(x["rank"] == 40 - x.ind for x in rows)


def test_few_more_tags_meet_than_match(spark):
    r = random.Random(6)
    words = sorted({"".join(r.choice("ACGT") for _ in range(r.choice([7, 8]))) for _ in range(3000)})
    texts = spark.createDataFrame([(w,) for w in words], "u string")
    a = ti._keyed(texts.toDF("u1"), "u1", [7, 8], 1, [0, 1], own=True)
    b = ti._keyed(texts.toDF("u2"), "u2", [7, 8], 1, [0, 1]).drop("out")
    sheet = texts.select(F.concat(F.lit("s"), "u").alias("sample"), F.col("u").alias("tag"))
    pairs = ti.indistinct_pairs(sheet, 1).count()
    assert pairs == sum(x != y and len(x) <= len(y) and sum(p != q for p, q in zip(x, y, strict=False)) <= 1 for x in words for y in words)
    # Halves of tags, by which they met before, made 102,415 rows of them.
    assert a.join(b, "key").count() < 5 * (pairs + len(words)) < 50_000


def test_starts_with_many_rows_of_one_tag(spark):
    sheet = spark.createDataFrame([(f"s{i}", t, i) for i in range(200) for t in ("ACGTACGTAC", "acgtacgtaca")], "sample string, tag string, tag_rank long")
    reads = spark.createDataFrame([(1, "acGTACGTACTT"), (2, "ACGTACGTACAT"), (3, "ACGTACGTAGTT"), (4, "TCGTACGTACAT"), (5, "AAGTACGTAGTT"), (6, "")], "read_id long, seq string")
    got = {x.read_id: (x.sample, x.mismatches) for x in ti.seeded_starts(reads, sheet, 1).collect()}
    assert got == {1: ("s0", 0), 2: ("s0", 0), 3: ("s0", 1), 4: ("s0", 1)}
    assert ti.indistinct_pairs(sheet, 1).count() == 3 * 200 * 199


def test_few_tags_on_many_rows_are_compared_once(spark):
    sheet = spark.createDataFrame([(f"s{i}", "ACGTACG"[: 5 + i % 3], i) for i in range(300)], "sample string, tag string, tag_rank long")
    pairs = ti.indistinct_pairs(sheet, 1)
    # A small sheet's pairs are many: the work is dealt to all partitions, where it was one task's before.
    assert pairs.rdd.getNumPartitions() == 4
    assert pairs.count() == sum(i != j and i % 3 <= j % 3 for i in range(300) for j in range(300))
