"""Registered queries of long tag sheets, models, tests, components and linkage by distance, and of helpers that other queries do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.functions.distributions import normal_quantile_sql
from genolake.functions.dna import insert_motif
from genolake.operators import breeding as br
from genolake.operators import demultiplex as dm
from genolake.operators import genotypes as gt
from genolake.operators import linkage as ld
from genolake.operators import mixed_models as mm
from genolake.operators import pca
from genolake.operators import quality_reports as qc
from genolake.operators import statistics as st
from genolake.operators import tag_index as ti
from genolake.operators import trimming as tr
from genolake.plans.registry import query
from genolake.session import scratch
from genolake.sources import archives as ar
from genolake.sources import genotype_files as gf
from genolake.sources.record_files import file_system

# --- tag sheets as long as the reads ------------------------------------------------------------------------

_H = "hamming(tag, substr(seq, 1, length(tag)))"
query("demux_fuzzy_sheet", "reads", "well_tags", sql=f"""+ c AS (
SELECT read_id, seq, sample, tag, tag_rank, {_H} AS h FROM reads JOIN well_tags ON substr(seq, 1, 5) = substr(tag, 1, 5)
UNION SELECT read_id, seq, sample, tag, tag_rank, {_H} FROM reads JOIN (SELECT * FROM well_tags WHERE length(tag) = 10) ON substr(seq, 6, 5) = substr(tag, 6)
UNION SELECT read_id, seq, sample, tag, tag_rank, {_H} FROM reads JOIN (SELECT * FROM well_tags WHERE length(tag) = 11) ON substr(seq, 6, 6) = substr(tag, 6))
SELECT read_id, sample, CAST(h AS INT) AS mismatches, substr(seq, length(tag) + 1) AS clip1 FROM c WHERE h <= 1 QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY h, tag_rank) = 1""")(
    lambda r, t: ti.seeded_starts(r, t, 1)
)
_PAIRS = """+ p AS (SELECT a.sample AS s1, a.tag AS t1, b.sample AS s2, b.tag AS t2 FROM well_tags a JOIN well_tags b ON substr(a.tag, 1, 5) = substr(b.tag, 1, 5) WHERE a.sample <> b.sample AND length(a.tag) <= length(b.tag)
UNION SELECT a.sample, a.tag, b.sample, b.tag FROM (SELECT * FROM well_tags WHERE length(tag) = 10) a JOIN well_tags b ON substr(a.tag, 6) = substr(b.tag, 6, 5) WHERE a.sample <> b.sample
UNION SELECT a.sample, a.tag, b.sample, b.tag FROM (SELECT * FROM well_tags WHERE length(tag) = 11) a JOIN (SELECT * FROM well_tags WHERE length(tag) = 11) b ON substr(a.tag, 6) = substr(b.tag, 6) WHERE a.sample <> b.sample),
h AS (SELECT *, hamming(t1, substr(t2, 1, length(t1))) AS h FROM p)"""
query("tag_pairs_sheet", "well_tags", sql=_PAIRS + " SELECT s1, t1, s2, t2 FROM h WHERE h <= 1")(lambda t: ti.indistinct_pairs(t, 1))
query("safe_mismatches", "well_tags", sql=_PAIRS + " SELECT CAST(CASE WHEN count(*) FILTER (h <= 1) = 0 THEN 1 WHEN count(*) FILTER (h = 0) = 0 THEN 0 ELSE -1 END AS INT) AS most FROM h")(
    lambda t: t.sparkSession.createDataFrame([(dm.safe_mismatches(t, 1),)], "most int")
)
query("motif_inserted", "reads", sql="SELECT read_id, concat(substr(seq, 1, 4), 'GAATTC', substr(seq, 11)) AS seq FROM reads")(lambda r: r.select("read_id", insert_motif(F.col("seq"), F.lit(5), F.lit("GAATTC")).alias("seq")))

# --- regression and tests -----------------------------------------------------------------------------------

query("ols_multi", "phenotypes", sql="""+ s AS (SELECT plot, count(*) AS n, avg(trait1) AS m1, avg(year) AS m2, avg(trait2) AS my, count(*) * var_pop(trait1) AS s11, count(*) * var_pop(year) AS s22, count(*) * covar_pop(trait1, year) AS s12,
count(*) * covar_pop(trait1, trait2) AS s1y, count(*) * covar_pop(year, trait2) AS s2y, count(*) * var_pop(trait2) AS syy FROM phenotypes WHERE trait1 IS NOT NULL AND trait2 IS NOT NULL AND year IS NOT NULL GROUP BY plot),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s WHERE n > 3),
e AS (SELECT *, sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3)) AS sigma FROM b)
SELECT plot, n, round(my - b1 * m1 - b2 * m2, 3) AS intercept, round(b1, 7) AS b_trait1, round(sigma * sqrt(s22 / det), 7) AS se_trait1, round(b2, 6) AS b_year, round(sigma * sqrt(s11 / det), 6) AS se_year,
round(1 - sigma * sigma * (n - 3) / syy, 7) AS r2, round(sigma, 6) AS sigma FROM e""")(
    lambda p: st.ols_multi(p, ["trait1", "year"], "trait2", "plot").select(
        "plot", "n", *[F.round(c, d).alias(c) for c, d in (("intercept", 3), ("b_trait1", 7), ("se_trait1", 7), ("b_year", 6), ("se_year", 6), ("r2", 7), ("sigma", 6))]
    )
)


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = "0E0"
    for c in coefficients:
        out = f"({out} * {x} + ({c!r}))"
    return out


query("shapiro_wilk", "phenotypes", sql=f"""+ r AS (SELECT trait1 AS x, row_number() OVER (ORDER BY trait1) - 1 AS i, count(*) OVER () AS n FROM phenotypes WHERE trait1 IS NOT NULL),
m AS (SELECT *, {normal_quantile_sql("u")} AS m FROM (SELECT *, (i + 0.625E0) / (n + 0.25E0) AS u FROM r)),
s AS (SELECT max(n) AS n, sum(m * m) AS mm, max(m) AS top, max(CASE WHEN i = n - 2 THEN m END) AS nxt, sum(CASE WHEN i BETWEEN 2 AND n - 3 THEN m * x END) AS mid, max(x) - min(x) AS span,
max(CASE WHEN i = n - 2 THEN x END) - max(CASE WHEN i = 1 THEN x END) AS span2, count(*) * var_pop(x) AS ss FROM m),
a AS (SELECT *, top / sqrt(mm) + {_horner("(1 / sqrt(n))", st.SHAPIRO_LAST)} / sqrt(n) AS a1, nxt / sqrt(mm) + {_horner("(1 / sqrt(n))", st.SHAPIRO_NEXT)} / sqrt(n) AS a2 FROM s),
w AS (SELECT n, pow(a1 * span + a2 * span2 + mid / sqrt((mm - 2 * top * top - 2 * nxt * nxt) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / ss AS w FROM a)
SELECT n, round(w, 6) AS w, round((ln(1 - w) - {_horner("ln(n)", st.SHAPIRO_MEAN)}) / exp({_horner("ln(n)", st.SHAPIRO_SPREAD)}), 3) AS z FROM w""")(
    lambda p: st.shapiro_wilk(p, "trait1").select("n", F.round("w", 6).alias("w"), F.round("z", 3).alias("z"))
)
query("variance_budget", "phenotypes", sql="""+ s AS (SELECT avg(trait1) AS mu, min(trait1) AS low FROM phenotypes), v AS (SELECT pow((mu - low) / 3, 2) AS var_p, pow(0.1 * mu, 2) AS var_a FROM s)
SELECT round(var_p, 6) AS var_p, round(var_a, 6) AS var_a, round((1 - 0.4) / 0.4 * var_a, 6) AS var_e, round(var_p - var_a - (1 - 0.4) / 0.4 * var_a, 6) AS var_year, round(var_a / 50, 6) AS var_beta FROM v""")(lambda p: _budget(p))


def _budget(p: DataFrame) -> DataFrame:
    s = p.agg(F.avg("trait1").alias("mu"), F.min("trait1").alias("low")).first()
    found = br.variance_budget(s["mu"], 0.1, s["low"], 0.4, 25.0)
    return p.sparkSession.createDataFrame([tuple(round(found[k], 6) for k in ("var_p", "var_a", "var_e", "var_year", "var_beta"))], "var_p double, var_a double, var_e double, var_year double, var_beta double")


_Z = "+ f AS (SELECT snp, f FROM (SELECT snp, avg(g) / 2 AS f FROM doses GROUP BY snp) WHERE f > 0 AND f < 1), z AS (SELECT ind, snp, g, f, (g - 2 * f) / sqrt(2 * f * (1 - f)) AS z FROM doses JOIN f USING (snp))"
_R = "SELECT a.ind AS ind1, b.ind AS ind2, sum(a.z * b.z) / (SELECT count(*) FROM f) AS r FROM z a JOIN z b ON a.snp = b.snp AND a.ind <= b.ind GROUP BY a.ind, b.ind"
query("grm_astle_balding", "doses", sql=f"{_Z} SELECT ind1, ind2, round(r / 2, 6) + 0 AS relationship FROM ({_R})")(lambda d: gt.relationships(d, method="astle-balding").withColumn("relationship", F.round("relationship", 6) + 0.0))
query("grm_yang", "doses", sql=f"""{_Z}, o AS (SELECT ind, 1 + avg((g * g - (1 + 2 * f) * g + 2 * f * f) / (2 * f * (1 - f))) AS own FROM z GROUP BY ind)
SELECT ind1, ind2, round(CASE WHEN ind1 = ind2 THEN own ELSE r END, 6) + 0 AS relationship FROM ({_R}) JOIN o ON o.ind = ind1""")(lambda d: gt.relationships(d, method="yang").withColumn("relationship", F.round("relationship", 6) + 0.0))
query("lmm_models", "phenotypes")(mm.compare_models)
query("marker_variance", "doses", sql="+ f AS (SELECT snp, avg(g) / 2 AS f FROM doses GROUP BY snp) SELECT round(sum(2 * f * (1 - f)), 6) AS sum_het, round(0.05 * sum(2 * f * (1 - f)), 6) AS var_a FROM f")(
    lambda d: br.additive_variance(d, 0.05).select(F.round("sum_het", 6).alias("sum_het"), F.round("var_a", 6).alias("var_a"))
)
query("rrblup_variances", "doses", "phenotypes")(lambda d, p: br.ridge_variances(d, p.groupBy((F.col("ind") % 60).alias("ind")).agg(F.avg("trait1").alias("y"))))

# --- components and linkage ---------------------------------------------------------------------------------

query("pca_components", "expression")(lambda e: pca.leading_components(e.groupBy("gene", "ind").agg(F.avg("v").alias("v")), 3)[1])
query("pca_loadings", "expression")(lambda e: pca.leading_components(e.groupBy("gene", "ind").agg(F.avg("v").alias("v")), 3)[0])


def _places(d: DataFrame) -> DataFrame:
    return d.select("snp").distinct().select("snp", F.concat(F.lit("chr"), F.col("snp") % 5).alias("chrom"), (F.col("snp") * 700 + F.col("snp") * 37 % 500).alias("pos"))


query("ld_window", "doses", sql="""+ p AS (SELECT *, snp % 5 AS chrom, snp * 700 + snp * 37 % 500 AS pos FROM doses)
SELECT a.snp AS snp1, b.snp AS snp2, max(b.pos - a.pos) AS distance, count(*) AS n, round(power(corr(a.g, b.g), 2), 9) AS r2 FROM p a JOIN p b ON a.chrom = b.chrom AND a.ind = b.ind AND (a.pos, a.snp) < (b.pos, b.snp) AND b.pos - a.pos <= 15000
GROUP BY a.snp, b.snp HAVING var_pop(a.g) > 0 AND var_pop(b.g) > 0""")(lambda d: ld.windowed(d, _places(d), 15_000).withColumn("r2", F.round("r2", 9)))
query("ld_corrected", "doses")(
    lambda d: ld.windowed(d, _places(d), 15_000, gt.relationships(d), d.select("ind").distinct().select("ind", (F.col("ind") % 3).cast("string").alias("population")))
)

# --- files --------------------------------------------------------------------------------------------------


_MATES = "CASE adp_rank % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE 'both' END"
query("trim_written", "reads", "adapters", sql=f"""+ a AS (SELECT *, {_MATES} AS mate FROM adapters), p AS (SELECT read_id, seq, seq2,
min(CASE WHEN mate IN ('1', 'both') AND instr(seq, adp_seq) > 0 THEN 1 END) AS one, min(CASE WHEN mate IN ('2', 'both') AND instr(seq2, adp_seq) > 0 THEN 1 END) AS two FROM reads CROSS JOIN a GROUP BY ALL)
SELECT count(*) AS pairs, count(*) FILTER (one = 1 AND two = 1) AS trimmed_pairs, count(*) FILTER (one = 1 AND two IS NULL) AS trimmed_r1, count(*) FILTER (one IS NULL AND two = 1) AS trimmed_r2,
count(*) * (SELECT count(*) FILTER (mate <> '2') + count(*) FILTER (mate <> '1') FROM a) AS log_lines FROM p""")(
    lambda r, a: _trim_written(r, a)
)


def _trim_written(r: DataFrame, a: DataFrame) -> DataFrame:
    spark, path = r.sparkSession, scratch(r.sparkSession, "trimmed")
    found = tr.write_trimmed(tr.trim_pairs(r, a.withColumn("mate", F.expr(_MATES))), path)
    lines = spark.read.text(f"{path}/kind=log").count()
    return spark.createDataFrame([(*(found[k] for k in ("pairs", "trimmed_pairs", "trimmed_r1", "trimmed_r2")), lines)], "pairs long, trimmed_pairs long, trimmed_r1 long, trimmed_r2 long, log_lines long")


def _tped(s: DataFrame) -> DataFrame:
    spark, path = s.sparkSession, scratch(s.sparkSession, "tped")
    pair = "CASE (snp + {0}) % 4 WHEN 0 THEN 'A A' WHEN 1 THEN 'A G' WHEN 2 THEN 'G G' ELSE '0 0' END"
    s.select(F.concat_ws(" ", "chrom", F.concat(F.lit("s"), "snp"), F.lit("0"), "pos", *[F.expr(pair.format(k)) for k in range(2)]).alias("value")).write.text(f"{path}.tped")
    spark.range(2).coalesce(1).select(F.concat(F.lit("fam i"), "id", F.lit(" 0 0 0 -9")).alias("value")).write.text(f"{path}.tfam")
    return gf.read_tped(spark, f"{path}.tped", f"{path}.tfam").select("snp", "chrom", "pos", "ind", "call")


_TWO = "CASE (snp + {0}) % 4 WHEN 0 THEN 'AA' WHEN 1 THEN 'AG' WHEN 2 THEN 'GG' ELSE '00' END"
query("source_tped", "snps", sql=f"SELECT concat('s', CAST(snp AS VARCHAR)) AS snp, chrom, pos, unnest(['i0', 'i1']) AS ind, unnest([{_TWO.format(0)}, {_TWO.format(1)}]) AS call FROM snps")(_tped)
query("report_cells", "part", sql="""SELECT p_partkey AS dataset, module, "row", name, value, TRY_CAST(value AS DOUBLE) AS number FROM (SELECT p_partkey, unnest(['Basic_Statistics', 'Basic_Statistics', 'Basic_Statistics', 'Basic_Statistics', 'Per_base', 'Per_base']) AS module,
unnest([0, 0, 1, 1, 0, 0]) AS "row", unnest(['Measure', 'Value', 'Measure', 'Value', 'Base', 'Mean']) AS name, unnest(['Filename', p_name, 'Length', CAST(p_size AS VARCHAR), '1', CAST(p_partkey AS VARCHAR)]) AS value FROM part)""")(
    lambda p: qc.parse_report(
        p.select(
            F.col("p_partkey").alias("dataset"),
            F.concat(F.lit("##Report\n>>Basic Statistics\tpass\n#Measure\tValue\nFilename\t"), "p_name", F.lit("\nLength\t"), "p_size", F.lit("\n>>END_MODULE\n>>Per base\tfail\n#Total\t1\n#Base\tMean\n1\t"), "p_partkey", F.lit("\n>>END_MODULE\n")).alias("text"),
        )
    )
)


def _kept(o: DataFrame) -> DataFrame:
    path = scratch(o.sparkSession, "kept")
    first = ar.kept(o.sparkSession, path, lambda: o.select("o_orderkey", "o_custkey"))
    again = ar.kept(o.sparkSession, path, lambda: o.limit(0).select("o_orderkey", "o_custkey"))  # is not asked
    return first.intersect(again)


query("kept_table", "orders", sql="SELECT o_orderkey, o_custkey FROM orders")(_kept)


def _only_file(c: DataFrame) -> DataFrame:
    spark, path = c.sparkSession, scratch(c.sparkSession, "lists")
    c.select(F.col("c_name").alias("value")).coalesce(1).write.text(path)
    return spark.read.text(ar.one_file(spark, f"{path}/part-*")).toDF("name")


query("only_file", "customer", sql="SELECT c_name AS name FROM customer")(_only_file)


def _archived(p: DataFrame) -> DataFrame:
    """Zip archives of fifty parts each, written by the tasks and read back."""
    spark, path = p.sparkSession, scratch(p.sparkSession, "archives")
    file_system(path)[0].create_dir(file_system(path)[1])

    def write(batches):
        import io
        import zipfile

        for batch in batches:
            for dataset, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    z.writestr(f"{dataset}_fastqc/fastqc_data.txt", "\n".join(lines))
                system, inner = file_system(f"{path}/{dataset}_fastqc.zip")
                with system.open_output_stream(inner) as f:
                    f.write(held.getvalue())
            yield batch.select([0])

    # At most fifty rows a group.
    groups = p.groupBy(F.concat(F.lit("d"), F.floor(F.col("p_partkey") / 50)).alias("dataset")).agg(F.collect_list(F.concat_ws("\t", "p_partkey", "p_name")).alias("lines"))
    groups.mapInArrow(write, "dataset string").write.format("noop").mode("overwrite").save()
    found = ar.read_report_archives(spark, path).select("dataset", "fault", F.explode(F.split("text", "\n")).alias("line")).withColumn("f", F.split("line", "\t"))
    return found.select("dataset", F.col("f")[0].cast("long").alias("part"), F.col("f")[1].alias("name"), "fault")


query("report_archives", "part", sql="SELECT concat('d', CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS VARCHAR)) AS dataset, p_partkey AS part, p_name AS name, CAST(NULL AS VARCHAR) AS fault FROM part")(_archived)
