"""The registered queries over the driver's tables and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.functions.distributions import normal_quantile_sql
from genolake.functions.dna import motif_pattern, remaining_motif, reverse_complement
from genolake.operators import alignments as al
from genolake.operators import association as assoc
from genolake.operators import bibliography as bib
from genolake.operators import breeding as br
from genolake.operators import demultiplex as dm
from genolake.operators import expression as ex
from genolake.operators import genotypes as gt
from genolake.operators import quality_reports as qc
from genolake.operators import relational as rel
from genolake.operators import statistics as st
from genolake.operators import trimming as tr
from genolake.operators import variants as va
from genolake.plans import files, models, predicates  # noqa: F401
from genolake.plans.derive import cte
from genolake.plans.registry import ORACLES, QUERIES, query

SITE = motif_pattern("G^CWG_C")
MOTIF = motif_pattern(remaining_motif("G^CWG_C"))
COSTS = {"view": 0.5, "click": 1.0, "purchase": 2.5, "error": 0.25, "signup": 4.0}


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


# --- expression ---------------------------------------------------------------------------------------------

query("rpkm_per_gene", "exons", sql="""
+ c AS (SELECT gene, sample, sum(n) AS n FROM exons GROUP BY gene, sample), l AS (SELECT sample, sum(n) AS t FROM exons GROUP BY sample),
s AS (SELECT gene, sum(exon_end - exon_start) AS len FROM exons GROUP BY gene)
SELECT gene, sample, round(coalesce(1e9 * c.n / nullif(CAST(t AS DOUBLE) * len, 0), 0), 2) AS rpkm FROM c JOIN l USING (sample) JOIN s USING (gene)""")(ex.rpkm)
query("readcount_per_gene", "exons", sql="SELECT gene, sample, CAST(sum(n) AS BIGINT) AS n_reads FROM exons GROUP BY gene, sample")(ex.gene_counts)
query("gene_spans", "exons", sql="SELECT gene, min(exon_start) AS gene_start, max(exon_end) AS gene_end, CAST(sum(exon_end - exon_start) AS BIGINT) AS gene_length FROM exons GROUP BY gene")(ex.gene_spans)
query("library_size", "exons", sql="SELECT sample, CAST(sum(n) AS BIGINT) AS library_size FROM exons GROUP BY sample")(ex.library_sizes)
query("mean_impute", "expression", sql="""
+ k AS (SELECT count(DISTINCT subgroup) AS k FROM expression), common AS (SELECT gene FROM expression GROUP BY gene HAVING count(DISTINCT subgroup) = (SELECT k FROM k)),
m AS (SELECT subgroup, gene, avg(v) AS mean FROM expression GROUP BY subgroup, gene), i AS (SELECT DISTINCT ind FROM expression)
SELECT m.subgroup, m.gene, i.ind, round(coalesce(e.v, mean), 8) AS v, e.v IS NULL AS imputed FROM m JOIN common USING (gene) CROSS JOIN i
LEFT JOIN expression e ON e.subgroup = m.subgroup AND e.gene = m.gene AND e.ind = i.ind""")(lambda e: ex.impute_means(e).withColumn("v", F.round("v", 8)))
query("residualise", "expression", sql="""
+ x AS (SELECT gene, subgroup, ind, CAST(ind AS DOUBLE) AS x, ln(v) AS y FROM expression),
f AS (SELECT gene, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x GROUP BY gene HAVING count(DISTINCT ind) > 1)
SELECT gene, subgroup, ind, round(y - a - b * x, 6) AS residual FROM x JOIN f USING (gene)""")(
    lambda e: ex.residuals(e.select("gene", "subgroup", "ind", F.col("ind").cast("double").alias("x"), F.ln("v").alias("y")), "x", "y", "gene").filter("slope is not null").select("gene", "subgroup", "ind", F.round("residual", 6).alias("residual"))
)
query("confounder_residuals", "expression", sql="""+ v AS (SELECT gene, ind, avg(v) AS v FROM expression GROUP BY gene, ind), i AS (SELECT DISTINCT ind, ind * 1E0 AS c1, ind % 3 * 1E0 AS c2 FROM expression),
g AS (SELECT sum(c1 * c1) AS s11, sum(c1 * c2) AS s12, sum(c2 * c2) AS s22 FROM i), s AS (SELECT gene, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM v GROUP BY gene),
y AS (SELECT gene, ind, c1, c2, CASE WHEN s > 0 THEN (v - m) / s ELSE 0E0 END AS y FROM v JOIN s USING (gene) JOIN i USING (ind)), x AS (SELECT gene, sum(c1 * y) AS x1, sum(c2 * y) AS x2 FROM y GROUP BY gene)
SELECT gene, ind, round(y - (c1 * (s22 * x1 - s12 * x2) + c2 * (s11 * x2 - s12 * x1)) / (s11 * s22 - s12 * s12), 6) AS residual FROM y JOIN x USING (gene) CROSS JOIN g""")(
    lambda e: ex.remove_confounders(e.groupBy("gene", "ind").agg(F.avg("v").alias("v")), e.select("ind").distinct().select("ind", F.explode(F.create_map(F.lit("c1"), F.col("ind") * 1.0, F.lit("c2"), (F.col("ind") % 3) * 1.0)).alias("name", "c"))).withColumn("residual", F.round("residual", 6))
)
query("pca_gram", "expression")(lambda e: ex.components(e.groupBy("gene", "ind").agg(F.avg("v").alias("v"))))
query("genes_in_all_groups", "expression", sql="SELECT gene FROM expression GROUP BY gene HAVING count(DISTINCT subgroup) = (SELECT count(DISTINCT subgroup) FROM expression)")(lambda e: rel.in_all_groups(e, "gene", "subgroup"))

# --- demultiplexing -----------------------------------------------------------------------------------------

_PICK = "QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY tag_rank) = 1"
query("demux_met1", "reads", "tags", sql=f"""SELECT read_id, sample, substr(seq, length(tag) + 1) AS clip1, substr(seq2, length(tag) + 1) AS clip2
FROM reads JOIN tags ON starts_with(seq, tag) AND starts_with(seq2, tag) {_PICK}""")(dm.both_start)
_MET2 = f"""SELECT read_id, sample, CASE WHEN starts_with(seq, tag) THEN substr(seq, length(tag) + 1) ELSE seq END AS clip1,
CASE WHEN starts_with(seq2, tag) THEN substr(seq2, length(tag) + 1) ELSE seq2 END AS clip2,
CAST(starts_with(seq, tag) AS INT) + CAST(starts_with(seq2, tag) AS INT) AS n_mates FROM reads JOIN tags ON starts_with(seq, tag) OR starts_with(seq2, tag) {_PICK}"""
query("demux_met2", "reads", "tags", sql=f"SELECT read_id, sample, clip1, clip2 FROM ({_MET2})")(lambda r, t: dm.either_start(r, t).drop("n_mates"))
query("demux_met3", "reads", "tags", sql=_MET2)(dm.either_start)
_MET4A = f"SELECT read_id, sample, substr(seq, length(tag) + 1) AS clip1 FROM reads JOIN tags ON starts_with(seq, tag) {_PICK}"
query("demux_met4a", "reads", "tags", sql=_MET4A)(dm.first_starts)
query("demux_met4b", "reads", "long_tags", sql=f"""SELECT read_id, sample, CAST(instr(substr(seq, 1, 15), tag) AS INT) AS at, substr(seq, instr(substr(seq, 1, 15), tag) + length(tag)) AS clip1
FROM reads JOIN long_tags ON contains(substr(seq, 1, 15), tag) {_PICK}""")(lambda r, t: dm.within(r, t, 15))


def _met4c(seq: str) -> str:
    found = f"regexp_extract(substr({seq}, 1, 20), concat('(.*?)', tag, '{MOTIF}'), 1)"
    return f"""SELECT read_id, sample, CAST(length({found}) + 1 AS INT) AS at, substr({seq}, length({found}) + 1 + length(tag)) AS clip1
FROM reads JOIN tags ON regexp_matches(substr({seq}, 1, 20), concat(tag, '{MOTIF}')) {_PICK}"""


query("demux_met4c", "reads", "tags", sql=_met4c("seq"))(lambda r, t: dm.with_motif(r, t, MOTIF, 20))
query("demux_met4d", "reads", "tags", sql=f"""
+ one AS (SELECT read_id, sample AS s1, length(clip1) AS l1 FROM ({_met4c("seq")})), two AS (SELECT read_id, sample AS s2, length(clip1) AS l2 FROM ({_met4c("seq2")}))
SELECT read_id, CASE WHEN s1 <> s2 THEN 'chimera' ELSE coalesce(s1, s2) END AS sample,
CASE WHEN s1 <> s2 THEN seq ELSE substr(seq, coalesce(length(seq) - l1, length(seq2) - l2) + 1) END AS clip1,
CASE WHEN s1 <> s2 THEN seq2 ELSE substr(seq2, coalesce(length(seq2) - l2, length(seq) - l1) + 1) END AS clip2
FROM reads LEFT JOIN one USING (read_id) LEFT JOIN two USING (read_id) WHERE s1 IS NOT NULL OR s2 IS NOT NULL""")(lambda r, t: dm.either_with_motif(r, t, MOTIF, 20))
query("demux_fuzzy1", "reads", "long_tags", sql="""SELECT read_id, sample, CAST(hamming(substr(seq, 1, 5), tag) AS INT) AS mismatches, substr(seq, length(tag) + 1) AS clip1
FROM reads JOIN long_tags ON hamming(substr(seq, 1, 5), tag) <= 1 QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY hamming(substr(seq, 1, 5), tag), tag_rank) = 1""")(lambda r, t: dm.fuzzy_start(r, t, 1))
query("demux_fuzzy_window", "reads", "long_tags", sql=predicates.window_sql("seq", "long_tags", "tag", "length(tag)", 10, 1))(lambda r, t: dm.within(r, t, 10, 1))
query("demux_stats", "reads", "tags", sql=f"""+ a AS ({_MET4A})
SELECT t.sample AS ind, t.barcode, CAST(coalesce(n, 0) AS BIGINT) AS assigned FROM (SELECT sample, string_agg(tag, '_' ORDER BY tag) AS barcode FROM tags GROUP BY sample) t
LEFT JOIN (SELECT sample, count(*) AS n FROM a GROUP BY sample) USING (sample)""")(lambda r, t: dm.stats_per_sample(dm.first_starts(r, t), t))
query("site_chimera", "reads", sql=f"SELECT read_id, regexp_matches(seq, '{SITE}') OR regexp_matches(seq2, '{SITE}') AS site_chimera FROM reads")(lambda r: dm.site_chimeras(r, SITE))
query("demux_routing", "reads", "tags", sql=f"""+ a AS ({_MET4A})
SELECT read_id, CASE WHEN regexp_matches(seq, '{SITE}') OR regexp_matches(seq2, '{SITE}') THEN 'chimeras' ELSE coalesce(a.sample, 'unassigned') END AS destination FROM reads LEFT JOIN a USING (read_id)""")(
    lambda r, t: dm.route(r, dm.first_starts(r, t), dm.site_chimeras(r, SITE))
)
query("demux_summary", "reads", "tags", sql=f"""+ a AS ({_MET4A}), d AS (SELECT coalesce(a.sample, 'unassigned') AS x FROM reads LEFT JOIN a USING (read_id))
SELECT count(*) AS reads, count(*) FILTER (x = 'unassigned') AS unassigned, count(*) FILTER (x = 'chimeras') AS chimeras, count(*) FILTER (x <> 'unassigned') AS assigned,
round(100.0 * count(*) FILTER (x <> 'unassigned') / nullif(count(*), 0), 4) AS percent_assigned FROM d""")(lambda r, t: dm.summary(dm.route(r, dm.first_starts(r, t))))
query("tag_distinguishability", "plate_tags", sql="""SELECT a.sample AS s1, a.tag AS t1, b.sample AS s2, b.tag AS t2 FROM plate_tags a JOIN plate_tags b ON a.sample <> b.sample AND length(a.tag) <= length(b.tag) AND hamming(a.tag, substr(b.tag, 1, length(a.tag))) <= 1""")(lambda t: dm.indistinct_tags(t, 1))
query("tags_too_long", "reads", "long_tags", sql="SELECT sample, tag FROM long_tags WHERE length(tag) + 4 > (SELECT min(length(seq)) - 24 FROM reads)")(
    lambda r, t: dm.too_long(t, r.agg(F.min(F.length("seq"))).first()[0] - 24, 4).select("sample", "tag")
)
query("revcomp", "reads", sql="SELECT read_id, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS rc FROM reads")(lambda r: r.select("read_id", reverse_complement(F.col("seq")).alias("rc")))

# --- trimming -----------------------------------------------------------------------------------------------

query("adapter_exact_start", "reads", "adapters", sql="SELECT read_id, adapter, CAST(instr(seq, adp_seq) - 1 AS INT) AS start FROM reads CROSS JOIN adapters")(tr.exact_starts)
query("trim_reads", "reads", "adapters", sql="""+ c AS (SELECT read_id, min(instr(seq, adp_seq) - 1) AS cut FROM reads CROSS JOIN adapters WHERE instr(seq, adp_seq) > 0 GROUP BY read_id)
SELECT read_id, CAST(coalesce(cut, length(seq)) AS INT) AS cut, substr(seq, 1, coalesce(cut, length(seq))) AS trimmed FROM reads LEFT JOIN c USING (read_id)""")(tr.trim_exact)
query("trim_fuzzy", "reads", "adapters")(lambda r, a: tr.trim(r, tr.fuzzy_starts(r, a)))
query("read_cleaning", "reads")(lambda r: tr.quality_trim(r.select("read_id", "seq", F.translate(F.md5("seq"), "0123456789abcdef", "#+5?IIIIIIIIIIII").alias("qual")), shortest=20))

# --- alignments ---------------------------------------------------------------------------------------------

_UNIQ = "flag & 4 = 0 AND xt = 'U' AND coalesce(x0, 1000000000) = 1 AND coalesce(x1, 1000000000) = 0"
query("sam_unique_filter", "alignments", sql=f"SELECT qname, flag, rname, pos, nm FROM alignments WHERE {_UNIQ} AND nm <= 1")(lambda a: al.keep_unique(a, 1).select("qname", "flag", "rname", "pos", "nm"))
query("sam_filter_counters", "alignments", sql=f"""SELECT count(*) AS n_reads, count(*) FILTER (flag & 4 = 0) AS n_mapped, count(*) FILTER ({_UNIQ}) AS n_unique, count(*) FILTER ({_UNIQ} AND nm = 0) AS n_perfect,
count(*) FILTER ({_UNIQ} AND nm > 0 AND nm <= 2) AS n_almost, count(*) FILTER ({_UNIQ} AND nm <= 2) AS n_saved FROM alignments""")(lambda a: al.filter_counters(a, 2))
query("sam_to_bed", "alignments", sql="""SELECT rname AS chrom, pos - 1 AS start, pos - 1 + seq_len AS "end", qname AS name, 1000 AS score, CASE flag WHEN 0 THEN '+' WHEN 16 THEN '-' ELSE '' END AS strand FROM alignments""")(al.to_bed)
query("flag_counts", "alignments", sql="""SELECT lane, count(*) AS n_total, count(*) FILTER (flag & 4 = 0) AS n_mapped, count(*) FILTER (flag & 2 <> 0) AS n_proper, count(*) FILTER (flag & 256 <> 0) AS n_secondary,
count(*) FILTER (flag & 16 <> 0) AS n_reverse FROM alignments GROUP BY lane""")(al.flag_counts)
query("aligned_names_paired", "alignments", sql="SELECT lane, count(DISTINCT qname) AS n_names FROM alignments WHERE flag & 2 <> 0 AND flag & 256 = 0 AND mapq >= 5 GROUP BY lane")(lambda a: al.counted_names(a, True))
query("aligned_names_single", "alignments", sql="SELECT lane, count(DISTINCT qname) AS n_names FROM alignments WHERE flag & 4 = 0 AND flag & 256 = 0 AND flag & 2048 = 0 AND mapq >= 5 GROUP BY lane")(lambda a: al.counted_names(a, False))
query("insert_size_histogram", "alignments", sql="SELECT lane, tlen AS insert_size, count(*) AS n FROM alignments WHERE tlen > 0 GROUP BY lane, tlen")(al.insert_sizes)
query("insert_size_median", "alignments", sql="SELECT lane, quantile_cont(tlen, 0.5) AS median_insert FROM alignments WHERE tlen > 0 GROUP BY lane")(al.insert_medians)

# --- joins, sets, order -------------------------------------------------------------------------------------

query("semi_names", "reads", "events", sql="SELECT read_id, seq FROM reads WHERE read_id IN (SELECT event_id FROM events WHERE event_type = 'purchase')")(
    lambda r, e: rel.keep_named(r, e.filter("event_type = 'purchase'").select(F.col("event_id").alias("read_id")), "read_id").select("read_id", "seq")
)
query("anti_excluded", "snps", "lineitem", sql="SELECT snp, chrom, pos FROM snps WHERE snp NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")(
    lambda s, li: rel.drop_named(s, li.filter("l_quantity >= 49").select(F.col("l_partkey").alias("snp")), "snp")
)
query("coord_override", "snps", "genes", sql="SELECT snp, chrom, coalesce(tss, pos) AS pos FROM snps LEFT JOIN (SELECT gene AS snp, tss FROM genes) USING (snp)")(
    lambda s, g: rel.override(s, g.select(F.col("gene").alias("snp"), "tss"), "snp", "pos", "tss").select("snp", "chrom", "pos")
)
query("full_outer_samples", "customer", "supplier", sql="SELECT coalesce(c_nationkey, s_nationkey) AS nation, n_c, n_s FROM (SELECT c_nationkey, count(*) AS n_c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS n_s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")(
    lambda c, s: c.groupBy("c_nationkey").agg(F.count("*").alias("n_c")).join(s.groupBy("s_nationkey").agg(F.count("*").alias("n_s")), F.col("c_nationkey") == F.col("s_nationkey"), "full_outer").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "n_c", "n_s")
)
query("zip_mates", "reads", sql="SELECT read_id AS file_pos, concat('r', CAST(read_id AS VARCHAR)) AS name, seq AS seq1, seq2 FROM reads")(
    lambda r: rel.zip_mates(r.select(F.col("read_id").alias("file_pos"), F.concat(F.lit("r"), "read_id", F.lit(" 1")).alias("read_id1"), F.col("seq").alias("seq1")), r.select(F.col("read_id").alias("file_pos"), F.concat(F.lit("r"), "read_id", F.lit(" 2")).alias("read_id2"), "seq2")).select("file_pos", "name", "seq1", "seq2")
)
query("dedup_first", "events", sql="SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")(lambda e: rel.first_occurrences(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id"))
query("set_diff", "customer", "orders", sql="""SELECT k, 'left' AS side FROM (SELECT c_custkey * 3 AS k FROM customer EXCEPT SELECT o_custkey * 2 FROM orders) UNION ALL SELECT k, 'right' FROM (SELECT o_custkey * 2 AS k FROM orders EXCEPT SELECT c_custkey * 3 FROM customer)""")(
    lambda c, o: rel.differences(c.select((F.col("c_custkey") * 3).alias("k")), o.select((F.col("o_custkey") * 2).alias("k")))
)
query("set_intersection", "customer", "orders", sql="SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")(lambda c, o: c.select(F.col("c_custkey").alias("k")).intersect(o.select(F.col("o_custkey").alias("k"))))
query("union_labelled", "customer", "supplier", sql="SELECT c_name AS name, c_nationkey AS nation, 'customer' AS origin FROM customer UNION ALL SELECT s_name, s_nationkey, 'supplier' FROM supplier")(
    lambda c, s: rel.labelled_union({"customer": c.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")), "supplier": s.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))})
)
query("transpose", "lineitem", sql="SELECT l_linenumber AS row, l_orderkey AS col, CAST(l_quantity AS DOUBLE) AS value FROM lineitem WHERE l_linenumber <= (SELECT min(w) FROM (SELECT max(l_linenumber) AS w FROM lineitem GROUP BY l_orderkey))")(
    lambda li: rel.transposed(li.select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").cast("double").alias("value")))
)
query("concat_by_group", "events", sql="SELECT grp, pos, line FROM (SELECT event_type AS grp, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS pos, event_id AS line FROM events)")(
    lambda e: rel.concatenated(rel_numbered(e))
)
query("crosstab", "events", sql="SELECT event_type, count(*) AS n FROM events GROUP BY event_type")(lambda e: e.groupBy("event_type").agg(F.count("*").alias("n")))
query("manifest_counts", "alignments", sql="SELECT lane, count(DISTINCT rname) AS n_genotypes, count(DISTINCT qname) AS n_samples FROM alignments GROUP BY lane")(lambda a: a.groupBy("lane").agg(F.count_distinct("rname").alias("n_genotypes"), F.count_distinct("qname").alias("n_samples")))
query("unique_prefixes", "documents", sql="SELECT lang, count(DISTINCT split_part(source, '_', 1)) AS n_prefixes FROM documents GROUP BY lang")(lambda d: d.groupBy("lang").agg(F.count_distinct(F.substring_index("source", "_", 1)).alias("n_prefixes")))
query("sequence_dictionary", "reads", sql="SELECT read_id, concat('SN:', CAST(read_id AS VARCHAR), chr(9), 'LN:', CAST(length(seq) AS VARCHAR), chr(9), 'M5:', md5(seq)) AS line FROM reads")(
    lambda r: r.select("read_id", F.concat_ws("\t", F.concat(F.lit("SN:"), "read_id"), F.concat(F.lit("LN:"), F.length("seq")), F.concat(F.lit("M5:"), F.md5("seq"))).alias("line"))
)


def rel_numbered(e: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return e.select(F.col("event_type").alias("grp"), F.col("user_id").alias("file"), F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id")).cast("long").alias("line_no"), F.col("event_id").alias("line"))


# --- genotypes ----------------------------------------------------------------------------------------------

_P = """CASE WHEN call = 'AA' THEN 1 ELSE 0 END AS p_aa, CASE WHEN call IN ('AG', 'GA') THEN 1 ELSE 0 END AS p_ab, CASE WHEN call = 'GG' THEN 1 ELSE 0 END AS p_bb"""
query("impute_recode", "calls", sql=f"SELECT rec, ind, snp, {_P} FROM calls")(gt.recode_calls)
query("dosage_bimbam", "calls", sql=f"SELECT rec, ind, snp, CAST(2.0 * p_aa + p_ab AS DOUBLE) AS dosage FROM (SELECT *, {_P} FROM calls)")(lambda c: gt.dosage(gt.recode_calls(c)).withColumn("dosage", F.col("dosage").cast("double")))
query("eigenstrat_geno", "calls", sql=f"SELECT rec, ind, snp, CASE WHEN p_aa = 1 THEN 2 WHEN p_ab = 1 THEN 1 WHEN p_bb = 1 THEN 0 ELSE 9 END AS code FROM (SELECT *, {_P} FROM calls)")(lambda c: gt.hard_calls(gt.recode_calls(c)))
query("chrom_recode", "snps", sql="""SELECT snp, CASE n WHEN 'X' THEN '23' WHEN 'Y' THEN '24' WHEN 'mtDNA' THEN '90' WHEN 'XY' THEN '91' WHEN 'YX' THEN '91' ELSE n END AS code
FROM (SELECT snp, CASE snp % 7 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' WHEN 2 THEN 'mtDNA' WHEN 3 THEN 'XY' ELSE substr(chrom, 4) END AS n FROM snps)""")(
    lambda s: s.select("snp", gt.chromosome_code(F.when(F.col("snp") % 7 == 0, "X").when(F.col("snp") % 7 == 1, "Y").when(F.col("snp") % 7 == 2, "mtDNA").when(F.col("snp") % 7 == 3, "XY").otherwise(F.col("chrom"))).alias("code"))
)
query("allele_validation", "calls", sql="""+ a AS (SELECT snp, substr(call, 1, 1) AS x FROM calls UNION ALL SELECT snp, substr(call, 2, 1) FROM calls)
SELECT snp, string_agg(DISTINCT x, '' ORDER BY x) AS alleles, count(DISTINCT x) = 2 AS biallelic FROM a WHERE x NOT IN ('0', 'N') GROUP BY snp""")(gt.allele_sets)
_FREQ = "SELECT snp, count(g) AS n, avg(g) / 2 AS freq FROM doses GROUP BY snp"
query("maf", "doses", sql=f"SELECT snp, n, round(freq, 9) AS freq, round(least(freq, 1 - freq), 9) AS maf FROM ({_FREQ})")(lambda d: gt.frequencies(d).select("snp", "n", F.round("freq", 9).alias("freq"), F.round("maf", 9).alias("maf")))
query("maf_filter", "doses", sql=f"SELECT ind, snp, g FROM doses WHERE snp IN (SELECT snp FROM ({_FREQ}) WHERE least(freq, 1 - freq) >= 0.45)")(lambda d: gt.common(d, 0.45).select("ind", "snp", "g"))
query("ld_r2", "doses", sql="""SELECT a.snp AS snp1, b.snp AS snp2, count(*) AS n, round(power(corr(a.g, b.g), 2), 9) AS r2 FROM doses a JOIN doses b ON a.block = b.block AND a.ind = b.ind AND a.snp < b.snp
GROUP BY a.snp, b.snp HAVING var_pop(a.g) > 0 AND var_pop(b.g) > 0""")(lambda d: gt.linkage(d).withColumn("r2", F.round("r2", 9)))
query("ld_r2_all", "doses", sql="""SELECT a.snp AS snp1, b.snp AS snp2, count(*) AS n, round(power(corr(a.g, b.g), 2), 9) AS r2 FROM doses a JOIN doses b ON a.ind = b.ind AND a.snp < b.snp
GROUP BY a.snp, b.snp HAVING var_pop(a.g) > 0 AND var_pop(b.g) > 0""")(lambda d: gt.linkage_of_all(d).withColumn("r2", F.round("r2", 9)))


def _grm(centre: str) -> str:
    return f"""+ f AS (SELECT snp, avg(g) / 2 AS p FROM doses GROUP BY snp), z AS (SELECT ind, snp, g - {centre} AS z FROM doses JOIN f USING (snp)), s AS (SELECT sum(2 * p * (1 - p)) AS s FROM f)
SELECT a.ind AS ind1, b.ind AS ind2, round(sum(a.z * b.z) / (SELECT s FROM s), 6) AS relationship FROM z a JOIN z b ON a.snp = b.snp AND a.ind <= b.ind GROUP BY a.ind, b.ind"""


query("grm_vanraden", "doses", sql=_grm("2 * p"))(lambda d: gt.relationships(d).withColumn("relationship", F.round("relationship", 6)))
query("grm_uncentred", "doses", sql=_grm("0"))(lambda d: gt.relationships(d, centred=False).withColumn("relationship", F.round("relationship", 6)))
query("grm_standardised", "doses", sql="""+ f AS (SELECT snp, p FROM (SELECT snp, avg(g) / 2 AS p FROM doses GROUP BY snp) WHERE p > 0 AND p < 1), z AS (SELECT ind, snp, (g - 2 * p) / sqrt(2 * p * (1 - p)) AS z FROM doses JOIN f USING (snp))
SELECT a.ind AS ind1, b.ind AS ind2, round(sum(a.z * b.z) / (SELECT count(*) FROM f), 6) AS relationship FROM z a JOIN z b ON a.snp = b.snp AND a.ind <= b.ind GROUP BY a.ind, b.ind""")(lambda d: gt.relationships(d, method="standardised").withColumn("relationship", F.round("relationship", 6)))
query("inbreeding", "doses", sql=f"""SELECT ind1, ind2, round(CASE WHEN ind1 = ind2 THEN relationship - 1 END, 6) AS inbreeding, round(CASE WHEN ind1 <> ind2 THEN relationship / 2 END, 6) AS coancestry FROM ({cte("doses") + _grm("2 * p").replace("+ f AS", ", f AS", 1).replace(", 6) AS relationship", ", 12) AS relationship")})""".replace("SELECT ind1", "+ one AS (SELECT 1) SELECT ind1", 1))(
    lambda d: gt.inbreeding(gt.relationships(d)).select("ind1", "ind2", F.round("inbreeding", 6).alias("inbreeding"), F.round("coancestry", 6).alias("coancestry"))
)
query("ascertained_snps", "doses", sql="SELECT snp, round(least(p, 1 - p), 9) AS maf FROM (SELECT snp, avg(g) / 2 AS p FROM doses WHERE ind % 3 = 0 GROUP BY snp) WHERE least(p, 1 - p) >= 0.4")(
    lambda d: gt.ascertained(d, d.filter("ind % 3 = 0").select("ind").distinct(), 0.4).withColumn("maf", F.round("maf", 9))
)
query("trait_values", "doses", sql="SELECT ind, CAST(sum(g * (snp % 7 - 3)) AS DOUBLE) AS genetic, CAST(50 + sum(g * (snp % 7 - 3)) AS DOUBLE) AS trait FROM doses GROUP BY ind")(
    lambda d: gt.trait_values(d, d.select("snp").distinct().withColumn("beta", (F.col("snp") % 7 - 3).cast("double")), 50.0)
)
query("snp_gap", "snps", sql="SELECT snp, chrom, pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos, snp) - pos AS gap FROM snps")(gt.gaps)
query("snp_pair_distance", "snps", sql="SELECT a.snp AS snp1, b.snp AS snp2, CASE WHEN a.chrom = b.chrom THEN abs(b.pos - a.pos) END AS distance FROM snps a JOIN snps b ON b.snp IN (a.snp + 1, a.snp + 22)")(
    lambda s: gt.pair_distances(s.select(F.col("snp").alias("snp1"), F.explode(F.array(F.col("snp") + 1, F.col("snp") + 22)).alias("snp2")), s)
)
query("chunk_greedy", "snps", sql="""
+ RECURSIVE_MARK first AS (SELECT chrom, min(pos) AS start FROM snps GROUP BY chrom),
c AS (SELECT chrom, start FROM first UNION ALL SELECT c.chrom, (SELECT min(pos) FROM snps s WHERE s.chrom = c.chrom AND s.pos > c.start + 300000) FROM c
WHERE EXISTS (SELECT 1 FROM snps s WHERE s.chrom = c.chrom AND s.pos > c.start + 300000))
SELECT c.chrom, c.start AS chunk_start, count(*) AS n_snps, max(s.pos) AS last_pos FROM c JOIN snps s ON s.chrom = c.chrom AND s.pos >= c.start AND s.pos <= c.start + 300000 GROUP BY c.chrom, c.start""")(lambda s: gt.chunks(s, 300_000))
query("thin_snps", "snps", sql="""
+ RECURSIVE_MARK first AS (SELECT chrom, min(pos) AS pos FROM snps GROUP BY chrom),
c AS (SELECT chrom, pos FROM first UNION ALL SELECT c.chrom, (SELECT min(s.pos) FROM snps s WHERE s.chrom = c.chrom AND s.pos >= c.pos + 100000) FROM c
WHERE EXISTS (SELECT 1 FROM snps s WHERE s.chrom = c.chrom AND s.pos >= c.pos + 100000))
SELECT s.snp, s.chrom, s.pos FROM c JOIN snps s ON s.chrom = c.chrom AND s.pos = c.pos""")(lambda s: gt.thin(s, 100_000))
query("cross_dose", "doses", sql="""+ h AS (SELECT ind, snp, 0 AS hap, CAST(g > 0 AS INT) AS a FROM doses UNION ALL SELECT ind, snp, 1, CAST(g > 1 AS INT) FROM doses),
x AS (SELECT ind AS child, 'm' AS side, ind FROM (SELECT DISTINCT ind FROM doses) UNION ALL SELECT ind, 'f', (ind + 7) % 60 FROM (SELECT DISTINCT ind FROM doses)),
k AS (SELECT DISTINCT ind AS child, 'm' AS side, ind * 3 AS at FROM doses UNION ALL SELECT DISTINCT ind, 'f', ind * 2 FROM doses UNION ALL SELECT DISTINCT ind, 'f', ind * 4 FROM doses)
SELECT x.child, h.snp, CAST(sum(h.a) AS BIGINT) AS dose FROM x JOIN h ON h.ind = x.ind AND h.hap = (SELECT count(*) FROM k WHERE k.child = x.child AND k.side = x.side AND k.at < h.snp) % 2 GROUP BY x.child, h.snp""")(
    lambda d: gt.cross_doses(
        d.select("ind", "snp", F.explode(F.array(F.struct(F.lit(0).alias("hap"), (F.col("g") > 0).cast("int").alias("allele")), F.struct(F.lit(1).alias("hap"), (F.col("g") > 1).cast("int").alias("allele")))).alias("x")).select("ind", "snp", "x.*"),
        d.select("ind").distinct().select(F.col("ind").alias("child"), F.col("ind").alias("mother"), ((F.col("ind") + 7) % 60).alias("father")),
        d.select("ind").distinct().select(F.col("ind").alias("child"), F.explode(F.array(F.struct(F.lit("m").alias("side"), (F.col("ind") * 3).alias("at")), F.struct(F.lit("f").alias("side"), (F.col("ind") * 2).alias("at")), F.struct(F.lit("f").alias("side"), (F.col("ind") * 4).alias("at")))).alias("x")).select("child", "x.*"),
    )
)

# --- tests and statistics -----------------------------------------------------------------------------------

_BH = "SELECT gene, snp, p, min(m * p / rk) OVER (ORDER BY rk DESC) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, snp) AS rk, count(*) OVER () AS m FROM tests)"
_PI0 = f"""SELECT least(arg_min(est, (mse, lam)), 1.0) AS pi0 FROM (SELECT *, w / (m * m * (1 - lam) * (1 - lam)) * (1 - w / m) + (est - q10) * (est - q10) AS mse FROM
(SELECT *, quantile_cont(est, 0.1) OVER () AS q10 FROM (SELECT lam, m, w, w / (m * (1 - lam)) AS est FROM
(SELECT lam, CAST((SELECT count(*) FROM {{0}}) AS DOUBLE) AS m, CAST((SELECT count(*) FROM {{0}} WHERE p >= lam) AS DOUBLE) AS w FROM (SELECT unnest([{", ".join(f"CAST({x!r} AS DOUBLE)" for x in st.LAMBDAS)}]) AS lam)))))"""
_pi0 = lambda t: _PI0.replace("{0}", t)
query("tests_per_gene", "tests", sql="SELECT gene, count(*) AS n_tests FROM tests GROUP BY gene")(assoc.tests_per_gene)
query("bonferroni_per_gene", "tests", sql="SELECT gene, snp, round(least(1.0, p * count(*) OVER (PARTITION BY gene)), 9) AS p_adj FROM tests")(lambda t: st.bonferroni(t).withColumn("p_adj", F.round("p_adj", 9)))
query("bh_fdr", "tests", sql=f"SELECT gene, snp, round(least(1.0, q), 9) AS q FROM ({_BH})")(lambda t: st.bh(t).select("gene", "snp", F.round("q", 9).alias("q")))
query("storey_pi0", "tests", sql=f"SELECT round(pi0, 9) AS pi0 FROM ({_pi0('tests')})")(lambda t: st.pi0(t).select(F.round("pi0", 9).alias("pi0")))
query("storey_qvalue", "tests", sql=f"SELECT gene, snp, round(least(1.0, q) * (SELECT pi0 FROM ({_pi0('tests')})), 9) AS qvalue FROM ({_BH})")(lambda t: st.storey(t).select("gene", "snp", F.round("qvalue", 9).alias("qvalue")))
query("fdr_at_threshold", "tests", sql=f"SELECT CAST(0.05 AS DOUBLE) AS threshold, count(*) FILTER (p <= 0.05) AS hits, round(least(1.0, (SELECT pi0 FROM ({_pi0('tests')})) * count(*) * 0.05 / nullif(count(*) FILTER (p <= 0.05), 0)), 9) AS fdr FROM tests")(lambda t: st.fdr_at(t, 0.05).withColumn("fdr", F.round("fdr", 9)))
query("pvalue_hist", "tests", sql="SELECT CAST(least(floor(p * 99), 98) AS INT) AS bin, count(*) AS n FROM tests GROUP BY 1")(st.histogram)
query("best_marker", "tests", sql="SELECT gene, arg_min(snp, (p, snp)) AS snp, round(min(p), 9) AS p FROM tests GROUP BY gene")(lambda t: assoc.best_marker(t).withColumn("p", F.round("p", 9)))
query("egenes_1a", "tests", sql=f"SELECT gene, round(min(least(1.0, q)), 9) AS value FROM ({_BH}) GROUP BY gene")(lambda t: assoc.egenes(t, "1a").withColumn("value", F.round("value", 9)))
query("egenes_1b", "tests", sql=f"SELECT gene, round(min(least(1.0, q)) * (SELECT pi0 FROM ({_pi0('tests')})), 9) AS value FROM ({_BH}) GROUP BY gene")(lambda t: assoc.egenes(t, "1b").withColumn("value", F.round("value", 9)))


def _egenes(p: str) -> str:
    return f"""+ b AS (SELECT gene, {p} AS p FROM (SELECT gene, min(p) AS low, count(*) AS n FROM tests GROUP BY gene)),
r AS (SELECT *, row_number() OVER (ORDER BY p, gene) AS rk, count(*) OVER () AS m FROM b)
SELECT gene, round(least(1.0, min(m * p / rk) OVER (ORDER BY rk DESC)) * (SELECT pi0 FROM ({_pi0('b')})), 8) AS value FROM r"""


query("egenes_2", "tests", sql=_egenes("least(1.0, low * n)"))(lambda t: assoc.egenes(t, "2").withColumn("value", F.round("value", 8)))
query("egenes_3", "tests", sql=_egenes("1 - power(1 - low, n)"))(lambda t: assoc.egenes(t, "3").withColumn("value", F.round("value", 8)))
query("cis_pairs", "genes", "snps", sql='SELECT gene, snp, g.chrom, pos - tss AS "offset" FROM genes g JOIN snps s ON g.chrom = s.chrom AND abs(pos - tss) <= 200000')(lambda g, s: assoc.cis_pairs(g, s, 200_000))
_EXPR = "SELECT gene, ind, avg(v) AS v FROM (SELECT l_partkey % 40 AS gene, l_suppkey % 60 AS ind, l_extendedprice AS v FROM lineitem) GROUP BY gene, ind"
_TSTAT = """SELECT gene, snp, n, round(r, 6) AS r, round(r * sqrt(n - 2) / nullif(sqrt(1 - r * r), 0), 5) AS t FROM (SELECT e.gene, d.snp, count(*) AS n, corr(e.v, d.g) AS r, var_pop(d.g) AS s FROM e JOIN doses d ON e.ind = d.ind {0} GROUP BY e.gene, d.snp) WHERE s > 0 AND n > 2"""


def _expr(li: DataFrame) -> DataFrame:
    return li.groupBy((F.col("l_partkey") % 40).alias("gene"), (F.col("l_suppkey") % 60).alias("ind")).agg(F.avg("l_extendedprice").alias("v"))


def _rounded(t: DataFrame) -> DataFrame:
    finite = F.when(F.abs("t") < float("inf"), F.col("t"))  # a perfect correlation has no t
    return t.select("gene", "snp", "n", F.round("r", 6).alias("r"), F.round(finite, 5).alias("t"))


_CIS = lambda d, li: assoc.pair_tests(d.select("snp").distinct().withColumn("gene", F.col("snp") % 40), _expr(li), d)
query("cis_stat", "doses", "lineitem", sql=f"+ e AS ({_EXPR}) " + _TSTAT.format("AND d.snp % 40 = e.gene"))(lambda d, li: _rounded(_CIS(d, li)))
query("trans_stat", "doses", "lineitem", sql=f"+ e AS ({_EXPR}) " + _TSTAT.format("AND d.snp % 40 <> e.gene"))(
    lambda d, li: _rounded(assoc.all_pair_tests(_expr(li), d).filter("snp % 40 <> gene"))
)
query("trans_stat_over", "doses", "lineitem", sql=f"+ e AS ({_EXPR}) SELECT * FROM (" + _TSTAT.format("") + ") WHERE abs(t) >= 2.5")(
    lambda d, li: _rounded(assoc.all_pair_tests(_expr(li), d, 2.5 - 1e-5)).filter("abs(t) >= 2.5")  # from 2.499995 on, t is rounded up to 2.5
)
query("assoc_anova", "doses", "lineitem", sql=f"""+ e AS ({_EXPR}), c AS (SELECT e.gene, d.snp, d.g, count(*) AS k, avg(v) AS m, var_pop(v) * count(*) AS w FROM e JOIN doses d ON e.ind = d.ind AND d.snp % 40 = e.gene GROUP BY ALL),
t AS (SELECT gene, snp, CAST(sum(k) AS BIGINT) AS n, count(*) - 1 AS df1, CAST(sum(k) - count(*) AS BIGINT) AS df2, sum(w) AS w, sum(k * m * m) - power(sum(k * m), 2) / sum(k) AS b FROM c GROUP BY gene, snp)
SELECT gene, snp, n, df1, df2, round((b / df1) / (w / df2), 6) AS f FROM t WHERE df1 > 0 AND df2 > 0 AND w > 0""")(lambda d, li: assoc.anova_tests(d.select("snp").distinct().withColumn("gene", F.col("snp") % 40), _expr(li), d).withColumn("f", F.round("f", 6)))
# One covariate: the partial correlation has a closed form.
_FULL = """com AS (SELECT DISTINCT ind FROM doses WHERE ind IN (SELECT ind FROM e)), f AS (SELECT snp FROM doses WHERE ind IN (SELECT ind FROM com) GROUP BY snp HAVING count(DISTINCT ind) = (SELECT count(*) FROM com))"""
query("assoc_covariates", "doses", "lineitem", sql=f"""+ e AS ({_EXPR}), {_FULL}, j AS (SELECT e.gene, d.snp, e.v, d.g, e.ind % 7 AS c FROM e JOIN doses d ON e.ind = d.ind AND d.snp % 40 = e.gene WHERE d.snp IN (SELECT snp FROM f)
AND e.gene IN (SELECT gene FROM e WHERE ind IN (SELECT ind FROM com) GROUP BY gene HAVING count(*) = (SELECT count(*) FROM com))),
p AS (SELECT gene, snp, count(*) AS n, (corr(v, g) - corr(v, c) * corr(g, c)) / sqrt((1 - power(corr(v, c), 2)) * (1 - power(corr(g, c), 2))) AS r FROM j GROUP BY gene, snp HAVING var_pop(g) > 0)
SELECT gene, snp, n, round(r, 6) AS r, round(r * sqrt(n - 3) / sqrt(1 - r * r), 5) AS t FROM p""")(
    lambda d, li: _rounded(assoc.pair_tests(d.select("snp").distinct().withColumn("gene", F.col("snp") % 40), _expr(li), d, d.select("ind").distinct().select("ind", F.lit("c").alias("name"), (F.col("ind") % 7).alias("c"))))
)
query("error_covariance", "phenotypes", sql="""+ m AS (SELECT year AS ind, plot AS item, avg(trait1) AS v FROM phenotypes GROUP BY ALL)
SELECT a.item AS item1, b.item AS item2, round(covar_pop(a.v, b.v), 5) AS v FROM m a JOIN m b ON a.ind = b.ind AND a.item <= b.item WHERE
a.item IN (SELECT item FROM m GROUP BY item HAVING count(*) = (SELECT count(DISTINCT ind) FROM m)) AND b.item IN (SELECT item FROM m GROUP BY item HAVING count(*) = (SELECT count(DISTINCT ind) FROM m)) GROUP BY ALL""")(
    lambda p: assoc.error_covariance(p.groupBy(F.col("year").alias("ind"), F.col("plot").alias("item")).agg(F.avg("trait1").alias("value"))).withColumn("v", F.round("v", 5))
)
query("cis_pvalue", "doses", "lineitem")(lambda d, li: assoc.with_pvalues(_CIS(d, li)))
query("six_number_summary", "phenotypes", sql="""SELECT year, round(min(trait1), 6) AS "min", round(quantile_cont(trait1, 0.25), 6) AS q1, round(quantile_cont(trait1, 0.5), 6) AS median, round(avg(trait1), 6) AS mean, round(quantile_cont(trait1, 0.75), 6) AS q3, round(max(trait1), 6) AS "max" FROM phenotypes GROUP BY year""")(
    lambda p: st.six_numbers(p, "trait1", "year").select("year", *[F.round(c, 6).alias(c) for c in ("min", "q1", "median", "mean", "q3", "max")])
)
query("pearson", "phenotypes", sql="SELECT year, round(corr(trait1, trait2), 6) AS pearson FROM phenotypes GROUP BY year")(lambda p: p.groupBy("year").agg(F.round(F.corr("trait1", "trait2"), 6).alias("pearson")))
query("spearman", "phenotypes", sql="""+ r AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY trait1) + (count(*) OVER (PARTITION BY year, trait1) - 1) / 2.0 AS a, rank() OVER (PARTITION BY year ORDER BY trait2) + (count(*) OVER (PARTITION BY year, trait2) - 1) / 2.0 AS b FROM phenotypes)
SELECT year, round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 6) AS spearman FROM r GROUP BY year""")(lambda p: st.spearman(p, "trait1", "trait2", "year").withColumn("spearman", F.round("spearman", 6)))
query("spread", "phenotypes", sql="SELECT plot, round(var_samp(trait1), 4) AS var, round(stddev_samp(trait1), 6) AS sd FROM phenotypes GROUP BY plot")(lambda p: p.groupBy("plot").agg(F.round(F.var_samp("trait1"), 4).alias("var"), F.round(F.stddev_samp("trait1"), 6).alias("sd")))
query("ols_slope_r2", "phenotypes", sql="""SELECT plot, n, round(slope, 6) AS slope, round(r2, 6) AS r2, round(sqrt((1 - r2) * syy / (n - 2)), 5) AS sigma, round(sqrt((1 - r2) * syy / (n - 2)) / sqrt(sxx), 6) AS se FROM
(SELECT plot, count(*) AS n, regr_slope(trait2, trait1) AS slope, regr_r2(trait2, trait1) AS r2, regr_sxx(trait2, trait1) AS sxx, regr_syy(trait2, trait1) AS syy FROM phenotypes GROUP BY plot) WHERE n > 2 AND sxx > 0""")(
    lambda p: st.ols(p, "trait1", "trait2", "plot").select("plot", "n", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), F.round("sigma", 5).alias("sigma"), F.round("se", 6).alias("se"))
)
query("log10_sum", "phenotypes", sql="SELECT ind, round(log10(avg(power(10, trait1 / 100 - top))) + max(top), 6) AS log10_mean FROM (SELECT *, max(trait1 / 100) OVER (PARTITION BY ind) AS top FROM phenotypes) GROUP BY ind")(
    lambda p: st.log10_sum(p.withColumn("x", F.col("trait1") / 100), "x", "ind").withColumn("log10_mean", F.round("log10_mean", 6))
)
query("log10_weighted_sum", "phenotypes", sql="SELECT ind, round(log10(sum((1 + rec % 5) * power(10, trait1 / 100 - top))) + max(top), 6) AS log10_sum FROM (SELECT *, max(trait1 / 100) OVER (PARTITION BY ind) AS top FROM phenotypes) GROUP BY ind")(
    lambda p: st.log10_weighted_sum(p.select("ind", (F.col("trait1") / 100).alias("x"), (1 + F.col("rec") % 5).alias("w")), "x", "w", "ind").withColumn("log10_sum", F.round("log10_sum", 6))
)
query("qqnorm", "phenotypes", sql=f"""+ r AS (SELECT rec, year, p FROM (SELECT rec, year, (i - a) / (n + 1E0 - 2E0 * a) AS p FROM (SELECT *, CASE WHEN n <= 10 THEN 0.375E0 ELSE 0.5E0 END AS a FROM
(SELECT rec, year, row_number() OVER (PARTITION BY year ORDER BY trait1, rec) AS i, count(*) OVER (PARTITION BY year) AS n FROM phenotypes))))
SELECT rec, year, round({normal_quantile_sql("p")}, 6) AS score FROM r""")(lambda p: st.normal_scores(p, "trait1", "rec", "year").select("rec", "year", F.round("score", 6).alias("score")))
query("median_by_class", "phenotypes", sql="SELECT trait3, median(trait1) AS median FROM phenotypes GROUP BY trait3")(lambda p: p.groupBy("trait3").agg(F.median("trait1").alias("median")))
query("arg_extremes", "phenotypes", sql="SELECT year, arg_max(rec, (trait1, rec)) AS best, arg_min(rec, (trait1, rec)) AS worst FROM phenotypes GROUP BY year")(lambda p: p.groupBy("year").agg(F.max_by("rec", F.struct("trait1", "rec")).alias("best"), F.min_by("rec", F.struct("trait1", "rec")).alias("worst")))
query("count_true", "phenotypes", sql="SELECT year, count(*) FILTER (pathogen) AS n FROM phenotypes GROUP BY year")(lambda p: p.groupBy("year").agg(F.count_if("pathogen").alias("n")))

# --- variants -----------------------------------------------------------------------------------------------

_FLAGS = ", ".join(f"CASE WHEN {c} {'>' if side == 'above' else '<'} {bound} THEN '{name}' END" for name, c, side, bound in va.SITE_RULES)
query("site_filters", "sites", sql=f"SELECT site, ind, concat_ws(';', {_FLAGS}) AS flags FROM sites")(lambda s: va.site_flags(s).select("site", "ind", "flags"))
query("passing_sites", "sites", sql=f"SELECT site, ind FROM sites WHERE concat_ws(';', {_FLAGS}) = ''")(lambda s: va.passing(s).select("site", "ind"))
_MASK = "SELECT site, ind, CASE WHEN dp >= 10 AND gq >= 20 AND gt < 3 THEN gt END AS gt, gq FROM sites"
query("genotype_filters", "sites", sql=f"SELECT site, ind, gt FROM ({_MASK})")(lambda s: va.mask_genotypes(s).select("site", "ind", "gt"))
query("callrate_filter", "sites", sql=f"+ m AS ({_MASK}) SELECT site, ind, gt FROM m WHERE site IN (SELECT site FROM m GROUP BY site HAVING count(*) FILTER (gt IS NULL) <= 0.5 * count(*))")(lambda s: va.well_called(va.mask_genotypes(s)).select("site", "ind", "gt"))
query("allelicity", "sites", sql=f"+ m AS ({_MASK}) SELECT site, CASE WHEN min(gt) = max(gt) AND min(gt) IN (0, 2) THEN 1 ELSE 2 END AS n_alleles FROM m WHERE gt IS NOT NULL GROUP BY site")(lambda s: va.allelicity(va.mask_genotypes(s)))
query("mendel_violation", "sites", sql=f"""+ g AS (SELECT site, ind, gt FROM ({_MASK}) WHERE gt IS NOT NULL)
SELECT c.site, c.ind AS child, m.ind AS mother, f.ind AS father, c.gt AS child_gt, m.gt AS mother_gt, f.gt AS father_gt FROM g c JOIN g m ON m.site = c.site AND m.ind = c.ind - 2 JOIN g f ON f.site = c.site AND f.ind = c.ind - 1
WHERE (c.gt < floor(m.gt / 2.0) + floor(f.gt / 2.0) OR c.gt > ceil(m.gt / 2.0) + ceil(f.gt / 2.0))""")(
    lambda s: va.mendelian_violations(va.mask_genotypes(s), s.select(F.col("ind").alias("child")).distinct().select("child", (F.col("child") - 2).alias("mother"), (F.col("child") - 1).alias("father")))
)

# --- read quality -------------------------------------------------------------------------------------------

query("qc_totals", "qc_quality", sql="SELECT dataset, CAST(sum(n) AS BIGINT) AS total FROM qc_quality GROUP BY dataset")(qc.totals)
query("qc_quality_pivot", "qc_quality", sql="SELECT dataset, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (quality = {q}), 0) AS BIGINT) AS q{q}" for q in range(1, 51)) + " FROM qc_quality GROUP BY dataset")(qc.quality_pivot)
query("qc_quality_percent", "qc_quality", sql="SELECT dataset, " + ", ".join(f"round(100.0 * coalesce(sum(n) FILTER (quality = {q}), 0) / nullif(sum(n), 0), 6) AS q{q}" for q in range(1, 51)) + " FROM qc_quality GROUP BY dataset")(lambda q: qc.quality_pivot(q, percent=True))
query("qc_length_dist", "documents", sql="""WITH l AS (SELECT lang AS dataset, CAST(floor(length(coalesce(text, '')) / 500) * 500 AS INT) AS length, 1 AS n FROM documents)
SELECT d.dataset, x.length, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT DISTINCT dataset FROM l) d CROSS JOIN (SELECT DISTINCT length FROM l) x LEFT JOIN l ON l.dataset = d.dataset AND l.length = x.length GROUP BY d.dataset, x.length""")(
    lambda d: qc.length_bins(d.select(F.col("lang").alias("dataset"), F.concat_ws("-", *[(F.floor(F.length(F.coalesce("text", F.lit(""))) / 500) * 500 + k).cast("string") for k in (0, 499)]).alias("length"), F.lit(1).alias("n")))
)
query("qc_padded_series", "lineitem", sql="""WITH s AS (SELECT l_orderkey AS dataset, l_linenumber AS position, CAST(l_tax AS DOUBLE) AS value FROM lineitem)
SELECT d.dataset, p.position, coalesce(s.value, 0) AS value FROM (SELECT DISTINCT dataset FROM s) d CROSS JOIN (SELECT unnest(range(1, (SELECT max(position) FROM s) + 1)) AS position) p LEFT JOIN s ON s.dataset = d.dataset AND s.position = p.position""")(
    lambda li: qc.padded(li.select(F.col("l_orderkey").alias("dataset"), F.col("l_linenumber").alias("position"), F.col("l_tax").cast("double").alias("value")))
)

# --- breeding -----------------------------------------------------------------------------------------------

query("yield_loss", "phenotypes", sql="SELECT rec, round(CASE WHEN pathogen AND trait3 = 1 THEN trait1 * 0.8 ELSE trait1 END, 6) AS trait1 FROM phenotypes")(lambda p: br.yield_loss(p).select("rec", F.round("trait1", 6).alias("trait1")))
query("pathogen_years", "phenotypes", sql="SELECT DISTINCT year, (year - 2005) % 3 = 0 AS pathogen_year FROM phenotypes")(lambda p: br.pathogen_years(p).select("year", "pathogen_year").distinct())
query("individual_means", "phenotypes", sql="SELECT ind, round(avg(trait1), 6) AS trait1, round(avg(trait2), 6) AS trait2, count(*) AS n FROM phenotypes GROUP BY ind")(lambda p: br.individual_means(p).select("ind", F.round("trait1", 6).alias("trait1"), F.round("trait2", 6).alias("trait2"), "n"))
_MEANS = "SELECT ind, avg(trait1) AS trait1, avg(trait2) AS trait2 FROM phenotypes GROUP BY ind"
query("controls_topk", "phenotypes", sql=f"""+ m AS ({_MEANS}), t AS (SELECT *, row_number() OVER (ORDER BY trait1 DESC, ind) AS k, count(*) OVER () AS n, avg(trait2) OVER () AS mean2 FROM m)
SELECT ind, round(trait1, 6) AS trait1, round(trait2, 6) AS trait2 FROM t WHERE k <= ceil(n / 10.0) AND trait2 > mean2""")(lambda p: br.best_controls(br.individual_means(p)).select("ind", F.round("trait1", 6).alias("trait1"), F.round("trait2", 6).alias("trait2")))
query("registration_rank", "phenotypes", sql=f"""+ m AS ({_MEANS}), c AS (SELECT avg(trait1) AS c1 FROM m WHERE ind % 5 = 0)
SELECT ind, round(trait1, 6) AS trait1, round(trait2, 6) AS trait2, round(trait1 * trait2 / 100, 6) AS "yield", trait1 >= 1.03 * c1 AND trait2 >= 14 AS registered, rank() OVER (ORDER BY round(trait1 * trait2 / 100, 9) DESC) AS rank FROM m CROSS JOIN c WHERE ind % 5 <> 0""")(
    lambda p: br.registered(br.individual_means(p).filter("ind % 5 <> 0"), br.individual_means(p).filter("ind % 5 = 0")).select("ind", *[F.round(c, 6).alias(c) for c in ("trait1", "trait2", "yield")], "registered", "rank")
)
_COST = "CASE task " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in COSTS.items()) + " ELSE 0 END"
query("breeder_budget", "ledger", sql=f"SELECT breeder, task, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(round(sum(quantity * {_COST}), 4) AS DOUBLE) AS cost FROM ledger GROUP BY ROLLUP (breeder, task)")(lambda x: br.budget(x, COSTS).withColumn("cost", F.round("cost", 4)))
query("valid_crosses", "orders", "customer", sql="SELECT o_orderkey AS child, o_custkey AS parent1 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")(
    lambda o, c: br.requests_in_order(o.select(F.col("o_custkey").alias("parent1"), F.lit(None).cast("long").alias("parent2"), F.col("o_orderkey").alias("child")), c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("ind"))).select("child", "parent1")
)
query("blup", "phenotypes", sql="SELECT ind, count(trait1) AS n, round(count(trait1) * 4.0 / (count(trait1) * 4.0 + 9.0) * (avg(trait1) - 50.0), 6) AS blup FROM phenotypes GROUP BY ind")(lambda p: br.blups(p, 50.0, 4.0, 9.0).withColumn("blup", F.round("blup", 6)))
query("lmm_varcomp", "phenotypes")(br.variance_components)
_PHENO = lambda p: p.groupBy((F.col("ind") % 60).alias("ind")).agg(F.avg("trait1").alias("y"))
query("rrblup", "doses", "phenotypes")(lambda d, p: br.ridge_effects(d, _PHENO(p))[0])
query("rrblup_predicted", "doses", "phenotypes")(lambda d, p: br.predict(d, *br.ridge_effects(d, _PHENO(p))))
query("cv_rmspe", "doses", "phenotypes")(lambda d, p: br.cross_validate(d, _PHENO(p)))
query("qtl_scan", "doses", "phenotypes")(lambda d, p: br.marker_scan(d, _PHENO(p)))

# --- web pages and references -------------------------------------------------------------------------------

query("html_links", "pages", sql="""SELECT page_id, CAST(i - 1 AS INT) AS pos, x[i] AS href FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS x FROM pages))""")(bib.links)
query("html_pre_table", "pages", sql="""SELECT page_id, f[1] AS name, TRY_CAST(f[2] AS DOUBLE) AS value FROM (SELECT page_id, string_split(line, chr(9)) AS f FROM
(SELECT page_id, unnest(string_split(block, chr(10))) AS line FROM (SELECT page_id, unnest(regexp_extract_all(concat('<pre>', url, chr(9), CAST(length(html) AS VARCHAR), chr(10), 'size', chr(9), 'large', chr(10), replace(replace(html, '>', chr(10)), ' ', chr(9)), '</pre>'), '(?s)<pre>(.*?)</pre>', 1)) AS block FROM pages)))
WHERE len(f) = 2 AND TRY_CAST(f[2] AS DOUBLE) IS NOT NULL""")(
    lambda p: bib.numeric_rows(p.select("page_id", F.concat(F.lit("<pre>"), "url", F.lit("\t"), F.length("html").cast("string"), F.lit("\nsize\tlarge\n"), F.translate("html", "> ", "\n\t"), F.lit("</pre>")).alias("html")))
)
query("html_accessions", "pages", sql="""SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1)) AS accession, unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 2)) AS description FROM pages""")(
    lambda p: bib.accessions(p, r'<a href="/([^"]*)">([^<]*)</a>')
)
query("note_to_html", "documents", sql=r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '===([^=]+)===', '<h2>\1</h2>', 'g'), '==([^=]+)==', '<h1>\1</h1>', 'g'), '(?m)^\* (.*)$', '<li>\1</li>', 'g'), '(https?://[^\s<]+)', '<a href="\1">\1</a>', 'g') AS html
FROM (SELECT doc_id, concat('==', lang, '== ===', source, '=== http://x.org/', CAST(doc_id AS VARCHAR), ' ', coalesce(text, ''), chr(10), '* ', CAST(n_chars AS VARCHAR)) AS n FROM documents)""")(
    lambda d: d.select("doc_id", bib.note_html(F.concat(F.lit("=="), F.coalesce("lang", F.lit("")), F.lit("== ==="), F.coalesce("source", F.lit("")), F.lit("=== http://x.org/"), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("text", F.lit("")), F.lit("\n* "), F.coalesce(F.col("n_chars").cast("string"), F.lit("")))).alias("html"))
)
query("first_known_key", "orders", "customer", sql="""SELECT entry, arg_min(key, pos) AS key FROM (SELECT o_orderkey AS entry, unnest([o_custkey * 3, o_custkey * 2, o_custkey]) AS key, unnest([0, 1, 2]) AS pos FROM orders) WHERE key IN (SELECT c_custkey FROM customer) GROUP BY entry""")(
    lambda o, c: bib.first_key(o.select(F.col("o_orderkey").alias("entry"), F.array(F.col("o_custkey") * 3, F.col("o_custkey") * 2, F.col("o_custkey")).alias("keys")), c.select(F.col("c_custkey").alias("key")))
)
query("pdf_first", "part", sql="SELECT p_partkey AS entry, concat(CASE WHEN p_size % 2 = 0 THEN p_name || '.pdf|' || p_brand || '.txt' ELSE p_brand || '.PDF|' || p_name || '.html' END) AS files FROM part")(
    lambda p: bib.pdf_first(p.select(F.col("p_partkey").alias("entry"), F.when(F.col("p_size") % 2 == 0, F.array(F.concat("p_brand", F.lit(".txt")), F.concat("p_name", F.lit(".pdf")))).otherwise(F.array(F.concat("p_name", F.lit(".html")), F.concat("p_brand", F.lit(".PDF")))).alias("files"))).select("entry", F.array_join("files", "|").alias("files"))
)
query("ris_fields", "part", sql="""SELECT p_partkey AS entry, tag, pos, value FROM (SELECT p_partkey, unnest(['TI', 'AU', 'ID']) AS tag, unnest([0, 1, 2]) AS pos, unnest([p_name, p_brand, CAST(p_partkey AS VARCHAR)]) AS value FROM part)""")(
    lambda p: bib.ris_fields(p.select(F.col("p_partkey").alias("entry"), F.concat(F.lit("TI  - "), "p_name", F.lit("\nAU  - "), "p_brand", F.lit("\nID  - "), F.col("p_partkey").cast("string"), F.lit("\nER  - ")).alias("text")))
)
query("elapsed_text", "events", sql="""SELECT event_id, printf('%dd %02dh %02dm %02ds', s // 86400, s % 86400 // 3600, s % 3600 // 60, s % 60) AS elapsed FROM (SELECT event_id, event_id * 977 AS s FROM events)""")(lambda e: e.select("event_id", rel.elapsed(F.col("event_id") * 977).alias("elapsed")))

for _name, _sql in ORACLES.items():
    if "RECURSIVE_MARK" in _sql:
        ORACLES[_name] = _sql.replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_MARK", "")
