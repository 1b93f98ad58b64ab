"""Registered queries of filters, checks, unions and orders, and of demultiplexing and trimming with errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.functions.dna import motif_pattern, remaining_motif
from genolake.operators import alignments as al
from genolake.operators import demultiplex as dm
from genolake.operators import genotypes as gt
from genolake.operators import relational as rel
from genolake.operators import trimming as tr
from genolake.operators import variants as va
from genolake.plans.registry import query

MOTIF = motif_pattern(remaining_motif("G^CWG_C"))

# --- demultiplexing with substitutions ----------------------------------------------------------------------------

_START = "hamming(substr({0}, 1, length(tag)), tag)"
_PICK = "QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY off, tag_rank) = 1"
query("demux_subst_met1", "reads", "long_tags", sql=f"""SELECT read_id, sample, substr(seq, length(tag) + 1) AS clip1, substr(seq2, length(tag) + 1) AS clip2
FROM (SELECT *, {_START.format("seq")} AS o1, {_START.format("seq2")} AS o2, o1 + o2 AS off FROM reads CROSS JOIN long_tags) WHERE o1 <= 2 AND o2 <= 2 {_PICK}""")(lambda r, t: dm.both_start(r, t, 2))
query("demux_subst_met2", "reads", "long_tags", sql=f"""SELECT read_id, sample, CASE WHEN o1 <= 1 THEN substr(seq, length(tag) + 1) ELSE seq END AS clip1, CASE WHEN o2 <= 1 THEN substr(seq2, length(tag) + 1) ELSE seq2 END AS clip2,
CAST(o1 <= 1 AS INT) + CAST(o2 <= 1 AS INT) AS n_mates FROM (SELECT *, {_START.format("seq")} AS o1, {_START.format("seq2")} AS o2, least(o1, o2) AS off FROM reads CROSS JOIN long_tags) WHERE off <= 1 {_PICK}""")(lambda r, t: dm.either_start(r, t, 1))


def window_sql(seq: str, tags: str, patterns: str, length: str, window: int, most: int) -> str:
    """Leftmost match of every tag in the window, then the best tag of a read."""
    off = "least(" + ", ".join(f"hamming(substr({seq}, s, {length}), {p})" for p in patterns.split("|")) + ")"
    return f"""SELECT read_id, sample, CAST(s AS INT) AS at, substr({seq}, s + length(tag)) AS clip1 FROM (SELECT * FROM (SELECT *, {off} AS off FROM
(SELECT r.*, t.*, unnest(range(1, {window} - ({length}) + 2)) AS s FROM reads r CROSS JOIN {tags} t)) WHERE off <= {most}
QUALIFY row_number() OVER (PARTITION BY read_id, tag_rank ORDER BY s) = 1) {_PICK}"""


_WITH_MOTIF = "|".join(f"concat(tag, '{m}')" for m in ("CAGC", "CTGC"))
query("demux_subst_met4b", "reads", "long_tags", sql=window_sql("seq", "long_tags", "tag", "length(tag)", 10, 1))(lambda r, t: dm.within(r, t, 10, 1))
query("demux_subst_met4c", "reads", "tags", sql=window_sql("seq", "tags", _WITH_MOTIF, "length(tag) + 4", 20, 1))(lambda r, t: dm.with_motif(r, t, MOTIF, 20, 1))
query("demux_subst_met4d", "reads", "tags", sql=f"""
+ one AS (SELECT read_id, sample AS s1, length(seq) - length(clip1) AS c1 FROM ({window_sql("seq", "tags", _WITH_MOTIF, "length(tag) + 4", 20, 1)}) JOIN reads USING (read_id)),
two AS (SELECT read_id, sample AS s2, length(seq2) - length(clip1) AS c2 FROM ({window_sql("seq2", "tags", _WITH_MOTIF, "length(tag) + 4", 20, 1)}) JOIN reads USING (read_id))
SELECT read_id, CASE WHEN s1 <> s2 THEN 'chimera' ELSE coalesce(s1, s2) END AS sample, CASE WHEN s1 <> s2 THEN seq ELSE substr(seq, coalesce(c1, c2) + 1) END AS clip1,
CASE WHEN s1 <> s2 THEN seq2 ELSE substr(seq2, coalesce(c2, c1) + 1) END AS clip2 FROM reads LEFT JOIN one USING (read_id) LEFT JOIN two USING (read_id) WHERE s1 IS NOT NULL OR s2 IS NOT NULL""")(lambda r, t: dm.either_with_motif(r, t, MOTIF, 20, 1))

# --- trimming of pairs, adapters with errors -------------------------------------------------------------------------

_MATES = "(SELECT *, CASE adp_rank % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE 'both' END AS mate FROM adapters)"
_FOUND = f"""f AS (SELECT read_id, 1 AS mate, adapter, CAST(instr(seq, adp_seq) - 1 AS INT) AS start FROM reads CROSS JOIN {_MATES} WHERE mate IN ('1', 'both')
UNION ALL SELECT read_id, 2, adapter, CAST(instr(seq2, adp_seq) - 1 AS INT) FROM reads CROSS JOIN {_MATES} WHERE mate IN ('2', 'both'))"""
_CUTS = f"""{_FOUND}, c AS (SELECT read_id, seq, seq2, CAST(coalesce(min(start) FILTER (mate = 1 AND start >= 0), length(seq)) AS INT) AS cut1, CAST(coalesce(min(start) FILTER (mate = 2 AND start >= 0), length(seq2)) AS INT) AS cut2
FROM reads JOIN f USING (read_id) GROUP BY read_id, seq, seq2)"""


def _pairs(r: DataFrame, a: DataFrame) -> DataFrame:
    return tr.trim_pairs(r, a.withColumn("mate", F.expr("CASE adp_rank % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE 'both' END")))


query("trim_paired", "reads", "adapters", sql=f"+ {_CUTS} SELECT read_id, cut1, cut2, substr(seq, 1, cut1) AS trimmed1, substr(seq2, 1, cut2) AS trimmed2 FROM c")(lambda r, a: _pairs(r, a).select("read_id", "cut1", "cut2", "trimmed1", "trimmed2"))
query("trim_paired_log", "reads", "adapters", sql=f"+ {_FOUND} SELECT * FROM f")(lambda r, a: tr.match_log(_pairs(r, a)))
query("trim_paired_counters", "reads", "adapters", sql=f"""+ {_CUTS} SELECT count(*) AS pairs, count(*) FILTER (cut1 < length(seq) AND cut2 < length(seq2)) AS trimmed_pairs,
count(*) FILTER (cut1 < length(seq) AND cut2 = length(seq2)) AS trimmed_r1, count(*) FILTER (cut1 = length(seq) AND cut2 < length(seq2)) AS trimmed_r2 FROM c""")(lambda r, a: tr.pair_counters(_pairs(r, a)))
_ADAPTER = "ACGTACGATC"
query("adapter_removal", "reads", sql=f"""SELECT read_id, CAST(coalesce(s - 1, length(seq)) AS INT) AS cut, substr(seq, 1, coalesce(s - 1, length(seq))) AS seq FROM reads LEFT JOIN
(SELECT read_id, s FROM (SELECT read_id, s, i, hamming(substr(seq, s, i), substr('{_ADAPTER}', 1, i)) AS errors FROM
(SELECT read_id, seq, s, CAST(least(10, length(seq) - s + 1) AS BIGINT) AS i FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS s FROM reads)) WHERE i >= 3) WHERE errors <= floor(0.2 * i + 1e-9)
QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY i DESC, errors, s) = 1) USING (read_id)""")(lambda r: tr.remove_adapter(r, _ADAPTER, indels=False).select("read_id", "cut", "seq"))
query("adapter_removal_indels", "reads")(lambda r: tr.remove_adapter(r, _ADAPTER).select("read_id", "cut", "seq"))
query("fragment_mates", "reads", sql="SELECT CAST(read_id AS VARCHAR) AS name, substr(seq, 1, 10) AS seq, reverse(translate(substr(seq, 23), 'ACGT', 'TGCA')) AS seq2 FROM reads")(lambda r: tr.fragment_mates(r.select(F.col("read_id").cast("string").alias("name"), "seq"), 10))

# --- filters and checks ------------------------------------------------------------------------------------------------

query("autosomes", "snps", sql="SELECT snp, chrom FROM (SELECT snp, CASE WHEN snp % 9 = 0 THEN 'chrX' ELSE chrom END AS chrom FROM snps) WHERE chrom <> 'chrX'")(
    lambda s: gt.autosomes(s.select("snp", F.when(F.col("snp") % 9 == 0, "chrX").otherwise(F.col("chrom")).alias("chrom")))
)
query("moved_markers", "snps", "genes", sql="SELECT snp, chrom, pos FROM snps WHERE snp IN (SELECT gene FROM genes)")(lambda s, g: rel.moved_or_removed(s, g.select(F.col("gene").alias("snp")), g.limit(0).select(F.col("gene").alias("snp")), "snp"))
query("removed_markers", "snps", "genes", sql="SELECT snp, chrom, pos FROM snps WHERE snp NOT IN (SELECT gene FROM genes)")(lambda s, g: rel.moved_or_removed(s, g.select(F.col("gene").alias("snp")), g.select(F.col("gene").alias("snp")), "snp"))
query("discard_positions", "calls", "nation", sql="SELECT rec, ind FROM calls WHERE ind % 50 NOT IN (SELECT n_nationkey FROM nation)")(
    lambda c, n: rel.without_positions(c.select("rec", "ind", (F.col("ind") % 50).alias("pos")), n.select(F.col("n_nationkey").alias("pos"))).select("rec", "ind")
)
query("restrict_genotypes", "genotypes", sql="SELECT ind, snp, g FROM genotypes WHERE chrom = 3 AND ind % 3 = 1")(lambda g: gt.of_population(gt.of_chromosome(g, 3), g.filter("ind % 3 = 1").select("ind").distinct()).select("ind", "snp", "g"))
query("normalised_ids", "customer", sql="SELECT c_custkey, replace(c_phone_like, '-', '.') AS id FROM (SELECT c_custkey, concat(c_mktsegment, '-', CAST(c_custkey AS VARCHAR)) AS c_phone_like FROM customer)")(
    lambda c: c.select("c_custkey", gt.normal_id(F.concat("c_mktsegment", F.lit("-"), "c_custkey")).alias("id"))
)
query("bed_one_based", "alignments", sql='SELECT rname AS chrom, pos AS start, pos - 1 + seq_len AS "end" FROM alignments')(lambda a: al.one_based(al.to_bed(a)).select("chrom", "start", "end"))
query("bed_starts_only", "alignments", sql='SELECT rname AS chrom, pos AS start, pos AS "end" FROM alignments')(lambda a: al.one_based(al.to_bed(a), starts_only=True).select("chrom", "start", "end"))
query("called_at_most", "sites", sql="SELECT site, ind FROM sites WHERE site IN (SELECT site FROM sites GROUP BY site HAVING count(*) FILTER (gt = 3) <= 1)")(
    lambda s: va.well_called(s.withColumn("gt", F.when(F.col("gt") < 3, F.col("gt"))), None, 1).select("site", "ind")
)
query("drop_columns", "phenotypes", sql="SELECT rec, ind, year, plot, pathogen FROM phenotypes")(lambda p: rel.without_columns(p, "^trait"))
query("unsorted_rows", "exons", sql="SELECT sample, exon_start, gene, before FROM (SELECT *, lag(gene) OVER (PARTITION BY sample ORDER BY exon_start) AS before FROM (SELECT sample, exon_start, min(gene) AS gene FROM exons GROUP BY ALL)) WHERE gene < before")(lambda x: rel.out_of_order(x.groupBy("sample", "exon_start").agg(F.min("gene").alias("gene")), "sample", "exon_start", "gene").select("sample", "exon_start", "gene", "before"))
query("aligned_columns", "expression", "doses", sql="""SELECT e.ind, e.m AS expression, d.m AS dose FROM (SELECT ind, round(avg(v), 4) AS m FROM expression GROUP BY ind) e JOIN (SELECT ind % 10 AS ind, round(avg(g), 8) AS m FROM doses GROUP BY 1) d ON e.ind = d.ind""")(
    lambda e, d: rel.aligned(e.groupBy("ind").agg(F.round(F.avg("v"), 4).alias("expression")), d.groupBy((F.col("ind") % 10).alias("ind")).agg(F.round(F.avg("g"), 8).alias("dose")), "ind")
)
_FILES = """files AS (SELECT 'genotype' AS kind, 's' AS subgroup, concat('c', CAST(c_custkey AS VARCHAR)) AS sample, c_custkey AS pos FROM customer
UNION ALL SELECT 'phenotype', 't', concat('c', CAST(s_suppkey * 3 AS VARCHAR)), s_suppkey FROM supplier)"""


def _files(c: DataFrame, s: DataFrame) -> DataFrame:
    one = c.select(F.lit("genotype").alias("kind"), F.lit("s").alias("subgroup"), F.concat(F.lit("c"), "c_custkey").alias("sample"), F.col("c_custkey").alias("pos"))
    return one.union(s.select(F.lit("phenotype"), F.lit("t"), F.concat(F.lit("c"), F.col("s_suppkey") * 3), "s_suppkey"))


query("sample_places", "customer", "supplier", sql=f"""WITH {_FILES} SELECT sample, row_number() OVER (ORDER BY k, subgroup, pos) - 1 AS place FROM
(SELECT sample, min(CASE kind WHEN 'phenotype' THEN 0 ELSE 1 END) AS k, arg_min(subgroup, CASE kind WHEN 'phenotype' THEN 0 ELSE 1 END) AS subgroup, arg_min(pos, CASE kind WHEN 'phenotype' THEN 0 ELSE 1 END) AS pos FROM files GROUP BY sample)""")(
    lambda c, s: rel.samples_in_order(_files(c, s))
)
query("union_distinct", "customer", "supplier", sql="SELECT c_nationkey AS nation, c_custkey % 7 AS k FROM customer UNION SELECT s_nationkey, s_suppkey % 9 FROM supplier")(
    lambda c, s: rel.union_distinct(c.select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 7).alias("k")), s.select("s_nationkey", F.col("s_suppkey") % 9))
)
query("inverted_map", "orders", sql="SELECT o_custkey AS value, string_agg(k, ',' ORDER BY k) AS keys FROM (SELECT DISTINCT o_custkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders) GROUP BY o_custkey")(
    lambda o: rel.inverted(o.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").alias("value"))).select("value", F.array_join("keys", ",").alias("keys"))
)
query("formatted_dates", "events", sql="SELECT event_id, strftime(DATE '2015-01-01' + CAST(event_id % 900 AS INT), '%Y-%m-%d %H:%M') AS stamp, printf('%05d', event_id) AS padded FROM events")(
    lambda e: e.select("event_id", F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), (F.col("event_id") % 900).cast("int")), "yyyy-MM-dd HH:mm").alias("stamp"), F.format_string("%05d", "event_id").alias("padded"))
)
