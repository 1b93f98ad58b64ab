"""Registered queries of the sources and sinks: rows of a view are written in a format, read back, and returned.

Paths are new ones in the folder that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.operators import alignments as al
from genolake.operators import bibliography as bib
from genolake.operators import demultiplex as dm
from genolake.plans.registry import query
from genolake.session import scratch
from genolake.sources import genotype_files as gf
from genolake.sources import tables as tb
from genolake.sources import text_files as tf


def _text(lines: DataFrame, name: str) -> str:
    path = scratch(lines.sparkSession, name)
    lines.write.text(path)
    return path


def _fastq(r: DataFrame) -> DataFrame:
    path = scratch(r.sparkSession, "fastq")
    tf.write_fastq(r.select((F.col("read_id") % 3).alias("part"), F.concat(F.lit("r"), "read_id").alias("read_id"), "seq", F.translate("seq", "ACGT", "I5?+").alias("qual")), path, "part")
    return tf.read_fastq(r.sparkSession, f"{path}/*/*.gz", numbered=False).select("read_id", "seq", "qual")


query("source_fastq", "reads", sql="SELECT concat('r', CAST(read_id AS VARCHAR)) AS read_id, seq, translate(seq, 'ACGT', 'I5?+') AS qual FROM reads")(_fastq)


def _fasta(r: DataFrame) -> DataFrame:
    path = scratch(r.sparkSession, "fasta")
    tf.write_fasta(r.select(F.concat(F.lit("s"), "read_id").alias("name"), "seq"), path, 12)
    return tf.read_fasta(r.sparkSession, path)


query("source_fasta", "reads", sql="SELECT concat('s', CAST(read_id AS VARCHAR)) AS name, seq FROM reads")(_fasta)
query("source_tags", "supplier", sql="SELECT s_name AS sample, upper(substr(md5(s_name), 1, 6)) AS tag FROM supplier")(
    lambda s: tf.read_tags(s.sparkSession, _text(s.select(F.concat_ws("\t", F.replace("s_name", F.lit(" "), F.lit("_")), F.substring(F.md5("s_name"), 1, 6))).coalesce(1), "tags")).select(F.replace("sample", F.lit("_"), F.lit(" ")).alias("sample"), "tag")
)
_ADP = "CASE s_suppkey WHEN 1 THEN 'adpR1' WHEN 2 THEN 'adpR2' ELSE concat('adp', CAST(s_suppkey AS STRING)) END"
query("source_adapter_table", "supplier", sql=f"SELECT {_ADP} AS adapter, upper(substr(md5(s_name), 1, 9)) AS adp_seq FROM supplier")(
    lambda s: tf.read_adapter_table(s.sparkSession, _text(s.select(F.concat_ws("\t", F.expr(_ADP), F.substring(F.md5("s_name"), 1, 9))), "adapters"))
)
query("source_samples", "supplier", sql="SELECT concat('i', CAST(s_suppkey AS VARCHAR)) AS sample, CASE WHEN s_suppkey % 3 > 0 THEN concat('p', CAST(s_suppkey % 3 AS VARCHAR)) END AS population FROM supplier")(
    lambda s: tf.read_samples(s.sparkSession, _text(s.selectExpr("concat_ws('\t', concat('i', s_suppkey), CASE WHEN s_suppkey % 3 > 0 THEN concat('p', s_suppkey % 3) END)"), "samples")).select("sample", "population")
)
query("source_ids", "orders", sql="SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders")(lambda o: tf.read_ids(o.sparkSession, _text(o.select(F.col("o_custkey").cast("string")), "ids")))
query("source_pairs", "orders", sql="SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS value FROM orders")(
    lambda o: tf.read_pairs(o.sparkSession, _text(o.selectExpr("concat(o_orderkey, elt(o_orderkey % 3 + 1, ' ', ',', '\t'), o_custkey)"), "pairs"))
)


def _manifest(c: DataFrame) -> DataFrame:
    path = scratch(c.sparkSession, "manifest.gz")
    cells = {"genotype": F.concat(F.lit("g"), F.when(F.col("c_custkey") % 10 == 0, "_").otherwise(""), "c_custkey"), "ref_genome": F.lit("ref"), "flowcell": F.concat(F.lit("F"), F.col("c_custkey") % 4), "lane": F.col("c_custkey") % 8 + 1}
    tf.write_table(c.select(*[cells.get(k, F.lit("x")).cast("string").alias(k) for k in tf.MANIFEST_COLUMNS]), path)
    found = tf.read_manifest(c.sparkSession, path)
    assert tf.only_genome(found) == "ref"
    return found


query("source_manifest", "customer", sql="SELECT concat('g', CASE WHEN c_custkey % 10 = 0 THEN '_' ELSE '' END, CAST(c_custkey AS VARCHAR)) AS genotype, concat('F', CAST(c_custkey % 4 AS VARCHAR)) AS flowcell, CAST(c_custkey % 8 + 1 AS INT) AS lane FROM customer")(lambda c: _manifest(c).select("genotype", "flowcell", "lane"))
query("manifest_faults", "customer", sql="SELECT concat('g_', CAST(c_custkey AS VARCHAR)) AS genotype FROM customer WHERE c_custkey % 10 = 0")(lambda c: tf.manifest_faults(_manifest(c)).select("genotype"))
query("lane_filter", "customer", sql="SELECT concat('g', CASE WHEN c_custkey % 10 = 0 THEN '_' ELSE '' END, CAST(c_custkey AS VARCHAR)) AS genotype FROM customer WHERE (c_custkey % 4, c_custkey % 8) IN ((1, 1), (2, 6))")(lambda c: tf.of_lanes(_manifest(c), ["F1_2", "F2_7"]).select("genotype"))


def _sam(a: DataFrame) -> DataFrame:
    path = scratch(a.sparkSession, "sam")
    rows = a.select("qname", "flag", "rname", "pos", "mapq", F.concat("seq_len", F.lit("M")).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), "tlen", F.lit("*").alias("seq"), F.lit("*").alias("qual"), F.create_map(F.lit("XT"), F.col("xt"), F.lit("NM"), F.col("nm").cast("string")).alias("tags"))
    tf.write_sam(rows, path, ["@HD\tVN:1.6", "@CO\tmade here"])
    return tf.read_sam(a.sparkSession, path).select("qname", "flag", "rname", "pos", "mapq", "cigar", "tlen", F.col("tags")["XT"].alias("xt"), F.col("tags")["NM"].cast("int").alias("nm"))


query("sink_sam", "alignments", sql="SELECT qname, flag, rname, pos, mapq, concat(CAST(seq_len AS VARCHAR), 'M') AS cigar, tlen, xt, nm FROM alignments")(_sam)


def _bed(a: DataFrame) -> DataFrame:
    path = scratch(a.sparkSession, "bed")
    tf.write_bed(al.to_bed(a), path)
    return tf.read_bed(a.sparkSession, path)


query("sink_bed", "alignments", sql='SELECT rname AS chrom, pos - 1 AS start, pos - 1 + seq_len AS "end", qname AS name FROM alignments')(_bed)


def _stats(r: DataFrame, t: DataFrame) -> DataFrame:
    path = scratch(r.sparkSession, "stats.gz")
    tf.write_table(dm.stats_per_sample(dm.first_starts(r, t), t).orderBy("ind"), path)
    return tf.read_typed(r.sparkSession, path)


query("sink_stats", "reads", "tags", sql="""SELECT t.sample AS ind, t.tag AS barcode, count(r.read_id) AS assigned FROM tags t LEFT JOIN reads r ON starts_with(r.seq, t.tag) GROUP BY t.sample, t.tag""")(_stats)
query("source_typed", "events", sql="SELECT event_id AS id, user_id AS who, event_type AS kind, round(value, 6) AS v FROM events")(lambda e: _typed(e))


def _typed(e: DataFrame) -> DataFrame:
    path = scratch(e.sparkSession, "table")
    tf.write_table(e.select(F.col("event_id").alias("id"), F.col("user_id").alias("who"), F.col("event_type").alias("kind"), F.format_string("%.6f", F.round("value", 6)).alias("v")), path)
    return tf.read_typed(e.sparkSession, path).select("id", "who", "kind", F.round("v", 6).alias("v"))


# --- genotypes: calls of three samples at every marker ---------------------------------------------------------

_CALL = "CASE (snp + {0}) % 4 WHEN 0 THEN 'AA' WHEN 1 THEN 'AG' WHEN 2 THEN 'GG' ELSE 'NN' END"
_CELLS = "(SELECT snp, chrom, pos, unnest(['i0', 'i1', 'i2']) AS ind, unnest([" + ", ".join(_CALL.format(k) for k in range(3)) + "]) AS call FROM snps)"
_PROBS = f"(SELECT *, CAST(call = 'AA' AS INT) AS p_aa, CAST(call = 'AG' AS INT) AS p_ab, CAST(call = 'GG' AS INT) AS p_bb FROM {_CELLS})"


def _calls(s: DataFrame) -> DataFrame:
    """HapMap files of the chromosomes, read by template."""
    spark, folder = s.sparkSession, scratch(s.sparkSession, "hapmap")
    head = "rs# alleles chrom pos strand assembly center protLSID assayLSID panelLSID QCcode i0 i1 i2"
    line = F.concat_ws(" ", F.concat(F.lit("s"), "snp"), F.lit("A/G"), "chrom", "pos", *[F.lit(".")] * 7, *[F.expr(_CALL.format(k)) for k in range(3)])
    files = s.withColumn("file", F.concat(F.lit("x_"), "chrom"))
    for odd in (0, 1):  # two files stand for the chromosomes: odd and even ones
        from genolake.session import first_file

        path = f"{folder}/x_chr{odd + 1}"
        files.filter(F.substring("chrom", 4, 2).cast("int") % 2 == odd).select(line.alias("value")).write.text(path)
        first_file(spark, path, [head])
    return gf.read_hapmap_chromosomes(spark, f"{folder}/x_CHR", "1-2")


query("source_hapmap", "snps", sql=f"SELECT concat('s', CAST(snp AS VARCHAR)) AS snp, chrom, pos, 'A' AS a1, 'G' AS a2, ind, call FROM {_CELLS}")(_calls)


def _impute(s: DataFrame) -> DataFrame:
    spark, path = s.sparkSession, scratch(s.sparkSession, "impute")
    gf.write_lines(gf.impute_lines(gf.to_probabilities(_calls(s))), path)
    return gf.read_impute(spark, path, ["i0", "i1", "i2"])


_NAMED = "concat('s', CAST(snp AS VARCHAR)) AS snp"
query("sink_impute", "snps", sql=f"SELECT chrom, {_NAMED}, pos, 'A' AS a1, 'G' AS a2, ind, CAST(p_aa AS DOUBLE) AS p_aa, CAST(p_ab AS DOUBLE) AS p_ab, CAST(p_bb AS DOUBLE) AS p_bb FROM {_PROBS}")(_impute)
_DIGIT = "CASE call WHEN 'AA' THEN '2' WHEN 'AG' THEN '1' WHEN 'GG' THEN '0' ELSE '9' END"


def _lines(lines: DataFrame, *keep: str) -> DataFrame:
    """Lines as they are read from the files of a sink."""
    path = scratch(lines.sparkSession, "lines")
    gf.write_lines(lines.select("chrom", "pos", *keep, "value"), path, *keep)
    return lines.sparkSession.read.text(path).select("value", *keep)


query("sink_eigenstrat_geno", "snps", sql=f"SELECT {_NAMED}, string_agg({_DIGIT}, '' ORDER BY ind) AS value FROM {_CELLS} GROUP BY snp")(
    lambda s: gf.eigenstrat(gf.to_probabilities(_calls(s)))[0].select("snp", "value")
)
query("sink_eigenstrat_snp", "snps", sql="SELECT concat_ws(chr(9), concat('s', CAST(snp AS VARCHAR)), substr(chrom, 4), '0.0', CAST(pos AS VARCHAR), 'A', 'G') AS value FROM snps")(lambda s: _lines(gf.eigenstrat(gf.to_probabilities(_calls(s)))[1]))
query("sink_eigenstrat_ind", "customer", sql="SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS ind, concat_ws(chr(9), concat('c', CAST(c_custkey AS VARCHAR)), 'U', 'pop') AS value FROM customer")(
    lambda c: gf.eigenstrat_individuals(c.select(F.concat(F.lit("c"), "c_custkey").alias("ind")), "pop")
)
query("sink_bimbam", "snps", sql=f"""SELECT concat_ws(' ', concat('s', CAST(snp AS VARCHAR)), 'A', 'G', string_agg(CASE call WHEN 'AA' THEN '2.0' WHEN 'AG' THEN '1.0' ELSE '0.0' END, ' ' ORDER BY ind)) AS value FROM {_CELLS} GROUP BY snp""")(lambda s: _lines(gf.bimbam(gf.to_probabilities(_calls(s)))[0]))
query("sink_bimbam_annotation", "snps", sql="SELECT concat_ws(' ', concat('s', CAST(snp AS VARCHAR)), CAST(pos AS VARCHAR), chrom) AS value FROM snps")(lambda s: _lines(gf.bimbam(gf.to_probabilities(_calls(s)))[1]))

# --- matrices ---------------------------------------------------------------------------------------------------


def _matrix(e: DataFrame) -> DataFrame:
    path = scratch(e.sparkSession, "matrix")
    cells = e.groupBy("gene", "ind").agg(F.round(F.avg("v"), 6).alias("v"))
    tf.write_table(cells.groupBy("gene").pivot("ind", list(range(10))).agg(F.first("v")), path)
    return tf.read_matrix(e.sparkSession, path, "gene", "ind").select(F.col("gene").cast("long").alias("gene"), F.col("ind").cast("long").alias("ind"), F.col("value"))


_GRID = "SELECT g.gene, i.ind, round(avg(e.v), 6) AS value FROM (SELECT DISTINCT gene FROM expression) g CROSS JOIN (SELECT unnest(range(10)) AS ind) i LEFT JOIN expression e ON e.gene = g.gene AND e.ind = i.ind GROUP BY g.gene, i.ind"
query("source_matrix", "expression", sql=_GRID)(_matrix)


def _gct(e: DataFrame) -> DataFrame:
    path = scratch(e.sparkSession, "m.gct")
    tf.write_gct(e.groupBy(F.concat(F.lit("g"), "gene").alias("feature"), F.concat(F.lit("i"), "ind").alias("sample")).agg(F.round(F.avg("v"), 6).alias("value")), path)
    return tf.read_gct(e.sparkSession, path)


query("sink_gct", "expression", sql=f"SELECT concat('g', CAST(gene AS VARCHAR)) AS feature, concat('i', CAST(ind AS VARCHAR)) AS sample, value FROM ({_GRID})")(_gct)


def _exon_table(x: DataFrame) -> DataFrame:
    path = scratch(x.sparkSession, "exons")
    wide = x.groupBy("gene", "exon_start", "exon_end").pivot("sample", ["A", "N", "R"]).agg(F.sum("n")).na.fill(0)
    tf.write_table(wide, path)
    return tf.read_exon_counts(x.sparkSession, path).withColumn("gene", F.col("gene").cast("long"))


query("source_exon_counts", "exons", sql="""SELECT gene, exon_start, exon_end, s.sample, CAST(coalesce(sum(e.n) FILTER (e.sample = s.sample), 0) AS BIGINT) AS n FROM exons e CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS sample) s GROUP BY gene, exon_start, exon_end, s.sample""")(_exon_table)

# --- entries and tables -----------------------------------------------------------------------------------------


def _json(p: DataFrame) -> DataFrame:
    path = scratch(p.sparkSession, "json")
    files = F.array(F.struct(F.concat("p_brand", F.lit(".txt")).alias("name"), F.lit("0").alias("sha1")), F.struct(F.concat("p_name", F.lit(".pdf")).alias("name"), F.lit("1").alias("sha1")))
    entry = F.struct(F.col("p_partkey").cast("string").alias("article_id"), F.when(F.col("p_partkey") % 5 > 0, F.array(F.concat(F.lit("k"), "p_partkey"), F.lit("other"))).alias("citation_keys"), files.alias("userfiles"))
    p.groupBy(F.col("p_partkey") % 16).agg(F.to_json(F.collect_list(entry)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return bib.entry_files(bib.read_json_entries(p.sparkSession, path)).select("article_id", "key", F.array_join("files", "|").alias("files"))


query("source_json", "part", sql="SELECT CAST(p_partkey AS VARCHAR) AS article_id, CASE WHEN p_partkey % 5 > 0 THEN concat('k', CAST(p_partkey AS VARCHAR)) END AS key, concat(p_name, '.pdf|', p_brand, '.txt') AS files FROM part")(_json)


def _bibtex(p: DataFrame) -> DataFrame:
    fields = p.select(F.lit("article").alias("type"), F.concat(F.lit("K"), "p_partkey").alias("key"), F.explode(F.create_map(F.lit("title"), F.col("p_name"), F.lit("author"), F.concat("p_brand", F.lit(" and others")))).alias("field", "value"))
    return bib.bibtex_fields(p.sparkSession.read.option("lineSep", "\0").text(_text(bib.bibtex_text(fields).select("text"), "bibtex")).select(F.col("value").alias("text")))


query("source_bibtex", "part", sql="SELECT 'article' AS type, concat('K', CAST(p_partkey AS VARCHAR)) AS key, unnest(['title', 'author']) AS field, unnest([p_name, p_brand || ' and others']) AS value FROM part")(_bibtex)
_RIS = "concat('TI  - ', p_name, '\nAU  - ', p_brand, '\nAU  - ', p_type, '\nL1  - a.pdf\nL3  - b.pdf\nID  - ', p_partkey, '\nER  - ')"
query("ris_records", "part", sql="SELECT CAST(p_partkey AS VARCHAR) AS id, concat(p_brand, '|', p_type) AS authors, 'a.pdf|b.pdf' AS files FROM part")(
    lambda p: bib.ris_records(bib.ris_fields(p.select(F.col("p_partkey").alias("entry"), F.expr(_RIS).alias("text")))).select("id", F.array_join(F.col("fields")["AU"], "|").alias("authors"), F.array_join(F.col("fields")["files"], "|").alias("files"))
)
query("sink_ris", "part", sql="SELECT CAST(p_partkey AS VARCHAR) AS id, unnest(['TI  - ' || p_name, 'AU  - ' || p_brand, 'AU  - ' || p_type, 'L1  - a.pdf', 'L3  - b.pdf', 'ID  - ' || CAST(p_partkey AS VARCHAR)]) AS line FROM part")(
    lambda p: bib.ris_lines(bib.ris_fields(p.select(F.col("p_partkey").alias("entry"), F.expr(_RIS).alias("text")))).select("id", "line")
)
query("html_inputs", "pages", sql="SELECT page_id, url AS target FROM pages")(
    lambda p: bib.inputs(p.select("page_id", F.concat(F.regexp_replace("html", "(?i)<input", "<was"), F.lit('<INPUT type="button" value="View full table..." onclick="window.open(\''), "url", F.lit("', '_blank')\">")).alias("html")))
)


def _saved(c: DataFrame, o: DataFrame) -> DataFrame:
    spark, path = c.sparkSession, scratch(c.sparkSession, "plants")
    name = "plants_" + path.split("scratch-")[1][:32]
    tb.replace_table(c.select(F.col("c_custkey").alias("child"), F.lit("start").alias("breeder")), name, path)
    tb.insert_rows(o.select(F.lit("game").alias("breeder"), (F.col("o_orderkey") + 10**9).alias("child")), name)
    return tb.rows_where(spark, name, "breeder", "game").select("child").union(tb.rows_where(spark, name, "breeder", "start").select(-F.col("child")))


query("saved_table", "customer", "orders", sql="SELECT o_orderkey + 1000000000 AS child FROM orders UNION ALL SELECT -c_custkey FROM customer")(_saved)
