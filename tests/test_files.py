"""Readers and writers on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from genolake.operators import quality_reports as qc
from genolake.sources import genotype_files as gf
from genolake.sources import text_files as tf
from genolake.streaming.demultiplex_stream import run_stream


def put(path, text):
    if str(path).endswith(".gz"):
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


def test_fastq(spark, tmp_path):
    path = put(tmp_path / "r.fq.gz", "@r1 1\nACGT\n+\nIIII\n@r2 1\nTT\n+\n@@\n")
    got = [(r.file_pos, r.read_id, r.seq, r.qual) for r in tf.read_fastq(spark, path).orderBy("file_pos").collect()]
    assert got == [(0, "r1 1", "ACGT", "IIII"), (1, "r2 1", "TT", "@@")]
    tf.write_fastq(tf.read_fastq(spark, path).withColumn("sample", F.lit("s1")), str(tmp_path / "out"), "sample")
    again = tf.read_fastq(spark, str(tmp_path / "out" / "sample=s1"))
    assert sorted(r.seq for r in again.collect()) == ["ACGT", "TT"]


def test_fasta_tags_adapters(spark, tmp_path):
    fa = put(tmp_path / "t.fa", ">ind1\nAA\nA\n>ind2\nTTT\n")
    assert [(r.sample, r.tag) for r in tf.read_tags(spark, fa).orderBy("tag_rank").collect()] == [("ind1", "AAA"), ("ind2", "TTT")]
    tsv = put(tmp_path / "t.tsv", "id\ttag\nind1\taaa\nind2\tTTT\n")
    assert [(r.sample, r.tag) for r in tf.read_tags(spark, tsv).orderBy("tag_rank").collect()] == [("ind1", "AAA"), ("ind2", "TTT")]
    with pytest.raises(ValueError):
        tf.read_tags(spark, put(tmp_path / "bad.tsv", "a b c\n"))
    ad = put(tmp_path / "a.fa", ">adp2_rc/1\nTTT\n>adp1_rc/2\nCTATTT\n>x\nA\n")
    assert sorted((r.adp_seq, r.mate) for r in tf.read_adapters(spark, ad).collect()) == [("A", "both"), ("CTATTT", "2"), ("TTT", "1")]


def test_sam_bed_lists(spark, tmp_path):
    sam = put(tmp_path / "x.sam", "@HD\nq1\t0\tchr1\t10\t30\t4M\t*\t0\t0\tACGT\tIIII\tXT:A:U\tNM:i:1\n")
    r = tf.read_sam(spark, sam).first()
    assert (r.qname, r.flag, r.pos, r.tags) == ("q1", 0, 10, {"XT": "U", "NM": "1"})
    bed = put(tmp_path / "x.bed", "chr1\t5\t9\tn1\nchr2 1 2\n")
    assert [tuple(x) for x in tf.read_bed(spark, bed).collect()] == [("chr1", 5, 9, "n1"), ("chr2", 1, 2, None)]
    ids = put(tmp_path / "ids", "# c\nb\na\nb\n")
    assert sorted(x.id for x in tf.read_ids(spark, ids).collect()) == ["a", "b"]
    assert [tuple(x) for x in tf.read_pairs(spark, put(tmp_path / "p", "a 1\nb,2\n")).collect()] == [("a", "1"), ("b", "2")]
    with pytest.raises(Exception, match="not two columns"):
        tf.read_pairs(spark, put(tmp_path / "p3", "a 1 2\n")).collect()


def test_manifest(spark, tmp_path):
    head = "\t".join(tf.MANIFEST_COLUMNS)
    row = "\t".join(["g_1", "ref", "l", "AAAA", "c", "p", "m", "F1", "1", "2020-01-01", "a", "b"])
    m = tf.read_manifest(spark, put(tmp_path / "m.tsv", f"{head}\n#x\n{row}\n{row.replace('g_1', 'g1')}\n"))
    assert m.count() == 2 and tf.manifest_faults(m).count() == 1
    with pytest.raises(ValueError):
        tf.read_manifest(spark, put(tmp_path / "m2.tsv", "a\tb\n1\t2\n"))


def test_matrices(spark, tmp_path):
    path = put(tmp_path / "m.tsv", "id\ts1\ts2\ng1\t1.5\tNA\ng2\t2\t3\n")
    got = {(r.feature, r.sample): r.value for r in tf.read_matrix(spark, path).collect()}
    assert got == {("g1", "s1"): 1.5, ("g1", "s2"): None, ("g2", "s1"): 2.0, ("g2", "s2"): 3.0}
    gct = put(tmp_path / "m.gct", "#1.2\n2\t2\nName\tDescription\ts1\ts2\ng1\td\t1\tNA\ng2\td\t3\t4\n")
    assert {(r.feature, r.sample): r.value for r in tf.read_gct(spark, gct).collect()} == {("g1", "s1"): 1.0, ("g1", "s2"): None, ("g2", "s1"): 3.0, ("g2", "s2"): 4.0}


def test_genotype_formats(spark, tmp_path):
    cols = "rs# alleles chrom pos strand assembly center protLSID assayLSID panelLSID QCcode i1 i2 i3"
    hap = put(tmp_path / "h.txt", f"{cols}\nrs1 A/G chr1 100 + a b c d e f AA AG NN\nrs2 C/T chrX 50 + a b c d e f TT CT CC\n")
    calls = gf.read_hapmap(spark, hap)
    assert calls.count() == 6 and gf.read_hapmap(spark, hap, ["i1"]).count() == 2
    probs = gf.to_probabilities(calls)
    lines = {r.value for r in gf.impute_lines(probs).collect()}
    assert lines == {"chr1 rs1 100 A G 1 0 0 0 1 0 0 0 0", "chrX rs2 50 C T 0 0 1 0 1 0 1 0 0"}
    back = gf.read_impute(spark, put(tmp_path / "i.txt", "\n".join(sorted(lines)) + "\n"), ["i1", "i2", "i3"])
    geno, snp = gf.eigenstrat(back)
    assert {r.snp: r.value for r in geno.collect()} == {"rs1": "219", "rs2": "012"}
    assert "rs2\t23\t0.0\t50\tC\tT" in {r.value for r in snp.collect()}
    dose, note = gf.bimbam(back)
    assert "rs1 A G 2.0 1.0 0.0" in {r.value for r in dose.collect()} and "rs2 50 chrX" in {r.value for r in note.collect()}
    gf.write_lines(geno, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["219", "012"]
    tped = put(tmp_path / "t.tped", "1 rs1 0 100 A A A G\n1 rs2 0 200 C T 0 0\n")
    tfam = put(tmp_path / "t.tfam", "f1 i1 0 0 1 1\nf2 i2 0 0 1 1\n")
    got = gf.to_probabilities(gf.with_alleles(gf.read_tped(spark, tped, tfam)))
    assert {(r.snp, r.ind): (r.p_aa, r.p_ab, r.p_bb) for r in got.collect()} == {("rs1", "i1"): (1, 0, 0), ("rs1", "i2"): (0, 1, 0), ("rs2", "i1"): (0, 1, 0), ("rs2", "i2"): (0, 0, 0)}
    with pytest.raises(Exception, match="not two alleles"):
        gf.with_alleles(gf.read_tped(spark, put(tmp_path / "b.tped", "1 rs1 0 100 A A A A\n"), tfam)).collect()


def test_quality_report(spark):
    text = ">>Basic Statistics\tpass\n#Measure\tValue\nTotal Sequences\t100\nEncoding\tx\n>>END_MODULE\n>>Per base\twarn\n#Base\tMean\n1\t30.5\n2\t31\n>>END_MODULE\n"
    cells = qc.parse_report(spark.createDataFrame([("d1", text)], "dataset string, text string")).collect()
    got = {(r.module, r.row, r.name): r.value for r in cells}
    assert got[("Basic_Statistics", 0, "Value")] == "100" and got[("Per_base", 1, "Mean")] == "31"
    assert {r.number for r in cells if r.module == "Per_base" and r.name == "Mean"} == {30.5, 31.0}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("r1", "AAACC"), ("r2", "GGG")], "read_id string, seq string").write.parquet(str(tmp_path / "in"))
    tags = spark.createDataFrame([("ind1", "AAA", 0)], "sample string, tag string, tag_rank int")
    for _ in range(2):  # the second run finds nothing new
        run_stream(spark, str(tmp_path / "in"), tags, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = {r.read_id: (r.sample, r.clip1) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"r1": ("ind1", "CC"), "r2": ("unassigned", "GGG")}


def test_archives_and_kept_results(spark, tmp_path):
    import zipfile

    from genolake.sources import archives

    with zipfile.ZipFile(tmp_path / "d1_fastqc.zip", "w") as z:
        z.writestr("d1_fastqc/fastqc_data.txt", ">>Basic Statistics\tpass\n#Measure\tValue\nTotal Sequences\t7\n>>END_MODULE\n")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = {r.dataset: (r.text is not None, r.fault) for r in archives.read_report_archives(spark, str(tmp_path)).collect()}
    assert got == {"d1": (True, None), "bad": (False, "BadZipFile")}
    cells = qc.parse_report(archives.read_report_archives(spark, str(tmp_path)).filter("fault is null"))
    assert [r.value for r in cells.filter("name = 'Value'").collect()] == ["7"]
    assert archives.one_file(spark, f"{tmp_path}/bad*.zip").endswith("bad.zip")
    with pytest.raises(ValueError):
        archives.one_file(spark, f"{tmp_path}/*.zip")
    made = []
    for _ in range(2):
        df = archives.kept(spark, str(tmp_path / "kept"), lambda: made.append(1) or spark.range(3))
    assert df.count() == 3 and made == [1]
    assert archives.missing_chunks(spark.range(3), spark.range(2), "id").count() == 1


def test_ris_lines_send_no_table_of_ids_through_the_driver(spark):
    from genolake.operators import bibliography as bib

    rows = [(1, "TI", 0, "b"), (1, "ID", 1, "Z2"), (1, "ID", 2, "A9"), (2, "ID", 0, "a1"), (2, "TI", 1, "a"), (3, "TI", 0, "no id"), (None, "ID", 0, "none")]
    lines = bib.ris_lines(spark.createDataFrame(rows, "entry long, tag string, pos int, value string"))
    assert [tuple(x) for x in lines.collect()] == [("a1", 0, "ID  - a1"), ("a1", 1, "TI  - a"), ("Z2", 0, "TI  - b"), ("Z2", 1, "ID  - Z2"), ("Z2", 2, "ID  - A9")]
    # Over a file of a few rows the planner would broadcast any table that may be.
    text = spark.range(10).select(F.col("id").alias("entry"), F.concat(F.lit("TI  - t\nID  - "), "id").alias("text"))
    plan = bib.ris_lines(bib.ris_fields(text))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
