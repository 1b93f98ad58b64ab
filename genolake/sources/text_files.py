"""Readers and writers of line-based formats. Plain or gzip, by suffix, as Spark's text source does."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genolake.operators.relational import assert_unique
from genolake.sources.record_files import FastaSource, FastqSource, load

MOST_COLUMNS = 20_000
MANIFEST_COLUMNS = ["genotype", "ref_genome", "library", "barcode", "seq_center", "seq_platform", "seq_platform_model", "flowcell", "lane", "date", "fastq_file_R1", "fastq_file_R2"]


def numbered_lines(spark: SparkSession, path: str, starts: str | None = None) -> DataFrame:
    """(file, line_no, record, line): lines numbered within each file, however large, as records depend on their order.

    Splits of a file are numbered side by side and shifted by the lines of the splits before; what is joined for that
    is one row per split. ``record`` counts, in the same way, the lines that begin with ``starts``.
    """

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        at: dict = {}
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            first = pc.starts_with(batch.column(2), starts).to_pylist() if starts else [False] * len(keys)
            nos, records = [], []
            for key, new in zip(keys, first, strict=True):
                no, record = at.get(key, (0, 0))
                record += new
                nos.append(no)
                records.append(record)
                at[key] = no + 1, record
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nos, pa.int64()), pa.array(records, pa.int64()), batch.column(2)], names=["file", "split", "no", "rec", "line"])

    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))
    lines = raw.mapInArrow(number, "file string, split long, no long, rec long, line string")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("file", "split").agg((F.max("no") + 1).alias("n"), F.max("rec").alias("r"))
    shift = sizes.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r"))
    return lines.join(shift, ["file", "split"]).select("file", (F.col("no") + F.col("n")).alias("line_no"), (F.col("rec") + F.col("r")).alias("record"), "line")


def _numbered_records(records: DataFrame) -> DataFrame:
    """Adds ``record``, the 0-based number in the file: that in the range, shifted by the ranges before (one row per range)."""
    sizes = records.groupBy("file", "range_start").agg((F.max("no") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("file", "range_start", F.coalesce(before, F.lit(0)).alias("before"))
    return records.join(shift, ["file", "range_start"]).withColumn("record", F.col("no") + F.col("before"))


def read_fastq(spark: SparkSession, path: str, numbered: bool = True, range_bytes: int | None = None) -> DataFrame:
    """(file, file_pos, read_id, seq, qual): four lines a record. What is no whole record is an error with file and byte.

    Ranges of files are read side by side, without a shuffle. ``numbered`` counts the records of a file, which reads it twice and joins a row per range;
    else ``file_pos`` is the record's first byte, which is in the same order.
    """
    records = load(spark, FastqSource, path, range_bytes)
    if numbered:
        records = _numbered_records(records).withColumn("offset", F.col("record"))
    return records.select("file", F.col("offset").alias("file_pos"), "read_id", "seq", "qual")


def write_fastq(reads: DataFrame, path: str, *by: str) -> None:
    """Compressed FASTQ, a folder per value of ``by``."""
    text = F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    reads.select(*by, text.alias("value")).write.partitionBy(*by).option("compression", "gzip").text(path)


def read_fasta(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(name, seq); sequences may be wrapped. Ranges of files are read side by side, without a shuffle."""
    return load(spark, FastaSource, path, range_bytes).select("name", "seq")


def write_fasta(seqs: DataFrame, path: str, width: int = 60) -> None:
    """Compressed FASTA with sequences wrapped at ``width``."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped).alias("value")).write.option("compression", "gzip").text(path)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(sample, tag, tag_rank) from FASTA or from two columns with or without the header ``id tag``; the rank is the place in the file."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError("empty tag file")
    if first[0].startswith(">"):
        return _numbered_records(load(spark, FastaSource, path)).select(F.col("name").alias("sample"), F.upper("seq").alias("tag"), F.col("record").alias("tag_rank"))
    if len(first[0].split()) != 2:
        raise ValueError("a tag table has two columns")
    f = F.split(F.trim("line"), r"\s+")
    rows = numbered_lines(spark, path).filter("trim(line) <> ''").select(f[0].alias("sample"), F.upper(f[1]).alias("tag"), F.col("line_no").alias("tag_rank"))
    return rows.filter("not (sample = 'id' and tag = 'TAG')")


def read_adapters(spark: SparkSession, path: str) -> DataFrame:
    """(adapter, adp_seq, mate): the mate is the suffix /1 or /2 of the name, else both."""
    a = read_fasta(spark, path)
    mate = F.when(F.endswith(F.col("name"), F.lit("/1")), "1").when(F.endswith(F.col("name"), F.lit("/2")), "2").otherwise("both")
    return a.select(F.col("name").alias("adapter"), F.upper("seq").alias("adp_seq"), mate.alias("mate"))


def read_adapter_table(spark: SparkSession, path: str, paired: bool = True) -> DataFrame:
    """(adapter, adp_seq) of a table of two columns; ``adpR1`` must be there, and ``adpR2`` for pairs."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter("value <> ''")
    ok = F.when(F.size(f) == 2, f).otherwise(F.raise_error(F.concat(F.lit("not two columns: "), "value")).cast("array<string>"))
    got = rows.select(ok.alias("f")).select(F.col("f")[0].alias("adapter"), F.upper(F.col("f")[1]).alias("adp_seq"))
    wanted = {"adpR1", "adpR2"} if paired else {"adpR1"}
    if missing := wanted - {r[0] for r in got.filter(F.col("adapter").isin(*wanted)).select("adapter").distinct().collect()}:
        raise ValueError(f"adapters missing: {sorted(missing)}")
    return got


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(pos, sample, population) of samples to keep: one column, or the sample and then its population."""
    f = F.split(F.trim("line"), r"[ \t]+")
    rows = numbered_lines(spark, path).filter("trim(line) <> '' and not startswith(line, '#')")
    return rows.select(F.col("line_no").alias("pos"), f[0].alias("sample"), F.get(f, F.lit(1)).alias("population"))


def read_exon_counts(spark: SparkSession, path: str) -> DataFrame:
    """(gene, exon_start, exon_end, sample, n): samples are named in the header from the fourth column on."""
    df = spark.read.csv(path, sep="\t", header=True)
    gene, start, end, *samples = df.columns
    return df.select(F.col(f"`{gene}`").alias("gene"), F.col(f"`{start}`").cast("long").alias("exon_start"), F.col(f"`{end}`").cast("long").alias("exon_end"), *[F.col(f"`{c}`").cast("long").alias(c) for c in samples]).unpivot(["gene", "exon_start", "exon_end"], samples, "sample", "n")


def read_typed(spark: SparkSession, path: str, sample_rows: int = 5, sep: str = "\t") -> DataFrame:
    """A table whose column classes are those of its first rows; what does not fit later is an error."""
    df = spark.read.csv(path, sep=sep, header=True, nullValue="NA")
    head = df.limit(sample_rows).collect()

    def kind(c: str) -> str:
        for k, fits in (("long", r"[+-]?\d{1,18}"), ("double", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")):
            if any(r[c] is not None for r in head) and all(r[c] is None or re.fullmatch(fits, r[c].strip()) for r in head):
                return k
        return "string"

    return df.select(*[F.col(f"`{c}`").cast(kind(c)).alias(c) for c in df.columns])


def read_bed(spark: SparkSession, path: str, unique: bool = False) -> DataFrame:
    """(chrom, start, end, name), cut at spaces or tabs; ``unique`` makes a name that occurs twice an error."""
    f = F.split("value", r"[ \t]")
    rows = spark.read.text(path).filter("value <> ''").select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), F.get(f, F.lit(3)).alias("name"))
    return assert_unique(rows, ["name"]) if unique else rows


def write_bed(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "gzip").csv(path, sep="\t")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fixed fields and a map of optional tags."""
    f = F.split("value", "\t")
    tags = F.transform(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substr(x, F.lit(6), F.length(x)).alias("v")))
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    kinds = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    rows = spark.read.text(path).filter("not startswith(value, '@') and value <> ''")
    return rows.select(*[f[k].cast(kinds.get(c, "string")).alias(c) for k, c in enumerate(names)], F.map_from_entries(tags).alias("tags"))


def write_sam(alignments: DataFrame, path: str, header: list[str] = ()) -> None:
    """Alignment lines, tags as in ``read_sam``; the header goes to a file of its own that sorts first."""
    from genolake.session import first_file

    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat(t["key"], F.when(F.rlike(t["value"], F.lit(r"^[+-]?\d+$")), ":i:").otherwise(":Z:"), t["value"])), "\t")
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in names], F.when(F.size("tags") > 0, tags))
    alignments.select(line.alias("value")).write.option("compression", "gzip").text(path)
    if header:
        first_file(alignments.sparkSession, path, list(header))


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated with a header, compressed if the name ends with ``gz``."""
    rows.write.option("compression", "gzip" if path.endswith("gz") else "none").csv(path, sep="\t", header=True, nullValue="NA")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sample manifest: the required columns in any order, others kept; comment rows are left out, other than ASCII is an error."""
    lines = spark.read.text(path)
    if lines.filter(F.rlike("value", F.lit(r"[^\x00-\x7F]"))).limit(1).count():
        raise ValueError("the manifest holds characters other than ASCII")
    df = spark.read.csv(path, sep="\t", header=True, comment="#")
    if missing := [c for c in MANIFEST_COLUMNS if c not in df.columns]:
        raise ValueError(f"columns missing from the manifest: {missing}")
    return df.withColumn("lane", F.col("lane").cast("int"))


def manifest_faults(manifest: DataFrame) -> DataFrame:
    """Rows whose names hold characters that file names are cut at."""
    bad = F.greatest(*[F.coalesce(F.rlike(F.col(c).cast("string"), F.lit(r"[_ .]")), F.lit(False)).cast("int") for c in ("genotype", "flowcell", "lane")]) > 0
    return manifest.filter(bad)


def only_genome(manifest: DataFrame) -> str:
    """The reference genome that all rows share; none or several are an error, as one alignment index is used."""
    found = [r[0] for r in manifest.select("ref_genome").distinct().limit(2).collect()]
    if len(found) != 1 or found[0] is None:
        raise ValueError("a manifest needs one reference genome")
    return found[0]


def of_lanes(manifest: DataFrame, lanes: list[str]) -> DataFrame:
    """Rows of some lanes, named ``<flowcell>_<lane>``."""
    return manifest.filter(F.concat_ws("_", "flowcell", F.col("lane").cast("string")).isin(*lanes))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One column of distinct ids; comment rows are left out."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> '' and not startswith(id, '#')").distinct()


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Two columns, cut at space, tab or comma; another number of columns is an error."""
    f = F.split(F.trim("value"), r"[ \t,]+")
    rows = spark.read.text(path).filter("trim(value) <> '' and not startswith(value, '#')")
    ok = F.when(F.size(f) == 2, f).otherwise(F.raise_error(F.concat(F.lit("not two columns: "), "value")).cast("array<string>"))
    return rows.select(ok.alias("f")).select(F.col("f")[0].alias("key"), F.col("f")[1].alias("value"))


def read_matrix(spark: SparkSession, path: str, row: str = "feature", column: str = "sample", missing: str = "NA", sep: str = "\t") -> DataFrame:
    """(feature, sample, value) of a matrix with names in its first row and column."""
    df = spark.read.csv(path, sep=sep, header=True, nullValue=missing)
    first, rest = df.columns[0], df.columns[1:]
    return df.select(F.col(f"`{first}`").alias(row), *[F.col(f"`{c}`").cast("double").alias(c) for c in rest]).unpivot([row], rest, column, "value")


def read_gct(spark: SparkSession, path: str) -> DataFrame:
    """(feature, sample, value) of a GCT file or folder: two head lines, then names, descriptions and values."""
    lines = numbered_lines(spark, path).filter("line <> ''").withColumn("f", F.split("line", "\t"))
    first = lines.filter("line_no = 0 and startswith(line, '#1.')").select("file").first()
    if first is None:
        raise ValueError("no GCT head line")
    head = lines.filter((F.col("file") == first[0]) & (F.col("line_no") == 2)).select(F.slice("f", F.lit(3), F.size("f")).alias("samples"))
    body = lines.filter((F.col("file") != first[0]) | (F.col("line_no") > 2)).crossJoin(F.broadcast(head))
    cells = body.select(F.col("f")[0].alias("feature"), F.explode(F.arrays_zip("samples", F.slice("f", F.lit(3), F.size("f")).alias("values"))).alias("x"))
    return cells.select("feature", F.col("x.samples").alias("sample"), F.expr("try_cast(x.values AS DOUBLE)").alias("value"))


def write_gct(cells: DataFrame, path: str) -> None:
    """A GCT folder: the two head lines and the names in a first file, then name, description and the samples' values.

    Samples are in the order of their names; a cell that is not there is NA. Compressed as the name says: ``.gct`` or ``.gct.gz``.
    """
    from genolake.session import first_file

    if not path.endswith((".gct", ".gct.gz")):
        raise ValueError("a GCT file is named .gct or .gct.gz")
    names = [r[0] for r in cells.select("sample").distinct().orderBy("sample").limit(MOST_COLUMNS + 1).collect()]
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"a matrix has at most {MOST_COLUMNS} columns")
    values = F.map_from_entries(F.collect_list(F.struct("sample", F.col("value").cast("string").alias("v"))))
    rows = cells.groupBy("feature").agg(values.alias("x"))
    line = F.concat_ws("\t", "feature", "feature", *[F.coalesce(F.try_element_at("x", F.lit(n)), F.lit("NA")) for n in names])
    packed = rows.select(line.alias("value"))
    packed.write.option("compression", "gzip" if path.endswith(".gz") else "none").text(path)
    head = ["#1.2", f"{rows.count()}\t{len(names)}", "\t".join(["Name", "Description", *names])]
    first_file(cells.sparkSession, path, head)


def sequence_dictionary(seqs: DataFrame, species: str) -> DataFrame:
    """Header lines of a sequence dictionary."""
    return seqs.select(F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "name"), F.concat(F.lit("LN:"), F.length("seq")), F.concat(F.lit("SP:"), F.lit(species)), F.concat(F.lit("M5:"), F.md5("seq"))).alias("line"))


READ_SCHEMA = T.StructType([T.StructField("read_id", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType())])
