"""Wide genotype text formats to and from long tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolake.operators.genotypes import call_probabilities, chromosome_code


#: Longest name that the format holds.
LONGEST_NAME = 39


def _head(spark: SparkSession, path: str, sep: str = r"\s+") -> list[str]:
    return re.split(sep, spark.read.text(path).first()[0].strip())


def read_hapmap(spark: SparkSession, path: str, inds: list[str] | None = None) -> DataFrame:
    """(snp, chrom, pos, a1, a2, ind, call): calls stand from the 12th column on; the line that begins with rs# names the samples."""
    head = spark.read.text(path).filter("startswith(value, 'rs#')").first()
    if head is None:
        raise ValueError("no line of names")
    names = head[0].split()[11:]
    f = F.split("value", r"\s+")
    rows = spark.read.text(path).filter(F.col("value") != "").filter(f[0] != "rs#")
    calls = F.arrays_zip(F.array(*map(F.lit, names)).alias("ind"), F.slice(f, 12, len(names)).alias("call"))
    out = rows.select(f[0].alias("snp"), f[2].alias("chrom"), f[3].cast("long").alias("pos"), F.split(f[1], "/").alias("a"), F.explode(calls).alias("x"))
    out = out.select("snp", "chrom", "pos", F.col("a")[0].alias("a1"), F.col("a")[1].alias("a2"), "x.ind", "x.call")
    return out.filter(F.col("ind").isin(inds)) if inds is not None else out


def chromosome_paths(template: str, chromosomes: str = "-".join(map(str, range(1, 23)))) -> list[str]:
    """Paths of a template whose CHR stands for chr1, chr2, ...; chromosomes as ``1-17-3``.

    >>> chromosome_paths("x_CHR.gz", "1-17")
    ['x_chr1.gz', 'x_chr17.gz']
    """
    return [template.replace("CHR", f"chr{c}") for c in chromosomes.split("-")]


def read_hapmap_chromosomes(spark: SparkSession, template: str, chromosomes: str | None = None, inds: list[str] | None = None) -> DataFrame:
    """The files of some chromosomes (1 to 22), one under another; each names its own samples."""
    paths = chromosome_paths(template, chromosomes) if chromosomes else chromosome_paths(template)
    parts = [read_hapmap(spark, p, inds) for p in paths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_tped(spark: SparkSession, tped: str, tfam: str) -> DataFrame:
    """(snp, chrom, pos, ind, call): two allele columns a sample, samples in the order of the family file."""
    inds = [r["value"].split()[1] for r in spark.read.text(tfam).collect() if r["value"].strip()]
    f = F.split(F.trim("value"), r"\s+")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(len(inds) - 1)), lambda i: F.struct(F.get(F.array(*map(F.lit, inds)), i).alias("ind"), F.concat(F.get(f, 2 * i + 4), F.get(f, 2 * i + 5)).alias("call")))
    return spark.read.text(tped).filter("trim(value) <> ''").select(f[1].alias("snp"), f[0].alias("chrom"), f[3].cast("long").alias("pos"), F.explode(pairs).alias("x")).select("snp", "chrom", "pos", "x.ind", "x.call")


def with_alleles(calls: DataFrame) -> DataFrame:
    """Adds the two alleles of each marker, in alphabetical order; another number of alleles is an error."""
    from genolake.operators.genotypes import allele_sets

    sets = allele_sets(calls)
    ok = F.when(F.length("alleles") == 2, F.col("alleles")).otherwise(F.raise_error(F.concat(F.lit("not two alleles: "), "snp")).cast("string"))
    return calls.join(sets.select("snp", ok.alias("alleles")), "snp").select(*calls.columns, F.substring("alleles", 1, 1).alias("a1"), F.substring("alleles", 2, 1).alias("a2"))


def to_probabilities(calls: DataFrame) -> DataFrame:
    return calls.select("snp", "chrom", "pos", "a1", "a2", "ind", *[c.alias(k) for k, c in call_probabilities(F.col("call"), F.col("a1"), F.col("a2")).items()])


def impute_lines(probs: DataFrame) -> DataFrame:
    """IMPUTE lines: marker columns, then three numbers a sample, samples in order of their names."""
    cell = F.struct("ind", F.concat_ws(" ", "p_aa", "p_ab", "p_bb").alias("p"))
    rows = probs.groupBy("chrom", "snp", "pos", "a1", "a2").agg(F.sort_array(F.collect_list(cell)).alias("x"))
    return rows.select("chrom", "pos", F.concat_ws(" ", "chrom", "snp", "pos", "a1", "a2", F.array_join(F.transform("x", lambda y: y["p"]), " ")).alias("value"))


def read_impute(spark: SparkSession, path: str, inds: list[str] | None = None) -> DataFrame:
    """(chrom, snp, pos, a1, a2, ind, p_aa, p_ab, p_bb), each line cut at spaces or tabs as it is.

    Without ``inds`` the first line is a header that names each sample three times, with the endings of the three genotypes.
    """
    f = F.split("value", r"[ \t]")
    rows = spark.read.text(path).filter("value <> ''")
    if inds is None:
        head = _head(spark, path, r"[ \t]")
        inds = [re.sub(r"_a1a1$", "", x) for x in head[5::3]]
        rows = rows.filter(F.col("value") != F.lit(rows.first()[0]))
    cells = F.transform(F.sequence(F.lit(0), F.lit(len(inds) - 1)), lambda i: F.struct(F.get(F.array(*map(F.lit, inds)), i).alias("ind"), *[F.get(f, 3 * i + 5 + k).cast("double").alias(c) for k, c in enumerate(("p_aa", "p_ab", "p_bb"))]))
    return rows.select(f[0].alias("chrom"), f[1].alias("snp"), f[2].cast("long").alias("pos"), f[3].alias("a1"), f[4].alias("a2"), F.explode(cells).alias("x")).select("chrom", "snp", "pos", "a1", "a2", "x.*")


def impute_header(inds: list[str]) -> str:
    return " ".join(["chr", "name", "coord", "a1", "a2", *[f"{i}_{g}" for i in inds for g in ("a1a1", "a1a2", "a2a2")]])


def eigenstrat_individuals(probs: DataFrame, population: str = "NA") -> DataFrame:
    """Lines of the individuals' file, in the order of the genotype digits: name, unknown sex, population."""
    name = F.col("ind").cast("string")
    short = F.when(F.length(name) <= LONGEST_NAME, name).otherwise(F.raise_error(F.concat(F.lit("name over 39 characters: "), name)).cast("string"))
    return probs.select(short.alias("ind")).distinct().select("ind", F.concat_ws("\t", "ind", F.lit("U"), F.lit(population)).alias("value"))


def eigenstrat(probs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genotype lines (a digit a sample, 9 when uncertain) and marker lines."""
    code = F.when(F.col("p_aa") == 1, "2").when(F.col("p_ab") == 1, "1").when(F.col("p_bb") == 1, "0").otherwise("9")
    rows = probs.groupBy("chrom", "snp", "pos", "a1", "a2").agg(F.sort_array(F.collect_list(F.struct("ind", code.alias("c")))).alias("x"))
    geno = rows.select("chrom", "pos", "snp", F.array_join(F.transform("x", lambda y: y["c"]), "").alias("value"))
    snp = rows.select("chrom", "pos", "snp", F.concat_ws("\t", "snp", chromosome_code(F.col("chrom")), F.lit("0.0"), "pos", "a1", "a2").alias("value"))
    return geno, snp


def bimbam(probs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean genotype lines and annotation lines."""
    dose = 2 * F.col("p_aa") + F.col("p_ab")
    rows = probs.groupBy("chrom", "snp", "pos", "a1", "a2").agg(F.sort_array(F.collect_list(F.struct("ind", dose.cast("double").cast("string").alias("d")))).alias("x"))
    return rows.select("chrom", "pos", F.concat_ws(" ", "snp", "a1", "a2", F.array_join(F.transform("x", lambda y: y["d"]), " ")).alias("value")), rows.select("chrom", "pos", F.concat_ws(" ", "snp", "pos", "chrom").alias("value"))


def write_lines(lines: DataFrame, path: str, *by: str) -> None:
    """Lines in genomic order, within each value of ``by``."""
    keep = [*by, "value"]
    ordered = lines.orderBy("chrom", "pos")
    w = ordered.select(*keep).write.option("compression", "gzip")
    (w.partitionBy(*by) if by else w).text(path)
