"""Alignments: filters, counters and conversions of SAM-like rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ABSENT = 1_000_000_000


def mapped():
    return F.col("flag").bitwiseAND(4) == 0


def unique():
    """One best hit and no second one; an absent tag fails."""
    return (F.col("xt") == "U") & (F.coalesce("x0", F.lit(ABSENT)) == 1) & (F.coalesce("x1", F.lit(ABSENT)) == 0)


def keep_unique(alignments: DataFrame, edits: int = 1) -> DataFrame:
    return alignments.filter(mapped() & F.coalesce(unique(), F.lit(False)) & (F.coalesce("nm", F.lit(ABSENT)) <= edits))


def filter_counters(alignments: DataFrame, edits: int = 1) -> DataFrame:
    """How many rows pass each filter in turn."""
    uniq, nm = mapped() & F.coalesce(unique(), F.lit(False)), F.coalesce("nm", F.lit(ABSENT))
    return alignments.agg(
        F.count("*").alias("n_reads"),
        F.count_if(mapped()).alias("n_mapped"),
        F.count_if(uniq).alias("n_unique"),
        F.count_if(uniq & (nm == 0)).alias("n_perfect"),
        F.count_if(uniq & (nm > 0) & (nm <= edits)).alias("n_almost"),
        F.count_if(uniq & (nm <= edits)).alias("n_saved"),
    )


def to_bed(alignments: DataFrame) -> DataFrame:
    """0-based, half-open intervals."""
    strand = F.when(F.col("flag") == 0, "+").when(F.col("flag") == 16, "-").otherwise("")
    return alignments.select(F.col("rname").alias("chrom"), (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.col("seq_len")).alias("end"), F.col("qname").alias("name"), F.lit(1000).alias("score"), strand.alias("strand"))


def counted_names(alignments: DataFrame, paired: bool, least_mapq: int = 5) -> DataFrame:
    """Distinct names of well-placed primary alignments per lane."""
    flag, primary = F.col("flag"), F.col("flag").bitwiseAND(256) == 0
    ok = (flag.bitwiseAND(2) != 0) & primary if paired else mapped() & primary & (flag.bitwiseAND(2048) == 0)
    return alignments.filter(ok & (F.col("mapq") >= least_mapq)).groupBy("lane").agg(F.count_distinct("qname").alias("n_names"))


def flag_counts(alignments: DataFrame) -> DataFrame:
    flag = F.col("flag")
    return alignments.groupBy("lane").agg(
        F.count("*").alias("n_total"),
        F.count_if(mapped()).alias("n_mapped"),
        F.count_if(flag.bitwiseAND(2) != 0).alias("n_proper"),
        F.count_if(flag.bitwiseAND(256) != 0).alias("n_secondary"),
        F.count_if(flag.bitwiseAND(16) != 0).alias("n_reverse"),
    )


def insert_sizes(alignments: DataFrame) -> DataFrame:
    """Histogram of template lengths per lane."""
    return alignments.filter("tlen > 0").groupBy("lane", F.col("tlen").alias("insert_size")).agg(F.count("*").alias("n"))


def insert_medians(alignments: DataFrame) -> DataFrame:
    return alignments.filter("tlen > 0").groupBy("lane").agg(F.percentile("tlen", 0.5).alias("median_insert"))


def one_based(bed: DataFrame, starts_only: bool = False) -> DataFrame:
    """BED rows with starts that count from 1; ``starts_only`` sets each end to its start."""
    out = bed.withColumn("start", F.col("start") + 1)
    return out.withColumn("end", F.col("start")) if starts_only else out
