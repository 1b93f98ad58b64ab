"""Variant sites and genotypes: filters by annotation, call rate and pedigree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name, annotation, side and bound; a missing annotation raises no flag.
SITE_RULES = (
    ("highDP", "dp", "above", 100000),
    ("lowQD", "qd", "below", 2.0),
    ("highFS", "fs", "above", 60.0),
    ("lowMQ", "mq", "below", 40.0),
    ("lowMQRankSum", "mqranksum", "below", -12.5),
    ("lowReadPosRankSum", "readposranksum", "below", -8.0),
    ("highHaplotypeScore", "haplotypescore", "above", 13.0),
    ("highSOR", "sor", "above", 4.0),
)


def site_flags(sites: DataFrame, rules=SITE_RULES) -> DataFrame:
    fails = [F.when(F.col(c) > bound if side == "above" else F.col(c) < bound, name) for name, c, side, bound in rules]
    return sites.withColumn("flags", F.concat_ws(";", F.array_compact(F.array(*fails))))


def passing(sites: DataFrame) -> DataFrame:
    return site_flags(sites).filter("flags = ''")


def mask_genotypes(genotypes: DataFrame, least_depth: int = 10, least_quality: int = 20) -> DataFrame:
    """Uncertain genotypes become no-calls."""
    return genotypes.withColumn("gt", F.when((F.col("dp") >= least_depth) & (F.col("gq") >= least_quality) & (F.col("gt") < 3), F.col("gt")))


def call_rates(genotypes: DataFrame) -> DataFrame:
    return genotypes.groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.col("gt").isNull()).alias("n_missing"))


def well_called(genotypes: DataFrame, most_missing: float | None = 0.5, most: int | None = None) -> DataFrame:
    """Sites with at most this share, or this number, of genotypes that are filtered or not called."""
    rate = call_rates(genotypes)
    if most_missing is not None:
        rate = rate.filter(F.col("n_missing") <= most_missing * F.col("n"))
    if most is not None:
        rate = rate.filter(F.col("n_missing") <= most)
    return genotypes.join(rate.select("site"), "site", "left_semi")


def allelicity(genotypes: DataFrame) -> DataFrame:
    """How many alleles the called genotypes of a site show."""
    called = genotypes.filter("gt is not null").groupBy("site").agg(F.min("gt").alias("low"), F.max("gt").alias("high"))
    return called.select("site", F.when((F.col("low") == F.col("high")) & F.col("low").isin(0, 2), 1).otherwise(2).alias("n_alleles"))


def mendelian_violations(genotypes: DataFrame, trios: DataFrame, least_quality: int = 0) -> DataFrame:
    """Trios whose child has a genotype that its parents' doses cannot give."""
    g = genotypes.filter((F.col("gt").isNotNull()) & (F.col("gq") >= least_quality) & (F.col("gt") < 3)).select("site", "ind", "gt")
    as_ = lambda who: g.select("site", F.col("ind").alias(who), F.col("gt").alias(f"{who}_gt"))
    t = trios.join(as_("child"), "child").join(as_("mother"), ["site", "mother"]).join(as_("father"), ["site", "father"])
    least = F.floor(F.col("mother_gt") / 2) + F.floor(F.col("father_gt") / 2)
    most = F.ceil(F.col("mother_gt") / 2) + F.ceil(F.col("father_gt") / 2)
    return t.filter((F.col("child_gt") < least) | (F.col("child_gt") > most)).select("site", "child", "mother", "father", "child_gt", "mother_gt", "father_gt")
