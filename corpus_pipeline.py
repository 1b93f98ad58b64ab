"""The corpus pipeline: quality rules, exact and near dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
documents of the next, and removed once the stage behind it is written. All but the last return the columns of the documents.

In every stage a long text is read whole, further columns (whatever their names) are kept by all but the last stage and never looked at, and an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genolake.llm import exact_dedup, minhash_join, packing, quality_rules, suffix_dedup
from genolake.session import drop, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule. Null, empty and very short texts fail; repeated rows are judged one by one."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id; of a row that occurs twice, one. Null counts as empty."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8): that with the smallest id, null being the largest.

    Rows without a word all stay.
    """
    return minhash_join.keep_one(docs, percent=80, shingle=5)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier, by id and then by place; every row stays, and a null text stays null."""
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences; a null or empty text is its end mark alone."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("minhash_near_dedup", near), ("suffix_array_dedup", substrings), ("best_fit_packing", pack)]

#: Near-duplicate groups, suffix arrays and token ids are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives no piece. Tables between stages are in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "stages")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if before:
                drop(spark, before)
            before = f"{folder}/{k}-{name}"
    return docs
