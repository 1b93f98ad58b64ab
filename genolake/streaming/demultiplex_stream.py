"""Demultiplexing of reads that arrive as files: the same projection over a stream.

The checkpoint of the query takes the place of "skip what is there already": a file is routed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolake.operators.demultiplex import sheet


def routed_stream(reads: DataFrame, tags: DataFrame) -> DataFrame:
    """Each read's sample, by the first tag it starts with; stateless, so no watermark is needed."""
    table = F.array(*[F.struct(F.lit(r["tag"]).alias("tag"), F.lit(r["sample"]).alias("sample")) for r in sheet(tags).orderBy("tag_rank").collect()])
    hit = F.get(F.filter(table, lambda t: F.startswith(F.col("seq"), t["tag"])), F.lit(0))
    return reads.select("read_id", F.coalesce(hit["sample"], F.lit("unassigned")).alias("sample"), F.coalesce(F.substr("seq", F.length(hit["tag"]) + 1), F.col("seq")).alias("clip1"))


def run_stream(spark: SparkSession, source: str, tags: DataFrame, target: str, checkpoint: str, schema: str = "read_id string, seq string"):
    """Route every file of a folder once, then stop."""
    reads = spark.readStream.schema(schema).parquet(source)
    return routed_stream(reads, tags).writeStream.format("parquet").partitionBy("sample").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
