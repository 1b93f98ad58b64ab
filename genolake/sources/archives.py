"""Archives of quality reports, single files by pattern, and results kept from earlier runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_report_archives(spark: SparkSession, path: str, member: str = "fastqc_data.txt") -> DataFrame:
    """(dataset, text, fault) of the report in each zip file; ``fault`` tells why an archive could not be read."""

    def run(batches: Iterator) -> Iterator:
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                dataset = name.rsplit("/", 1)[-1].removesuffix(".zip").removesuffix("_fastqc")
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        found = next(n for n in z.namelist() if n.rsplit("/", 1)[-1] == member)
                        rows.append((dataset, z.read(found).decode("utf-8", "replace"), None))
                except (zipfile.BadZipFile, StopIteration) as e:
                    rows.append((dataset, None, type(e).__name__))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["dataset", "text", "fault"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(run, "dataset string, text string, fault string")


def one_file(spark: SparkSession, pattern: str) -> str:
    """The only file of a pattern; none or several are an error."""
    found = [r[0] for r in spark.read.format("binaryFile").load(pattern).select("path").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'no file' if not found else 'several files'} for {pattern}")
    return found[0]


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What an earlier run wrote there, or else the result of ``make``, written now."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)


def missing_chunks(chunks: DataFrame, done: DataFrame, *on: str) -> DataFrame:
    """Chunks whose result is not there yet."""
    return chunks.join(done.select(*on), list(on), "left_anti").orderBy(*[F.col(c) for c in on])
