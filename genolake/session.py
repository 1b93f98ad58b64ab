"""Session defaults and small helpers that every other module may use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: Narrow rows (ids and numbers) that fill a task.
ROWS_A_TASK = 200_000


def build_session(app: str = "genolake", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings that the operators assume (UTC, adaptive execution)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where their path does not hold it yet."""
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in paths or os.path.realpath(os.getcwd()) == str(ROOT):
        return
    sc = spark.sparkContext
    if getattr(sc, "_genolake_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "genolake_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (ROOT / "genolake").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._genolake_shipped = True


def partitions(spark: SparkSession) -> int:
    """The cluster's own measure of how finely shuffled data are dealt."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of the checkpoints, which all executors reach (spark.checkpoint.dir).

    Where the session has none, a temporary folder serves local tests, and a cluster raises an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def filled(df: DataFrame, rows: int) -> DataFrame:
    """A table of ``rows`` narrow rows at most, in no more partitions than these fill, but one for each core at least.

    A shuffle deals it to all shuffle partitions, and each would be a task and a file of its own.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage in the shared folder. ``rows`` is for tables that ``filled`` is for."""
    shared_folder(df.sparkSession)
    return (df if rows is None else filled(df, rows)).checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}/{name}"


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``scratch`` named, once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def first_file(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Add a small file of head lines to a folder of text files, under a name that sorts before theirs."""
    from pyspark.sql import functions as F

    head = f"{path.rstrip('/')}-head-{uuid.uuid4().hex}"
    one = spark.range(1).select(F.lit("\n".join(lines)).alias("value")).coalesce(1)
    one.write.option("compression", "gzip" if path.endswith("gz") else "none").text(head)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(hadoop(head)) if f.getPath().getName().startswith("part-"))
    fs.rename(part, hadoop(f"{path.rstrip('/')}/head{''.join(part.getName().partition('.')[1:])}"))
    fs.delete(hadoop(head), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
