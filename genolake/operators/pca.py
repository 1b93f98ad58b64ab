"""Leading principal components of many samples, by block subspace iteration on Spark.

No matrix of samples by samples exists. A block of ``k`` vectors over the samples is multiplied by the data and by its transpose, as two joins and
sums per round, and made orthonormal by a tree QR: each task factors its rows, the small triangles are stacked and factored again, eight at a time, until one
is left, and every task divides its rows by it. What comes to the driver are matrices of k x k.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.functions.distributions import tracy_widom_upper
from genolake.session import checkpoint, partitions

FAN_IN = 8


def scaled(values: DataFrame) -> DataFrame:
    """(gene, ind, z): each sample's values, centred and scaled over its genes; 0 for a sample without variation."""
    s = values.filter("v is not null").groupBy("ind").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return values.filter("v is not null").join(s, "ind").select("gene", "ind", F.coalesce(F.try_divide(F.col("v") - F.col("m"), F.col("s")), F.lit(0.0)).alias("z"))


def _times(cells: DataFrame, vectors: DataFrame, on: str, to: str, k: int) -> DataFrame:
    """(to, x): sums over ``on`` of z times the vectors' rows."""
    sums = [F.sum(F.col("z") * F.col("x")[j]).alias(f"_{j}") for j in range(k)]
    return cells.join(vectors, on).groupBy(to).agg(*sums).select(to, F.array(*[f"_{j}" for j in range(k)]).alias("x"))


def _rows(batches: Iterator, column: str, k: int) -> Iterator:
    import numpy as np

    for batch in batches:
        lists = batch.column(column)
        bounds = lists.offsets.to_numpy()
        yield batch, np.asarray(lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], dtype=float).reshape(batch.num_rows, k)


def tree_triangle(vectors: DataFrame, k: int):
    """The triangle R of the QR factorisation of all rows ``x``."""
    import numpy as np

    def factor(batches: Iterator) -> Iterator:
        import pyarrow as pa

        r = np.zeros((0, k))
        for _, x in _rows(batches, "x", k):
            r = np.linalg.qr(np.concatenate([r, x]), mode="r")
        from pyspark import TaskContext

        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])

    def stack(key, table):
        import pyarrow as pa

        r = np.linalg.qr(np.concatenate([np.frombuffer(b).reshape(-1, k) for b in table.column("r").to_pylist()]), mode="r")
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    level = vectors.select("x").mapInArrow(factor, "node long, r binary")
    nodes = partitions(vectors.sparkSession)
    while nodes > 1:
        level = level.select(F.floor(F.col("node") / FAN_IN).alias("node"), "r").groupBy("node").applyInArrow(stack, "node long, r binary")
        nodes = -(-nodes // FAN_IN)
    r = np.concatenate([np.frombuffer(bytes(x["r"])).reshape(-1, k) for x in level.collect()])  # one triangle, k x k at most
    return np.linalg.qr(np.concatenate([r, np.zeros((k, k))]), mode="r")


def _rotated(vectors: DataFrame, key: str, matrix, k: int) -> DataFrame:
    """The rows times a small matrix."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch, x in _rows(batches, "x", k):
            y = x @ matrix
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))], names=[key, "x"])

    return vectors.select(key, "x").mapInArrow(run, f"{key} {kind}, x array<double>")


def _orthonormal(vectors: DataFrame, key: str, k: int) -> DataFrame:
    """Columns made orthonormal; twice, since division by a triangle alone loses digits. Directions without length are set to zero."""
    import numpy as np

    for _ in range(2):
        r = tree_triangle(vectors, k)
        u, s, vt = np.linalg.svd(r)
        keep = s > 1e-12 * max(s[0], 1e-300)
        vectors = checkpoint(_rotated(vectors, key, vt.T @ np.diag(np.where(keep, 1 / np.where(keep, s, 1), 0)), k))
    return vectors


def _squares(vectors: DataFrame, k: int):
    """Sum of the rows' outer products."""
    r = tree_triangle(vectors, k)
    return r.T @ r


def leading_components(values: DataFrame, k: int = 10, extra: int = 8, most_rounds: int = 60, tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """((ind, pc, loading), (pc, variance, share, cumulative, statistic, p)) of the first ``k`` components of the samples.

    values: (gene, ind, v). Samples are centred and scaled; a missing value counts as its sample's mean. Loadings are unit vectors over the samples, with their largest
    entry positive. Rounds end when the variances change by less than ``tolerance`` of the first. ``p`` is the Tracy-Widom test of each component
    among those that are left, whose mean variance is taken as the noise.
    """
    import math

    import numpy as np

    cells = checkpoint(scaled(values))
    counts = cells.agg(F.count_distinct("gene").alias("genes"), F.count_distinct("ind").alias("inds"), F.sum(F.col("z") * F.col("z")).alias("zz")).first()
    genes, inds = counts["genes"], counts["inds"]
    spark = values.sparkSession
    kind = values.schema["ind"].dataType.simpleString()
    empty = (spark.createDataFrame([], f"ind {kind}, pc int, loading double"), spark.createDataFrame([], "pc int, variance double, share double, cumulative double, statistic double, p double"))
    if genes < 2 or not counts["zz"]:
        return empty
    wide = min(k + extra, inds)
    start = F.array(*[F.pmod(F.xxhash64("ind", F.lit(j)), F.lit(1_000_003)) / 1_000_003 - 0.5 for j in range(wide)])
    parts = partitions(spark)
    v = _orthonormal(checkpoint(cells.select("ind").distinct().select("ind", start.alias("x")).repartition(parts)), "ind", wide)
    before = None
    for _ in range(most_rounds):
        b = checkpoint(_times(cells, v, "ind", "gene", wide))
        found, turn = np.linalg.eigh(_squares(b, wide) / (genes - 1))
        found, turn = found[::-1], turn[:, ::-1]
        if before is not None and np.abs(found[:k] - before[:k]).max() <= tolerance * found[0]:
            break
        before = found
        v = _orthonormal(checkpoint(_times(cells, b, "gene", "ind", wide).repartition(parts)), "ind", wide)
    v = checkpoint(_rotated(v, "ind", turn, wide))
    k = min(k, wide)
    long = v.select("ind", F.posexplode(F.slice("x", 1, k)).alias("at", "loading")).select("ind", (F.col("at") + 1).alias("pc"), "loading")
    signs = long.groupBy("pc").agg(F.signum(F.max_by("loading", F.struct(F.abs("loading"), "loading"))).alias("sign"))
    loadings = long.join(F.broadcast(signs), "pc").select("ind", "pc", (F.col("loading") * F.col("sign")).alias("loading"))
    total = counts["zz"] / (genes - 1)
    rows, cumulative = [], 0.0
    for j in range(k):
        variance = max(0.0, float(found[j]))
        rest, p = max(1e-300, (total - cumulative)) / (inds - j), inds - j
        centre = (math.sqrt(genes - 1) + math.sqrt(p)) ** 2
        width = (math.sqrt(genes - 1) + math.sqrt(p)) * (1 / math.sqrt(genes - 1) + 1 / math.sqrt(p)) ** (1 / 3)
        statistic = ((genes - 1) * variance / rest - centre) / width
        cumulative += variance
        rows.append((j + 1, variance, variance / total, cumulative / total, statistic, tracy_widom_upper(statistic)))
    return loadings, spark.createDataFrame(rows, "pc int, variance double, share double, cumulative double, statistic double, p double")


def significant(components: DataFrame, level: float = 0.05) -> int:
    """How many components come before the first whose Tracy-Widom test is above ``level``."""
    rows = components.orderBy("pc").collect()  # k rows
    return next((r["pc"] - 1 for r in rows if r["p"] > level), len(rows))
