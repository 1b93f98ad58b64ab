"""Embedding whitening by a weighted covariance of distinct vectors.

Entries become whole numbers, ``floor(scale * c) + shift``, so equal vectors are equal exactly. Identical vectors are grouped, and
each distinct one is kept once with its number of rows. The fit weighs it by that number (``weights="counts"``, the fit list is all
rows) or by one (``"one"``, the fit list is the distinct vectors). Sums are exact; the covariance is a weighted product of centred blocks of vectors, one
partial matrix a task, added up in stripes of rows. Its eigenvectors are taken in the driver, which sees dimension x dimension
numbers. Each distinct vector is whitened once, and the result is joined back to the rows.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are dropped. Vectors of different lengths are different spaces, each
with a fit of its own (n counts the vectors of that length); an empty vector counts but has no component. Repeated rows and ids, and null
ids, are rows like others. Components are numbered by falling eigenvalue, with the largest entry positive. A
component without variance (an eigenvalue of at most length * 2**-52 of the trace) cannot be whitened: ``whitened`` is null there, and ``identity_error`` leaves it
out (null if none is left); ``explained`` is null without any variance. A deviation beyond a long is null. Empty tables give
empty results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.operators.skew import hand_back
from genolake.session import partitions, scratch

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Longest vector, and entries of all matrices together, that the driver takes (512 MB).
LONGEST = 4096
MOST_ENTRIES = 1 << 26
#: Numbers of a matrix that travel in one row.
STRIPE = 1 << 16
WEIGHTS = ("counts", "one")


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    """The rows that count, with entries as doubles."""
    c = F.col(vector).cast("array<double>")
    return df.filter(c.isNotNull() & F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))


def _whole(flat, scale: int, shift: int):
    import numpy as np

    return np.clip(np.floor(scale * flat), -(2.0**61), 2.0**61).astype(np.int64) + shift


def _packed(x) -> bytes:
    """The narrowest form that holds the numbers: entries of 2, 4 or 8 bytes around the shift."""
    import numpy as np

    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    for kind, bits in (("<i2", 15), ("<i4", 31)):
        if -(1 << bits) <= low and high < 1 << bits:
            return x.astype(kind).tobytes()
    return x.astype(np.int64).tobytes()


def _unpacked(column, dim: int):
    """The packed vectors of an Arrow column, all of one length, as rows of a matrix."""
    import numpy as np

    out = np.empty((len(column), dim), np.int64)
    for i, raw in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(raw, f"<i{len(raw) // dim}")
    return out


def keyed(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """row id, dim, key and packed vector (without the shift) per row that counts. Equal keys are equal vectors, by a digest of 160 bits."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy()
            flat = _whole(lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]] if len(bounds) else np.zeros(0), scale, 0)
            raw = [_packed(flat[a - bounds[0] : b - bounds[0]]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            dims = np.diff(bounds).astype(np.int32)
            keys = [hashlib.blake2b(x, digest_size=20, salt=int(d).to_bytes(4, "little")).digest() for x, d in zip(raw, dims, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=[row_id, "dim", "key", "x"])

    chosen = _vectors(df, vector).select(F.col(row_id).cast("long").alias(row_id), F.col(vector).cast("array<double>").alias("v"))
    return chosen.mapInArrow(run, f"`{row_id}` long, dim int, key binary, x binary")


def _by_dim(batch, most: int = 1 << 21):
    """(dim, slice of the batch) with one length each and a bounded number of entries."""
    import numpy as np

    dims = batch.column("dim").to_numpy()
    at = 0
    while at < len(dims):
        other = np.flatnonzero(dims[at:] != dims[at])
        to = min(at + (int(other[0]) if len(other) else len(dims) - at), at + max(1, most // max(1, int(dims[at]))))
        yield int(dims[at]), batch.slice(at, to - at)
        at = to


def _weights(part, weights: str):
    import numpy as np

    return part.column("rows").to_numpy() if weights == "counts" else np.ones(part.num_rows, np.int64)


def _sums(distinct: DataFrame, weights: str) -> dict:
    """For each length: number of vectors of the fit list and exact sums per dimension (shift left out)."""

    def run(batches: Iterator) -> Iterator:
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        found: dict[int, list] = {}
        for batch in batches:
            for dim, part in _by_dim(batch):
                w = _weights(part, weights)
                x = _unpacked(part.column("x"), dim) if dim else np.zeros((part.num_rows, 0), np.int64)
                if dim and int(w.sum()) * int(np.abs(x).max()) < 1 << 62:
                    sums = (w @ x).tolist()
                else:
                    sums = [sum(int(a) * b for a, b in zip(w, col, strict=True)) for col in x.T.tolist()]
                held = found.setdefault(dim, [0, [0] * dim])
                held[0] += int(w.sum())
                held[1] = [a + b for a, b in zip(held[1], sums, strict=True)]
        for dim, (n, sums) in found.items():
            at, values = [-1, *range(dim)], [Decimal(n), *map(Decimal, sums)]
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["dim", "at", "total"])

    lengths = distinct.select("dim").distinct().limit(LONGEST + 2).toPandas()["dim"].tolist()
    if lengths and (max(lengths) > LONGEST or sum(d * d for d in lengths) > MOST_ENTRIES):
        raise ValueError(f"vectors may have at most {LONGEST} entries, and the covariances of all lengths {MOST_ENTRIES} together")
    out = {d: [0, [0] * d] for d in lengths}
    summed = distinct.mapInArrow(run, "dim int, at int, total decimal(38,0)").groupBy("dim", "at").agg(F.sum("total").cast("string").alias("total"))
    for r in _few(summed, sum(d + 1 for d in lengths) / STRIPE).toLocalIterator():
        if r["at"] < 0:
            out[r["dim"]][0] = int(r["total"])
        else:
            out[r["dim"]][1][r["at"]] = int(r["total"])
    return {d: (n, sums) for d, (n, sums) in out.items()}


def _few(df: DataFrame, most: float) -> DataFrame:
    """The table in ``most`` partitions, rounded up, where a shuffle dealt it more: the driver's iterator runs a job for each, empty or not."""
    return df.coalesce(max(1, min(math.ceil(most), partitions(df.sparkSession))))


def _added(partials: DataFrame, stripes: int) -> DataFrame:
    """Rows (dim, stripe, values) of equal dim and stripe added up; ``stripes`` is how many there are, so no more tasks have work."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def row(key, total):
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["dim", "stripe", "part"])

        key, total = None, None
        for batch in batches:
            for dim, stripe, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (dim, stripe) != key:
                    if key is not None:
                        yield row(key, total)
                    key, total = (dim, stripe), np.zeros(len(raw) // 8)
                total += np.frombuffer(raw)
        if key is not None:
            yield row(key, total)

    dealt = _few(partials.repartition(partitions(partials.sparkSession), "dim", "stripe"), stripes)
    return dealt.sortWithinPartitions("dim", "stripe").mapInArrow(run, partials.schema)


def _products(table: DataFrame, centred, weights: str, sides: list[int]) -> dict:
    """For each length the sum of w * (y - centre)(y - centre)' as a matrix, where ``centred(dim, part)`` gives the centred vectors y.

    ``sides`` has the matrices' sides, or what they are at most.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        found: dict = {}
        for batch in batches:
            for dim, part in _by_dim(batch):
                y = centred(dim, part)
                if y is None or not y.shape[1]:
                    continue
                total = (y * _weights(part, weights)[:, None]).T @ y
                found[dim] = found[dim] + total if dim in found else total
        for dim, total in found.items():
            flat = total.ravel()
            for k in range(0, len(flat), STRIPE):
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([k // STRIPE], pa.int32()), pa.array([flat[k : k + STRIPE].astype(np.float64).tobytes()], pa.binary())], names=["dim", "stripe", "part"])

    import numpy as np

    stripes: dict = {}
    for r in _added(table.mapInArrow(run, "dim int, stripe int, part binary"), sum(math.ceil(d * d / STRIPE) for d in sides)).toLocalIterator():
        stripes.setdefault(r["dim"], {})[r["stripe"]] = np.frombuffer(bytes(r["part"]))
    out = {}
    for dim, held in stripes.items():
        flat = np.concatenate([held[k] for k in sorted(held)])
        out[dim] = flat.reshape(round(len(flat) ** 0.5), -1)
    return out


def _axes(cov):
    """(eigenvalues, vectors as columns), falling, the largest entry of each vector positive."""
    import numpy as np

    e, u = np.linalg.eigh((cov + cov.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    top = u[np.abs(u).argmax(axis=0), np.arange(len(e))]
    return e, u * np.where(top < 0, -1.0, 1.0)


def _deviations(x, n: int, sums: list[int]) -> list:
    """Exact sums of (n * x - S)**2, None beyond a long."""
    import numpy as np

    top = int(np.abs(x).max()) if x.size else 0
    far = n * top + max(map(abs, sums), default=0)
    if far * far * max(1, x.shape[1]) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def whiten(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", weights: str = "counts", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """row id, component, n, deviation, whitened, explained, identity_error: a row per vector that counts and component."""
    import numpy as np

    if weights not in WEIGHTS:
        raise ValueError(f"weights must be one of {WEIGHTS}")
    spark = df.sparkSession
    rows = keyed(df, vector, row_id, scale)
    path = scratch(spark, "whitening")
    rows.groupBy("dim", "key").agg(F.first("x").alias("x"), F.count("*").alias("rows")).write.option("compression", "zstd").parquet(f"{path}/distinct")
    distinct = spark.read.parquet(f"{path}/distinct")

    fits = _sums(distinct, weights)
    # Exact means do not depend on the shift: n * (x + shift) - (S + n * shift) = n * x - S.
    means = {d: np.array([s / n for s in sums]) for d, (n, sums) in fits.items()}
    covs = _products(distinct, lambda dim, part: _unpacked(part.column("x"), dim) - means[dim] if dim else None, weights, list(fits))
    axes, tell = {}, {}
    for dim, total in covs.items():
        cov = total / fits[dim][0]
        e, u = _axes(cov)
        trace, k = float(np.trace(cov)), min(components, dim)
        sound = e[:k] > trace * dim * 2.0**-52
        axes[dim] = u[:, :k] / np.where(sound, np.sqrt(np.where(sound, e[:k], 1.0)), np.nan)
        tell[dim] = [(float(x) / trace if trace > 0 else None) for x in e[:k]]
    sent = spark.sparkContext.broadcast((fits, means, axes))  # at most MOST_ENTRIES numbers

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fits, means, axes = sent.value
        for batch in batches:
            for dim, part in _by_dim(batch):
                if dim not in axes:
                    continue
                x = _unpacked(part.column("x"), dim)
                z = (x - means[dim]) @ axes[dim]
                values = pa.array(z.ravel(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), values)
                columns = [part.column("dim"), part.column("key"), part.column("rows"), pa.array(_deviations(x, *fits[dim]), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "key", "rows", "deviation", "z"])

    distinct.mapInArrow(project, "dim int, key binary, rows long, deviation long, z array<double>").write.option("compression", "zstd").parquet(f"{path}/whitened")
    white = spark.read.parquet(f"{path}/whitened")
    errors = _identity_errors(white, fits, weights, components)

    fit = [(d, c + 1, fits[d][0], tell[d][c], errors.get(d)) for d in axes for c in range(axes[d].shape[1])]
    facts = spark.createDataFrame(fit, "dim int, component int, n long, explained double, identity_error double")  # a few rows per length
    placed = hand_back(rows.select(row_id, "key"), white, "key", "rows")
    long = placed.select(row_id, "dim", "deviation", F.posexplode("z").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return long.join(F.broadcast(facts), ["dim", "component"]).select(row_id, "component", "n", "deviation", "whitened", "explained", "identity_error")


def _identity_errors(white: DataFrame, fits: dict, weights: str, components: int) -> dict:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, per length."""
    import numpy as np

    def sound(part):
        flat = part.column("z").values.to_numpy(zero_copy_only=False)
        bounds = part.column("z").offsets.to_numpy()
        z = flat[bounds[0] : bounds[-1]].reshape(part.num_rows, -1)
        return z[:, ~np.isnan(z[0])] if len(z) else z

    def totals(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict = {}
        for batch in batches:
            for dim, part in _by_dim(batch):
                total = _weights(part, weights) @ sound(part)
                found[dim] = found[dim] + total if dim in found else total
        for dim, total in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["dim", "stripe", "part"])

    centres = {r["dim"]: np.frombuffer(bytes(r["part"])) / fits[r["dim"]][0] for r in _added(white.mapInArrow(totals, "dim int, stripe int, part binary"), len(fits)).toLocalIterator()}
    covs = _products(white, lambda dim, part: sound(part) - centres[dim], weights, [min(components, d) for d in fits])
    return {d: float(np.abs(c / fits[d][0] - np.eye(len(c))).max()) for d, c in covs.items()}


def report(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
