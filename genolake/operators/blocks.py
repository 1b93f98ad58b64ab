"""Cross-products of rows of a long matrix, by blocks.

A join of a matrix with itself makes a row per pair and column. Here each task streams its columns in blocks, multiplies
them as a dense matrix and sends one row per pair, so what is shuffled does not grow with the number of columns. The
number of rows (individuals of a cohort) is bounded by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

COLUMNS_AT_ONCE = 1024


def cross_products(cells: DataFrame, row: str, column: str, value: str, columns_at_once: int = COLUMNS_AT_ONCE) -> DataFrame:
    """(row1, row2, cross, n) for row1 <= row2: the summed products, and over how many columns that both rows have.

    Repeated cells of a row and column add up.
    """
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = cells.schema[row].dataType.simpleString()
    arrow = to_arrow_type(cells.schema[row].dataType)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        place: dict = {}
        sums, counts = np.zeros((0, 0)), np.zeros((0, 0))
        cells_held: list[tuple] = []
        open_columns, last = 0, None

        def add() -> None:
            nonlocal sums, counts
            rows, cols, values = (np.array(x) for x in zip(*cells_held, strict=True))
            if len(place) > len(sums):
                grown = [np.zeros((len(place), len(place))) for _ in range(2)]
                for new, old in zip(grown, (sums, counts), strict=True):
                    new[: len(old), : len(old)] = old
                sums, counts = grown
            z, there = np.zeros((len(place), cols.max() + 1)), np.zeros((len(place), cols.max() + 1))
            np.add.at(z, (rows, cols), values)
            there[rows, cols] = 1
            sums += z @ z.T
            counts += there @ there.T
            cells_held.clear()

        for batch in batches:
            for r, c, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != last:
                    if open_columns == columns_at_once:
                        add()
                        open_columns = 0
                    open_columns, last = open_columns + 1, c
                cells_held.append((place.setdefault(r, len(place)), open_columns - 1, v))
        if cells_held:
            add()
        names = list(place)
        order = np.array(sorted(range(len(names)), key=names.__getitem__), dtype=int)
        for a in range(len(order)):
            with_ = order[a:][counts[order[a], order[a:]] > 0]
            if len(with_):
                yield pa.RecordBatch.from_pydict({"row1": pa.array([names[order[a]]] * len(with_), arrow), "row2": pa.array([names[k] for k in with_], arrow), "cross": sums[order[a], with_], "n": counts[order[a], with_].astype(np.int64)})

    tidy = cells.select(row, column, F.col(value).cast("double").alias(value)).dropna()
    dealt = tidy.repartition(n, column).sortWithinPartitions(column)
    parts = dealt.mapInArrow(run, f"row1 {kind}, row2 {kind}, cross double, n long")
    return parts.groupBy("row1", "row2").agg(F.sum("cross").alias("cross"), F.sum("n").alias("n"))


#: Numbers of a matrix that travel in one row.
STRIPE = 1 << 16


def summed(parts: DataFrame) -> DataFrame:
    """(stripe, part): rows of equal ``stripe`` added up, ``part`` being packed doubles. Every stripe is one stream of a task."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def row(stripe, total):
            return pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["stripe", "part"])

        at, total = None, None
        for batch in batches:
            for stripe, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stripe != at:
                    if at is not None:
                        yield row(at, total)
                    at, total = stripe, np.zeros(len(raw) // 8)
                total += np.frombuffer(raw)
        if at is not None:
            yield row(at, total)

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "stripe").sortWithinPartitions("stripe").mapInArrow(run, "stripe int, part binary")


def in_stripes(matrix) -> Iterator:
    """A matrix as rows (stripe, part) of packed doubles."""
    import numpy as np
    import pyarrow as pa

    flat = np.ascontiguousarray(matrix, dtype=float).ravel()
    for k in range(0, len(flat), STRIPE):
        yield pa.RecordBatch.from_arrays([pa.array([k // STRIPE], pa.int32()), pa.array([flat[k : k + STRIPE].tobytes()], pa.binary())], names=["stripe", "part"])


def collected(parts: DataFrame, shape: tuple[int, int]):
    """The sum of the tasks' matrices, whose size the caller has checked, as one matrix."""
    import numpy as np

    out = np.zeros(shape[0] * shape[1])
    for r in summed(parts).toLocalIterator():
        piece = np.frombuffer(bytes(r["part"]))
        out[r["stripe"] * STRIPE : r["stripe"] * STRIPE + len(piece)] = piece
    return out.reshape(shape)


def packed_columns(cells: DataFrame, inds: list, column: str = "snp", at_once: int = 256) -> DataFrame:
    """(columns, cells): blocks of columns (markers) as packed matrices of columns by individuals; what is missing is 0.

    cells: (ind, column, z). Individuals that are not in ``inds`` are left out; repeated cells add up.
    """
    import numpy as np

    place = cells.sparkSession.sparkContext.broadcast({x: k for k, x in enumerate(inds)})
    kind, arrow, size = cells.schema[column].dataType.simpleString(), to_arrow_type(cells.schema[column].dataType), len(inds)

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, rows = [], []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([names], pa.list_(arrow)), pa.array([np.stack(rows).tobytes()], pa.binary())], names=["columns", "cells"])

        at = place.value
        for batch in batches:
            for c, i, z in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not names or names[-1] != c:
                    if len(names) == at_once:
                        yield block()
                        names, rows = [], []
                    names.append(c)
                    rows.append(np.zeros(size))
                if i in at:
                    rows[-1][at[i]] += z
        if names:
            yield block()

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tidy = cells.select(column, "ind", F.col("z").cast("double").alias("z")).dropna()
    return tidy.repartition(n, column).sortWithinPartitions(column).mapInArrow(pack, f"columns array<{kind}>, cells binary")


def gram_times(blocks: DataFrame, vectors):
    """Z Z' times the columns of ``vectors`` (individuals by right-hand sides), Z being the packed blocks; no matrix of individuals by individuals exists."""
    import numpy as np

    sent = blocks.sparkSession.sparkContext.broadcast(np.asarray(vectors, dtype=float))

    def run(batches: Iterator) -> Iterator:
        v = sent.value
        total = np.zeros_like(v)
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                z = np.frombuffer(raw).reshape(-1, len(v))
                total += z.T @ (z @ v)
        yield from in_stripes(total)

    out = collected(blocks.mapInArrow(run, "stripe int, part binary"), vectors.shape)
    sent.destroy()
    return out


def gram(blocks: DataFrame, size: int):
    """Z Z' of packed blocks as a matrix of a cohort, whose size the caller has checked."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        total = np.zeros((size, size))
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                z = np.frombuffer(raw).reshape(-1, size)
                total += z.T @ z
        yield from in_stripes(total)

    return collected(blocks.mapInArrow(run, "stripe int, part binary"), (size, size))


def conjugate_gradients(blocks: DataFrame, rhs, penalties, masks=None, tolerance: float = 1e-10, most_rounds: int = 1000):
    """Solutions of (M Z Z' M + penalty I) x = rhs for several right-hand sides at once, each with its mask of individuals and its penalty.

    Every round multiplies by all blocks in the tasks, once for all right-hand sides. Vectors of the cohort's length are in the driver.
    """
    import numpy as np

    masks = np.ones_like(rhs) if masks is None else masks
    x, r = np.zeros_like(rhs), rhs * masks
    p, rr = r.copy(), (r * r).sum(axis=0)
    goal = tolerance * tolerance * np.maximum(rr, 1e-300)
    for _ in range(most_rounds):
        live = rr > goal
        if not live.any():
            return x
        ap = np.zeros_like(p)
        ap[:, live] = gram_times(blocks, p[:, live]) * masks[:, live] + penalties[live] * p[:, live]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(live, rr / (p * ap).sum(axis=0), 0.0)
        x, r = x + step * p, r - step * ap
        new = (r * r).sum(axis=0)
        p, rr = r + np.where(live, new / np.maximum(rr, 1e-300), 0.0) * p, np.where(live, new, rr)
    raise ArithmeticError(f"no solution after {most_rounds} rounds")
