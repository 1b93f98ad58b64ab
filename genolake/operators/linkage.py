"""Linkage disequilibrium of markers by distance, plain or corrected for kinship and structure.

Each marker is one packed row of doses of the cohort, whose size is checked. Markers are dealt to blocks of positions, four windows long; a block also
gets the first window of the block behind it (its halo), so every pair within the window meets, in the block of its first marker, and exactly
once. A block streams through its task in the order of positions, and only what lies within the window of the current markers is held.

For the corrected r2, markers are whitened by the relationship K of the individuals and freed of the mean and the populations' means,
by generalised least squares: with V = K and the design S, r2 is (x'Py)^2 / (x'Px y'Py), P = V^-1 - V^-1 S (S'V^-1 S)^-1 S'V^-1. K may be singular,
its generalised inverse is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from genolake.operators.association import MOST_INDIVIDUALS, _cohort
from genolake.session import partitions

BLOCK_WINDOWS = 4
MARKERS_AT_ONCE = 256


def correction(inds: list, relationship: DataFrame | None, populations: DataFrame | None):
    """The matrix that whitens a marker and frees it of the means. relationship: (ind1, ind2, relationship), once or both ways; populations: (ind, population)."""
    import numpy as np

    place, n = {i: k for k, i in enumerate(inds)}, len(inds)
    white = np.eye(n)
    if relationship is not None:
        k = np.zeros((n, n))
        for r in relationship.limit(MOST_INDIVIDUALS * MOST_INDIVIDUALS).toLocalIterator():  # bounded by the cohort
            if r["ind1"] in place and r["ind2"] in place:
                k[place[r["ind1"]], place[r["ind2"]]] = k[place[r["ind2"]], place[r["ind1"]]] = r["relationship"]
        values, vectors = np.linalg.eigh(k)
        sound = values > 1e-8 * max(values.max(), 1e-300)
        white = (vectors[:, sound] / np.sqrt(values[sound])) @ vectors[:, sound].T
    design = [np.ones(n)]
    if populations is not None:
        of = {r["ind"]: r["population"] for r in populations.limit(MOST_INDIVIDUALS + 1).collect() if r["ind"] in place}
        for name in sorted({p for p in of.values() if p is not None})[1:]:
            design.append(np.array([float(of.get(i) == name) for i in inds]))
    x = white @ np.stack(design, axis=1)
    return white - x @ (np.linalg.pinv(x) @ white)


def windowed(doses: DataFrame, snps: DataFrame, window: int, relationship: DataFrame | None = None, populations: DataFrame | None = None) -> DataFrame:
    """(snp1, snp2, distance, n, r2) of all pairs of markers of a chromosome at most ``window`` apart; snp1 comes first by position, then name.

    doses: (snp, ind, g); snps: (snp, chrom, pos), a row per marker. Plain r2 is over the ``n`` individuals that have both markers.
    For the corrected one a missing dose is the marker's mean, and n is the cohort. Markers that do not vary have no pairs.
    """
    import numpy as np

    inds = _cohort(doses)
    matrix = correction(inds, relationship, populations) if relationship is not None or populations is not None else None
    shared = doses.sparkSession.sparkContext.broadcast(({i: k for k, i in enumerate(inds)}, matrix))
    kind, arrow = doses.schema["snp"].dataType.simpleString(), to_arrow_type(doses.schema["snp"].dataType)
    n_inds, corrected = len(inds), matrix is not None

    def pack(cells):
        import pyarrow as pa

        place, matrix = shared.value
        dose = np.full(len(place), np.nan)
        for i, g in zip(cells.column("ind").to_pylist(), cells.column("g").to_pylist(), strict=True):
            if i in place and g is not None:
                dose[place[i]] = g
        if matrix is not None and not np.isnan(dose).all():
            dose = matrix @ (np.where(np.isnan(dose), np.nanmean(dose), dose) - np.nanmean(dose))
        return pa.table({"snp": cells.column("snp").slice(0, 1), "cells": pa.array([dose.tobytes()], pa.binary())})

    packed = doses.select("snp", "ind", F.col("g").cast("double").alias("g")).groupBy("snp").applyInArrow(pack, f"snp {kind}, cells binary")
    block = F.floor(F.col("pos") / (BLOCK_WINDOWS * window))
    near = F.col("pos") - block * (BLOCK_WINDOWS * window) < window
    copies = F.array(F.struct(block.alias("block"), F.lit(True).alias("owned")), F.when(near, F.struct((block - 1).alias("block"), F.lit(False).alias("owned"))))
    dealt = packed.join(snps.select("snp", "chrom", "pos").dropna(), "snp").withColumn("_c", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    dealt = dealt.select("chrom", "_c.block", "pos", "snp", "_c.owned", "cells").repartition(partitions(doses.sparkSession), "chrom", "block").sortWithinPartitions("chrom", "block", "pos", "snp")

    def plain(x, y):
        a, b = (~np.isnan(m) for m in (x, y))
        x, y, a, b = np.nan_to_num(x), np.nan_to_num(y), a.astype(float), b.astype(float)
        n, sx, sy = a @ b.T, x @ b.T, a @ y.T
        xx, yy = n * ((x * x) @ b.T), n * (a @ (y * y).T)
        vx, vy, xy = xx - sx * sx, yy - sy * sy, n * (x @ y.T) - sx * sy
        ok = (vx > 1e-12 * xx) & (vy > 1e-12 * yy)
        return n, ok, np.minimum(1.0, xy * xy / np.where(ok, vx * vy, 1))

    def whitened(x, y):
        xx, yy, xy = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None, :], x @ y.T
        ok = (xx > 1e-9) & (yy > 1e-9)
        return np.full(ok.shape, n_inds), ok, np.minimum(1.0, xy * xy / np.where(ok, xx * yy, 1))

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, names, places, cells = None, [], np.zeros(0, np.int64), np.zeros((0, n_inds))
        for batch in batches:
            keys = list(zip(batch.column("chrom").to_pylist(), batch.column("block").to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and to - at < MARKERS_AT_ONCE and keys[to] == keys[at]:
                    to += 1
                part = batch.slice(at, to - at)
                if keys[at] != key:
                    key, names, places, cells = keys[at], [], np.zeros(0, np.int64), np.zeros((0, n_inds))
                snp, pos, owned = part.column("snp").to_pylist(), part.column("pos").to_numpy().astype(np.int64), np.array(part.column("owned").to_pylist())
                y = np.stack([np.frombuffer(c) for c in part.column("cells").to_pylist()])
                near = places >= pos[0] - window
                names, places, cells = [x for x, k in zip(names, near, strict=True) if k], places[near], cells[near]
                first = len(names)
                names, places, cells = names + snp, np.append(places, pos), np.concatenate([cells, y])
                mine = np.append(np.ones(first, bool), owned)
                n, ok, r2 = (whitened if corrected else plain)(cells, y)
                apart = pos[None, :] - places[:, None]
                ok &= (np.arange(len(names))[:, None] < first + np.arange(len(snp))[None, :]) & (apart <= window) & mine[:, None]
                i, j = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in i], arrow), pa.array([snp[k] for k in j], arrow), pa.array(apart[i, j]), pa.array(n[i, j].astype(np.int64)), pa.array(r2[i, j])], names=["snp1", "snp2", "distance", "n", "r2"])
                names, places, cells = [x for x, k in zip(names, mine, strict=True) if k], places[mine], cells[mine]
                at = to

    return dealt.mapInArrow(meet, f"snp1 {kind}, snp2 {kind}, distance long, n long, r2 double")
