"""Greedy walks along sorted positions by jump pointers, with one chromosome over many tasks.

From a kept position a walk goes to the first position at a distance of ``reach`` or more. Position after position this is a chain as long as the
chromosome; here it is cut into ranges:

1. Distinct positions are dealt to ranges of the sorted (chromosome, position) order and written to the checkpoint folder.
2. Each range finds, for every position where a walk can enter it (those nearer than ``reach`` to its first one, and the next), where the walk leaves, by doubling
   the pointers inside the range. What leaves is a threshold: the walk goes on at the first position from there on.
3. Thresholds meet the entries of the range they point to, which makes a table of jumps from range to range.
4. Pointer doubling: walks start at each chromosome's first position; in each round the entries reached so far jump once more and the jumps double
   in length, so log2(ranges) rounds mark every entry.
5. Each range walks from its marked entry.

What comes to the driver is one row per range.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genolake.session import checkpoint, partitions


#: Positions of a range, at least, so that there are no more ranges than are of use.
RANGE = 100_000


def _ranges(snps: DataFrame, parts: int | None) -> DataFrame:
    """(part, chrom, pos, snp, n): distinct positions with their first marker and number of markers, dealt by order."""
    places = checkpoint(snps.filter("chrom is not null and pos is not null").groupBy("chrom", "pos").agg(F.min("snp").alias("snp"), F.count("*").alias("n")))
    n = parts or max(1, min(partitions(snps.sparkSession), -(-places.count() // RANGE)))
    dealt = places.repartitionByRange(n, "chrom", "pos")
    return checkpoint(dealt.select(F.spark_partition_id().alias("part"), "chrom", "pos", "snp", "n"))


def _stretches(batches: Iterator) -> Iterator:
    """(chrom, positions) of each chromosome in a sorted partition."""
    import numpy as np

    chrom, held = None, []
    for batch in batches:
        names, pos = batch.column("chrom").to_pylist(), batch.column("pos").to_numpy()
        at = 0
        for k in range(1, len(names) + 1):
            if k == len(names) or names[k] != names[at]:
                if names[at] != chrom and held:
                    yield chrom, np.concatenate(held)
                    held = []
                chrom = names[at]
                held.append(pos[at:k])
                at = k
    if held:
        yield chrom, np.concatenate(held)


def _last_of_walk(pos, reach: int):
    """For each position the last one of the walk that starts there."""
    import numpy as np

    jump = np.searchsorted(pos, pos + reach)
    jump = np.where(jump < len(pos), jump, np.arange(len(pos)))
    while True:
        far = jump[jump]
        if (far == jump).all():
            return pos[jump]
        jump = far


def _jumps(ranges: DataFrame, reach: int, ends: list) -> DataFrame:
    """(chrom, part, pos, next_part, next): entries of ranges and the entries of later ranges where their walks go on (null: nowhere).

    ``ends`` are the last (chromosome, position) of the ranges, in order.
    """
    import bisect

    def enter(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        keys = [(c.encode(), p) for c, p, _ in ends]
        for chrom, pos in _stretches(batches):
            near = int(np.searchsorted(pos, pos[0] + reach)) + 1
            entry, to = pos[:near], _last_of_walk(pos, reach)[:near] + reach
            found = [bisect.bisect_left(keys, (chrom.encode(), int(t))) for t in to]
            parts = [ends[k][2] if k < len(ends) else None for k in found]
            yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(entry)), pa.array(entry), pa.array(to), pa.array(parts, pa.int32())], names=["chrom", "pos", "to", "next_part"])

    sorted_ranges = ranges.select("part", "chrom", "pos").repartition(partitions(ranges.sparkSession), "part").sortWithinPartitions("part", "chrom", "pos")

    def by_part(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        # A task may hold several ranges; each is read by itself.
        part, held = None, []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b in zip(*_bounds(np, ids), strict=True):
                if ids[a] != part and held:
                    yield from _tagged(pa, part, enter(held))
                    held = []
                part = int(ids[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from _tagged(pa, part, enter(held))

    nodes = checkpoint(sorted_ranges.mapInArrow(by_part, "part int, chrom string, pos long, to long, next_part int"))
    entries = nodes.select("chrom", "part", F.col("pos").alias("at"), F.lit(0).alias("kind"), F.col("pos").alias("entry"), F.lit(None).cast("long").alias("from_pos"), F.lit(None).cast("int").alias("from_part"))
    asked = nodes.filter("next_part is not null").select("chrom", F.col("next_part").alias("part"), F.col("to").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("entry"), F.col("pos").alias("from_pos"), F.col("part").alias("from_part"))
    # From the largest position down, the smallest entry so far is the first one at or behind a threshold.
    met = entries.union(asked).withColumn("next", F.min("entry").over(Window.partitionBy("chrom", "part").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("kind = 1 and next is not null")
    return met.select("chrom", F.col("from_part").alias("part"), F.col("from_pos").alias("pos"), F.col("part").alias("next_part"), "next")


def _bounds(np, ids):
    cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    return [0, *cuts.tolist()], [*cuts.tolist(), len(ids)]


def _tagged(pa, part: int, found: Iterator) -> Iterator:
    for b in found:
        yield pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int32()), *(b.column(c) for c in ("chrom", "pos", "to", "next_part"))], names=["part", "chrom", "pos", "to", "next_part"])


def walk(snps: DataFrame, reach: int, parts: int | None = None) -> DataFrame:
    """(chrom, pos, snp, n, part, start): distinct positions (with their first marker and number of markers) and, in ``start``, the kept position that each belongs to.

    A position is kept where ``start`` equals it. Rows without chromosome or position are left out; ``reach`` is at least 1.
    """
    if reach < 1:
        raise ValueError("reach is at least 1")
    spark = snps.sparkSession
    ranges = _ranges(snps, parts)
    last = ranges.groupBy("part").agg(F.max(F.struct("chrom", "pos")).alias("end")).orderBy("part").collect()  # one row per range
    ends = [(r["end"]["chrom"], r["end"]["pos"], r["part"]) for r in last]
    firsts = ranges.groupBy("chrom").agg(F.min(F.struct("pos", "part")).alias("f")).select("chrom", F.col("f.part").alias("part"), F.col("f.pos").alias("pos"))
    marked, hops = checkpoint(firsts), checkpoint(_jumps(ranges, reach, ends)) if len(ends) > 1 else None  # one range has no jumps
    while hops is not None and not hops.isEmpty():
        ahead = marked.join(hops, ["chrom", "part", "pos"]).select("chrom", F.col("next_part").alias("part"), F.col("next").alias("pos"))
        marked = checkpoint(marked.union(ahead).distinct())
        then = hops.select("chrom", F.col("part").alias("next_part"), F.col("pos").alias("next"), F.col("next_part").alias("far_part"), F.col("next").alias("far"))
        hops = checkpoint(hops.join(then, ["chrom", "next_part", "next"]).select("chrom", "part", "pos", F.col("far_part").alias("next_part"), F.col("far").alias("next")))

    def go(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def starts(rows):
            pos, entry = rows.column("pos").to_numpy(), rows.column("entry")[0].as_py()
            kept = np.zeros(len(pos), bool)
            k = len(pos) if entry is None else int(np.searchsorted(pos, entry))
            while k < len(pos):
                kept[k] = True
                k = int(np.searchsorted(pos, pos[k] + reach))
            at = np.maximum.accumulate(np.where(kept, np.arange(len(pos)), -1))
            start = pa.array(pos[np.maximum(at, 0)], mask=at < 0)
            return pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("part", "chrom", "pos", "snp", "n")), start], names=["part", "chrom", "pos", "snp", "n", "start"])

        held, key = [], None
        for batch in batches:
            keys = list(zip(batch.column("part").to_pylist(), batch.column("chrom").to_pylist(), strict=True))
            a = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[a]:
                    if keys[a] != key and held:
                        yield starts(_joined(pa, held))
                        held = []
                    key = keys[a]
                    held.append(batch.slice(a, k - a))
                    a = k
        if held:
            yield starts(_joined(pa, held))

    kind = snps.schema["snp"].dataType.simpleString()
    entered = ranges.join(marked.select("chrom", "part", F.col("pos").alias("entry")), ["chrom", "part"], "left").select("part", "chrom", "pos", "snp", "n", "entry")
    dealt = entered.repartition(partitions(spark), "part", "chrom").sortWithinPartitions("part", "chrom", "pos")
    own = checkpoint(dealt.mapInArrow(go, f"part int, chrom string, pos long, snp {kind}, n long, start long"))
    # What lies before a range's entry belongs to the last kept position of the ranges before: one row per chromosome and range.
    tails = own.groupBy("chrom", "part").agg(F.max("start").alias("tail"))
    before = tails.select("chrom", "part", F.last("tail", ignorenulls=True).over(Window.partitionBy("chrom").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return own.join(before, ["chrom", "part"]).select("chrom", "pos", "snp", "n", "part", F.coalesce("start", "before").alias("start"))


def _joined(pa, held: list):
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]
