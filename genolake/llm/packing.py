"""Best-fit packing by exact-complement hashing.

Documents become token ids; longer ones are cut into pieces of ``limit`` tokens. How often each length occurs
(at most ``limit`` numbers, whatever the input) is all that the plan needs. ``SumIndex`` holds, for every sum up to
``limit``, one length, one pair and one triple of available lengths that make it. From the longest length down,
the gap that a length leaves is looked up there and closed exactly, as often as the counts allow, and
entries whose lengths are used up are made again. What has no exact complement is filled by best fit. Equal
sequences are planned together, as a pattern and a number of times, so the plan's size is bounded by ``limit``
too, and so is the work of making it.

Pieces find their places by their rank among the pieces of their length. Ranks are counted per bucket of
documents and added up over the buckets, so no task sees all pieces of a length.

Defined results: null text is an empty document, which is the end mark alone. Repeated rows are packed one by
one; rows that agree in all are interchangeable. A null id is returned as it is. Empty tables give empty
results. Only documents longer than ``limit`` are cut. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genolake.llm.tokens import slices, tokenizer_path, word_encoder
from genolake.session import checkpoint, filled, partitions

LIMIT = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, bucket int, ord long"


def make_pieces(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None, buckets: int = 64) -> DataFrame:
    """One row per piece. ``bucket`` and ``ord`` place it in a fixed order that is dealt over the tasks."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        encoder = word_encoder(tokenizer or tokenizer_path("word_bpe_49k.json"))
        names = [x.split()[0] for x in PIECES.split(", ")]
        for whole in batches:
            for first, n in slices(whole.column(1)):
                batch = whole.slice(first, n)
                ids, cuts = encoder.encode(batch.column(1))
                ids = np.insert(ids, cuts[1:], END_ID).astype("<u4")
                cuts = cuts + np.arange(n + 1)
                tokens = np.diff(cuts)
                pieces = -(-tokens // limit)
                doc = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * limit
                length = np.minimum(limit, tokens[doc] - start)
                raw, at = memoryview(ids.tobytes()), 4 * (cuts[:-1][doc] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                order = batch.column(2).to_numpy()[doc]
                cols = (piece.astype(np.int32), start, length.astype(np.int32), crc, (order % buckets).astype(np.int32), order)
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)
        pa.default_memory_pool().release_unused()  # the worker waits for its next task

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("_h")).mapInArrow(run, PIECES)


class SumIndex:
    """Available lengths and, for every sum up to ``limit``, an available single, pair and triple that makes it.

    ``two[s]`` and ``three[s]`` hold the largest part of the combination (0: there is none), its largest part being as large as can be;
    the rest of a triple is the pair of what it leaves. Counts only fall, so an entry is right until a length
    in it is used up, and ``exact`` makes such an entry again when it meets it.
    """

    def __init__(self, counts: dict[int, int], limit: int) -> None:
        import numpy as np

        self.limit, self.left = limit, np.zeros(limit + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] += n
        self.two, self.three = np.zeros(limit + 1, dtype=np.int64), np.zeros(limit + 1, dtype=np.int64)
        have = np.flatnonzero(self.left)
        for a in have.tolist():  # ascending: the last to write an entry has the largest part
            self.two[a + have[(have < a) & (have <= limit - a)]] = a
            if self.left[a] > 1 and 2 * a <= limit:
                self.two[2 * a] = a
        sums = np.flatnonzero(self.two)
        for a in have.tolist():
            rest = sums[(sums <= limit - a) & (self.two[sums] < a)]
            self.three[a + rest] = a
        for s in range(3, limit + 1):  # where the largest part occurs twice or more, counts decide
            self.three[s] = max(self.three[s], self._triple(s, self.three[s]))

    def _pair(self, total: int, most: int) -> int:
        """Largest part, at most ``most``, of an available pair with this sum."""
        import numpy as np

        high = min(total - 1, most)
        a = np.arange(high, (total + 1) // 2 - 1, -1) if total > 1 else np.zeros(0, np.int64)
        b = total - a
        ok = np.flatnonzero((self.left[a] > 0) & (self.left[b] > 0) & ((a != b) | (self.left[a] > 1)))
        return int(a[ok[0]]) if len(ok) else 0

    def _triple(self, total: int, above: int = 0) -> int:
        """Largest part, over ``above``, of an available triple with this sum."""
        import numpy as np

        low = max(above + 1, -(-total // 3))
        for a in (low + np.flatnonzero(self.left[low : max(low, total - 1)]))[::-1].tolist():
            if self._with(a, lambda: self._pair(total - a, a)):
                return a
        return 0

    def _with(self, a: int, look) -> int:
        self.left[a] -= 1
        found = look()
        self.left[a] += 1
        return found

    def _holds(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that close the gap, or None."""
        if not 0 < gap <= self.limit:
            return None
        if self.left[gap]:
            return (gap,)
        if a := int(self.two[gap]):
            if not self._holds((a, gap - a)):
                a = self.two[gap] = self._pair(gap, gap)
            if a:
                return (int(a), gap - int(a))
        while a := int(self.three[gap]):
            b = self._with(a, lambda: self._pair(gap - a, a)) if self.left[a] else 0
            if b:
                return (a, b, gap - a - b)
            self.three[gap] = self._triple(gap)
        return None

    def longest(self, gap: int) -> int:
        """The longest available length that fits, or 0."""
        import numpy as np

        fits = np.flatnonzero(self.left[: max(0, gap) + 1])
        return int(fits[-1]) if len(fits) else 0


def plan_patterns(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, number of times): together they use up ``counts`` and none exceeds ``limit``."""
    index = SumIndex(counts, limit)
    left = index.left
    plan: list[tuple[tuple[int, ...], int]] = []
    for length in range(limit, 0, -1):
        while left[length]:
            pattern, gap = [length], limit - length
            left[length] -= 1
            while gap > 0:
                found = index.exact(gap)
                if found is None:  # best fit, then the rest of the gap is looked up again
                    found = (index.longest(gap),)
                    if not found[0]:
                        break
                for x in found:
                    left[x] -= 1
                pattern.extend(found)
                gap -= sum(found)
            for x in pattern:
                left[x] += 1
            times = min(int(left[x]) // pattern.count(x) for x in set(pattern))
            for x in pattern:
                left[x] -= times
            plan.append((tuple(pattern), times))
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple]:
    """For each length: first rank, sequence of that rank and offset of each run of pieces."""
    import numpy as np

    used: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            rank = used.get(x, 0)
            runs.setdefault(x, []).append((rank, sequence, offset))
            used[x] = rank + times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def pack(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    spark = docs.sparkSession
    buckets = max(64, partitions(spark))
    pieces = checkpoint(make_pieces(docs, limit, tokenizer, buckets))
    per_bucket = pieces.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    places = spark.sparkContext.broadcast(slots(plan_patterns(counts, limit)))  # bounded by ``limit`` as well
    before = per_bucket.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("ord", "piece", "doc_id"))
    ranked = pieces.withColumn("own", own - 1).join(before.select("bucket", "length", F.coalesce("base", F.lit(0)).alias("base")), ["bucket", "length"])
    ranked = filled(ranked, sum(counts.values())).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("own") + F.col("base")).alias("rank"))

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        runs = places.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                first, seq, off = runs[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows] = seq[k] + rank[rows] - first[k]
                offset[rows] = off[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def fewest(total_tokens: int, limit: int = LIMIT) -> int:
    """No packing has fewer sequences."""
    return math.ceil(total_tokens / limit)
