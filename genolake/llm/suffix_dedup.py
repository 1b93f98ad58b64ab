"""Suffix-array dedup: a logarithmic family of suffix arrays.

Texts are bytes. A byte goes when a 100-byte string over it also starts earlier: in a document with a smaller
id, or before in its own. Suffixes are taken at places that the contents choose (the starts of the runs of ``runs``, so
equal stretches are cut alike) and are read as far as their run reaches.

1. A bucket of documents is a batch and gets a suffix array: its suffixes in their order. Equal neighbours are
   matches inside the batch; all but the first of them, by document and place, are settled there.
2. The first ones go to shards by their minimiser, where they arrive in the order of documents and places. A shard keeps one
   ``SuffixFamily`` for all that arrives: each new batch is sorted, merge-scanned against every level, and
   what matches over its whole length is settled; what is new becomes a level, and levels of like size are merged, so n
   suffixes pass through log n merges.
3. A new suffix whose minimiser was met with another content may still share inner strings with it. Such contents
   go, with all their suffixes, through a second, dense family of the same kind, which settles them string by string.

Shards are sized by the input (``SHARD_BYTES``), and a lost task rebuilds its families from the shuffle.

Defined results: null text counts as empty; texts under 100 bytes lose nothing. A null id is ordered after all others.
Rows that share an id are one document after the other, in the order of a hash of their texts; the same row twice is
judged once, for both. Empty tables give empty results. Long texts are read whole. Extra columns are kept by
``remove_repeats`` and not read by ``report``. Where text is returned, a character that lost some of its bytes goes.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import merge

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.llm.runs import BUCKET_BYTES, ByteTexts, covered, deal, in_order, marked_runs, merged, recurring, table_of
from genolake.session import partitions

WIDTH = ByteTexts.width
SHARD_BYTES = 1 << 20
#: Suffixes of a batch inside a shard.
BATCH = 4096


class SuffixFamily:
    """Levels of sorted suffixes whose sizes fall geometrically."""

    def __init__(self) -> None:
        self.levels: list[list[bytes]] = []

    def add(self, batch: list[bytes]) -> list[bool]:
        """Which of these suffixes begin one that was there before, or one earlier in ``batch``; all are there afterwards."""
        order = sorted(range(len(batch)), key=batch.__getitem__)  # the suffix array of the batch
        seen = [False] * len(batch)
        fresh: list[int] = []
        for i in order:
            if fresh and batch[fresh[-1]] == batch[i]:
                seen[i] = True
            else:
                fresh.append(i)
        for level in self.levels:  # merge-scan: both sides are sorted, so each search begins where the last ended
            at, left = 0, []
            for i in fresh:
                at = bisect_left(level, batch[i], at)
                if at < len(level) and level[at].startswith(batch[i]):
                    seen[i] = True
                else:
                    left.append(i)
            fresh = left
        self._grow([batch[i] for i in fresh])
        return seen

    def _grow(self, level: list[bytes]) -> None:
        if not level:
            return
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = list(merge(self.levels.pop(), level))
        self.levels.append(level)


class DenseFamily:
    """The same over all strings of ``width`` bytes of some contents, as arrays."""

    def __init__(self, width: int = WIDTH, batch: int = 1 << 14) -> None:
        self.width, self.batch, self.levels = width, batch, []

    def add(self, data, starts):
        """Which of these strings were there before or earlier in ``starts``; all are there afterwards."""
        import numpy as np

        seen = np.zeros(len(starts), dtype=bool)
        offsets = np.arange(self.width)
        for k in range(0, len(starts), self.batch):
            part = starts[k : k + self.batch]
            strings = np.ascontiguousarray(data[part[:, None] + offsets]).view(f"S{self.width}").ravel()
            order = np.argsort(strings, kind="stable")  # the suffix array of this batch
            ordered = strings[order]
            known = np.zeros(len(part), dtype=bool)
            known[1:] = ordered[1:] == ordered[:-1]
            fresh = ~known
            for level in self.levels:  # merge-scan: both sides are sorted
                at = np.searchsorted(level, ordered)
                hit = np.zeros(len(part), dtype=bool)
                inside = at < len(level)
                hit[inside] = level[at[inside]] == ordered[inside]
                known |= hit
                fresh &= ~hit
            seen[k + order] = known
            self._grow(ordered[fresh])
        return seen

    def _grow(self, level) -> None:
        import numpy as np

        if not len(level):
            return
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = np.concatenate([self.levels.pop(), level])
            level.sort(kind="stable")
        self.levels.append(level)


class Shard:
    """The families of one shard. Contents come in the order of their first places."""

    def __init__(self) -> None:
        self.sampled, self.dense = SuffixFamily(), DenseFamily()
        #: Minimisers met, with their only content so far, or None once their contents are in the dense family.
        self.alone: dict[int, bytes | None] = {}

    def add(self, keys: list[int], contents: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(number of the content, first window, end) of what was there before."""
        import numpy as np

        whole = self.sampled.add(contents)
        asked: list[int | None] = []
        deep: list[bytes] = []
        for i, (key, content) in enumerate(zip(keys, contents, strict=True)):
            if whole[i]:
                yield i, 0, len(content) - WIDTH + 1
            elif key not in self.alone:
                self.alone[key] = content
            else:
                if (other := self.alone[key]) is not None:
                    self.alone[key] = None
                    deep.append(other)
                    asked.append(None)
                deep.append(content)
                asked.append(i)
        if not deep:
            return
        data = np.frombuffer(b"".join(deep), dtype=np.uint8)
        windows = np.array([len(c) - WIDTH + 1 for c in deep])
        begins = np.cumsum(windows + WIDTH - 1) - windows - WIDTH + 1
        inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        seen = self.dense.add(data, np.repeat(begins, windows) + inside)
        for i, marks in zip(asked, np.split(seen, np.cumsum(windows)[:-1]), strict=True):
            if i is not None and marks.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
                for a, b in edge.reshape(-1, 2).tolist():
                    yield i, a, b


ROUTED = "shard int, key long, content binary, _b int, _d long, _h long, start int, windows int"
SPANS = "_b int, _d long, _h long, start int, windows int"


def repeated_spans(texts: DataFrame, buckets: int, hot: int | None = None) -> DataFrame:
    """(_b, _d, _h, start, windows): stretches of windows of dealt ``texts`` that also start earlier."""
    n = partitions(texts.sparkSession)
    shards = max(16 * n, math.ceil(buckets * BUCKET_BYTES / SHARD_BYTES) if buckets > 2 * n else 0)

    def first_of_batch(bucket, marks):
        d, h, rows, _ = in_order(bucket)
        b = bucket.column("_b")[0].as_py() if bucket.num_rows else 0
        keys, contents, owners, starts, sizes = marked_runs(rows, marks, ByteTexts)
        out: list = []
        gone: dict[int, list] = {}
        last = None
        for i in sorted(range(len(contents)), key=contents.__getitem__):  # the suffix array; equal ones stay in the order of their places
            if contents[i] == last:
                gone.setdefault(owners[i], []).append((starts[i], starts[i] + sizes[i]))
                continue
            last, o = contents[i], owners[i]
            out.append(((keys[i] >> 20) % shards, keys[i], last, b, d[o], h[o], starts[i], sizes[i]))
        for o, spans in gone.items():  # settled; spread by document
            out.extend(((d[o] ^ h[o]) % shards, 0, None, b, d[o], h[o], x, y - x) for x, y in merged(spans))
        return table_of(list(zip(*out, strict=True)) or [[]] * 8, ROUTED)

    def scan(batches: Iterator) -> Iterator:
        shard = family = None
        held: list = []
        out: list = []

        def settle() -> None:
            if held:
                for i, a, b in family.add([x[0] for x in held], [x[1] for x in held]):
                    out.append((*held[i][2:5], held[i][5] + a, b - a))
                held.clear()

        for rows in batches:
            for s, key, content, b, d, h, start, windows in zip(*(rows.column(i).to_pylist() for i in range(8)), strict=True):
                if content is None:
                    out.append((b, d, h, start, windows))
                    continue
                if s != shard:
                    settle()
                    shard, family = s, Shard()
                held.append((key, content, b, d, h, start))
                if len(held) >= BATCH:
                    settle()
            if len(out) >= 20000:
                yield from table_of(list(zip(*out, strict=True)), SPANS).to_batches()
                out.clear()
        settle()
        if out:
            yield from table_of(list(zip(*out, strict=True)), SPANS).to_batches()

    marks = recurring(texts, buckets, ByteTexts, hot)
    routed = texts.groupBy("_b").cogroup(marks.groupBy("_b")).applyInArrow(first_of_batch, ROUTED)
    return routed.repartition(n, "shard").sortWithinPartitions("shard", "_d", "_h", "start").mapInArrow(scan, SPANS)


def _spans_of(bucket, spans) -> list:
    """The spans of each row of a bucket."""
    found: dict[tuple[int, int], list] = {}
    for d, h, start, windows in zip(*(spans.column(c).to_pylist() for c in ("_d", "_h", "start", "windows")), strict=True):
        found.setdefault((d, h), []).append((start, start + windows))
    return [found.get(key) for key in zip(bucket.column("_d").to_pylist(), bucket.column("_h").to_pylist(), strict=True)]


def _may_repeat():
    """Texts as long as a match. All others, above all null and empty ones, stay where they are, so they are no group of any task."""
    return F.coalesce(F.octet_length("text") >= WIDTH, F.lit(False))


def report(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts, buckets = deal(rows.filter(_may_repeat()))
    spans = repeated_spans(texts, buckets, hot)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(bucket, spans):
        import hashlib

        import numpy as np

        rows = []
        for doc_id, text, own in zip(bucket.column("doc_id").to_pylist(), bucket.column("text").to_pylist(), _spans_of(bucket, spans), strict=True):
            data = (text or "").encode("utf-8")
            kept, removed, n = data, 0, 0
            if own:
                mask, n = covered(own, WIDTH, len(data))
                kept, removed = np.frombuffer(data, np.uint8)[~mask].tobytes(), int(mask.sum())
            rows.append((doc_id, len(data), removed, n, hashlib.sha256(kept).hexdigest()))
        return table_of(list(zip(*rows, strict=True)) or [[]] * 5, schema)

    text, none = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    short = rows.filter(~_may_repeat()).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    return texts.groupBy("_b").cogroup(spans.groupBy("_b")).applyInArrow(run, schema).unionByName(short)


def remove_repeats(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """The rows of ``docs`` without repeated strings in ``text``; ``n_chars``, where there is one, follows."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select("doc_id", "text", row.alias("_row"))
    texts, buckets = deal(rows.filter(_may_repeat()))
    spans = repeated_spans(texts, buckets, hot)

    def run(bucket, spans):
        import numpy as np
        import pyarrow as pa

        texts = []
        for text, own in zip(bucket.column("text").to_pylist(), _spans_of(bucket, spans), strict=True):
            if own:
                data = np.frombuffer(text.encode("utf-8"), np.uint8)
                mask, _ = covered(own, WIDTH, len(data))
                text = data[~mask].tobytes().decode("utf-8", "ignore")
            texts.append(text)
        return pa.table([pa.array(texts, pa.string()), bucket.column("_row")], names=["text", "_row"])

    out = texts.groupBy("_b").cogroup(spans.groupBy("_b")).applyInArrow(run, texts.select("text", "_row").schema)
    out = out.unionByName(rows.filter(~_may_repeat()).select("text", "_row"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns])
