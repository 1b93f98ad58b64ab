"""Where fixed-length windows of texts recur: the routing that the substring operators share.

A window is ``width`` consecutive symbols (bytes, or words). Each window has a minimiser, the smallest of the
hashes of its ``gram``-symbol substrings (leftmost of equals). Equal windows have the same minimiser at
the same place, so consecutive windows with one minimiser, a *run*, can be sent to the task of that minimiser
and no pair of equal windows is missed.

Documents are dealt to buckets of about ``BUCKET_BYTES`` by a hash of the row, in one shuffle that all later steps read again:

1. ``post``: each bucket sends each of its minimisers once, with the number of different run contents that it has there.
2. ``recurring``: minimisers that occur once in the whole input end here; the others go back to the buckets that sent
   them. A minimiser with ``hot`` different contents or more (a passage that many documents hold, each
   between words of its own) is taken apart into windows: buckets send the hashes of these windows, and get back
   those that recur. What meets in one task is thus one number per bucket, never one per document.
3. ``marked_runs``: a bucket and its marks give the contents to compare: runs, or single windows of taken-apart
   runs. Hashes only route: what is equal is decided by the operators, on contents.

Row keys: ``_d`` is doc_id with null as the largest number, ``_h`` a hash of the text, so that rows that share an
id are told apart, and the same row twice is one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.session import checkpoint, partitions

HOT = 10_000
BUCKET_BYTES = 16 << 20
CHUNK_BYTES = 1 << 20
NULL_ID = (1 << 63) - 1
POSITION_BITS = 24


def _mix(h):
    import numpy as np

    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(symbols, gram: int):
    """A 64-bit hash of each ``gram`` consecutive symbols (uint64 array)."""
    import numpy as np

    cur, power, length = symbols * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019), 0x9FB21C651E98DF25, 1
    out, have, rest = None, 0, gram
    while rest:
        if rest & 1:
            if out is None:
                out, have = cur[: len(symbols) - length + 1].copy(), length
            else:
                n = len(symbols) - (have + length) + 1
                out, have = out[:n] * np.uint64(power) + cur[have : have + n], have + length
        rest >>= 1
        if rest:
            n = len(symbols) - 2 * length + 1
            cur = cur[: max(n, 0)] * np.uint64(power) + cur[length : length + max(n, 0)]
            power = (power * power + 0x94D049BB133111EB * length) % (1 << 64) | 1
            length *= 2
    return _mix(out)


def find_runs(symbols, width: int, gram: int, bounds=None):
    """(minimiser hash, first and last window start) of each run, in order.

    ``bounds`` are the places where one text ends and the next begins; windows do not cross them.
    """
    import numpy as np

    n = len(symbols) - width + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
    valid = np.ones(n, dtype=bool)
    if bounds is not None and len(bounds) > 2:
        inner = np.asarray(bounds[1:-1], dtype=np.int64)
        edge = np.zeros(n + 1, dtype=np.int32)
        np.add.at(edge, np.clip(inner - width + 1, 0, n), 1)
        np.add.at(edge, np.clip(inner, 0, n), -1)
        valid = np.cumsum(edge[:-1]) == 0
    low, most = np.uint64((1 << POSITION_BITS) - 1), 1 << (POSITION_BITS - 1)
    keys, firsts, lasts = [], [], []
    for at in range(0, n, most):  # very long texts in overlapping stretches; a run that is cut stays right as two runs
        h = gram_hashes(symbols[at : at + most + width - 1], gram)
        cur = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span, length, m = width - gram + 1, 1, min(most, n - at)
        while length * 2 <= span:
            cur = np.minimum(cur[:-length], cur[length:])
            length *= 2
        if length < span:
            cur = np.minimum(cur[:m], cur[span - length : span - length + m])
        windows = np.flatnonzero(valid[at : at + m])
        if not len(windows):
            continue
        place = (cur[windows] & low).astype(np.int64)
        cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(windows) != 1)) + 1
        first = np.concatenate([[0], cuts])
        last = np.concatenate([cuts - 1, [len(windows) - 1]])
        keys.append(h[place[first]])
        firsts.append(windows[first] + at)
        lasts.append(windows[last] + at)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (firsts, np.int64), (lasts, np.int64)))


class ByteTexts:
    """Some texts as bytes, one after the other. Of equal windows all but the first go, within a document too."""

    width, gram = 100, 32

    def __init__(self, texts: list) -> None:
        import numpy as np

        raw = [(t or "").encode("utf-8") for t in texts]
        self.data = b"".join(raw)
        self.symbols = np.frombuffer(self.data, dtype=np.uint8).astype(np.uint64)
        self.bounds = np.cumsum([0, *map(len, raw)])

    def content(self, a: int, b: int) -> bytes:
        return self.data[a:b]


_powers: dict = {}


def _power_table(n: int):
    """Powers of an odd number mod 2**64 and of its inverse, n of each at least."""
    import numpy as np

    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << n.bit_length())
        for name, base in (("up", 0xD6E8FEB86659FD93), ("down", pow(0xD6E8FEB86659FD93, -1, 1 << 64))):
            _powers[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(base))]), dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_hashes(data: bytes):
    """(a 64-bit hash, first byte) of each word (bytes between ASCII white space), by running sums over the text."""
    import numpy as np

    a = np.frombuffer(data, dtype=np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_table(len(a) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts


class WordTexts:
    """Some texts as words, one after the other. A window goes where a document with a smaller id holds it."""

    width, gram = 50, 8

    def __init__(self, texts: list) -> None:
        import numpy as np

        raw = [(t or "").encode("utf-8") for t in texts]
        data = b"\n".join(raw)
        self.words = data.split()
        self.symbols, starts = word_hashes(data)
        self.bounds = np.append(np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])), len(starts))

    def content(self, a: int, b: int) -> bytes:
        return b" ".join(self.words[a:b])


def _chunks(texts: list, kind: type) -> Iterator:
    """(number of the first text, texts as ``kind``) of stretches of about ``CHUNK_BYTES``."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_BYTES:
            yield at, kind(texts[at : i + 1])
            at, size = i + 1, 0
    if at < len(texts):
        yield at, kind(texts[at:])


def _content_hashes(symbols, first, end):
    """A hash of each stretch, by running sums; it only counts different contents and routes nothing."""
    import numpy as np

    up, down = _power_table(len(symbols) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(symbols.copy()) * up[: len(symbols)], dtype=np.uint64)])
    return (sums[end] - sums[first]) * down[first]


def deal(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with _d, _h and their bucket _b, dealt over the tasks by bucket, and the number of buckets."""
    n = partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * n, math.ceil(size / BUCKET_BYTES))
    keyed = docs.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("_h", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")))
    return keyed.withColumn("_b", F.pmod(F.xxhash64("_d", "_h"), F.lit(buckets)).cast("int")).repartition(n, "_b"), buckets


def table_of(columns: list, schema: str):
    """An Arrow table of these columns under a DDL schema of plain types."""
    import pyarrow as pa

    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def in_order(bucket) -> tuple[list, list, list, object]:
    """ids, hashes and texts of a bucket's rows in the order of (_d, _h), the same row twice once; and the rows' places there."""
    import numpy as np

    d, h = (bucket.column(c).to_numpy() for c in ("_d", "_h"))
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    place = np.empty(len(d), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return d[new].tolist(), h[new].tolist(), bucket.column("text").take(order[new]).to_pylist(), place


POSTED = "shard int, _b int, keys binary, loads binary"
MARKS = "_b int, keys binary, hot binary, windows binary"


def _posted(b: int, keys, loads, shards: int):
    """One row per shard: its keys of this bucket, each once, with their loads."""
    import numpy as np

    shard = ((keys >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)
    order = np.lexsort((keys, shard))
    keys, loads, shard = keys[order], loads[order].astype(np.int32), shard[order]
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(keys)] if len(keys) else []
    rows = [(int(shard[i]), b, keys[i:j].tobytes(), loads[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return table_of(list(zip(*rows, strict=True)) or [[]] * 4, POSTED)


def _again(posted: DataFrame, hot: int | None) -> DataFrame:
    """Marks of what occurs in two buckets, or twice in one. A load is twice the number of contents, plus one if there are several occurrences."""

    def run(shard):
        import numpy as np

        keys = [np.frombuffer(k, np.uint64) for k in shard.column("keys").to_pylist()]
        loads = np.concatenate([np.frombuffer(x, np.int32) for x in shard.column("loads").to_pylist()])
        bucket = np.repeat(shard.column("_b").to_numpy(), [len(k) for k in keys])
        keys = np.concatenate(keys)
        _, which = np.unique(keys, return_inverse=True)
        posts = np.bincount(which)
        several = np.bincount(which, weights=loads & 1) > 0
        use = ((posts > 1) | several)[which]
        warm = np.zeros(len(keys), dtype=bool) if hot is None else (np.bincount(which, weights=loads >> 1) >= hot)[which]
        keys, bucket, warm = keys[use], bucket[use], warm[use]
        order = np.argsort(bucket, kind="stable")
        keys, bucket, warm = keys[order], bucket[order], warm[order]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)] if len(keys) else []
        rows = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            k, w = keys[i:j], warm[i:j]
            rows.append((int(bucket[i]), b"", b"", k.tobytes()) if hot is None else (int(bucket[i]), k[~w].tobytes(), k[w].tobytes(), b""))
        return table_of(list(zip(*rows, strict=True)) or [[]] * 4, MARKS)

    return posted.groupBy("shard").applyInArrow(run, MARKS)


def recurring(texts: DataFrame, buckets: int, kind: type, hot: int | None = None) -> DataFrame:
    """(_b, keys, hot, windows) of dealt ``texts``: what recurs, for each bucket that holds it."""
    n = partitions(texts.sparkSession)
    shards = max(n, buckets // 8)

    def post(bucket):
        import numpy as np

        keys, contents = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for _, t in _chunks(in_order(bucket)[2], kind):
            key, first, last = find_runs(t.symbols, kind.width, kind.gram, t.bounds)
            keys.append(key)
            contents.append(_content_hashes(t.symbols, first, last + kind.width))
        keys, contents = np.concatenate(keys), np.concatenate(contents)
        order = np.lexsort((contents, keys))
        keys, contents = keys[order], contents[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        other = new.copy()
        other[1:] |= contents[1:] != contents[:-1]
        group = np.cumsum(new) - 1
        loads = np.minimum(np.bincount(group, weights=other), 1 << 29).astype(np.int32) * 2 + (np.bincount(group) > 1)
        b = bucket.column("_b")[0].as_py() if bucket.num_rows else 0
        return _posted(b, keys[new], loads, shards)

    marks = checkpoint(_again(texts.groupBy("_b").applyInArrow(post, POSTED), max(HOT, buckets) if hot is None else hot))
    if marks.filter(F.length("hot") > 0).isEmpty():
        return marks

    def post_windows(bucket, marks):
        import numpy as np

        warm = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in marks.column("hot").to_pylist())]))
        if not len(warm) or not bucket.num_rows:
            return table_of([[]] * 4, POSTED)
        found = [np.zeros(0, np.uint64)]
        for _, t in _chunks(in_order(bucket)[2], kind):
            key, first, last = find_runs(t.symbols, kind.width, kind.gram, t.bounds)
            use = np.isin(key, warm)
            if use.any():
                found.append(gram_hashes(t.symbols, kind.width)[_ranges(first[use], last[use] + 1)])
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        return _posted(bucket.column("_b")[0].as_py(), keys, 2 + (counts > 1), shards)

    windows = texts.groupBy("_b").cogroup(marks.groupBy("_b")).applyInArrow(post_windows, POSTED)
    return marks.union(_again(windows, None))


def _ranges(first, end):
    """All numbers of these half-open ranges."""
    import numpy as np

    size = end - first
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def marked_runs(texts: list, marks, kind: type) -> tuple[list, list, list, list, list]:
    """(key, content, number of the text, first window, windows) of what may recur in a bucket's texts, in their order."""
    import numpy as np

    empty = np.zeros(0, np.uint64)
    wanted, warm, windows = (np.unique(np.concatenate([empty, *(np.frombuffer(x, np.uint64) for x in marks.column(c).to_pylist())])) for c in ("keys", "hot", "windows"))
    keys, contents, owners, starts, sizes = [], [], [], [], []
    if not len(wanted) and not len(windows):
        return keys, contents, owners, starts, sizes
    for at, t in _chunks(texts, kind):
        key, first, last = find_runs(t.symbols, kind.width, kind.gram, t.bounds)
        use = np.isin(key, wanted)
        k, a, b = key[use], first[use], last[use]
        if len(windows) and (hot := np.isin(key, warm)).any():
            h = gram_hashes(t.symbols, kind.width)
            p = _ranges(first[hot], last[hot] + 1)
            p = p[np.isin(h[p], windows)]
            k, a, b = np.concatenate([k, h[p]]), np.concatenate([a, p]), np.concatenate([b, p])
            order = np.argsort(a, kind="stable")
            k, a, b = k[order], a[order], b[order]
        owner = np.searchsorted(t.bounds, a, side="right") - 1
        keys.extend(k.view(np.int64).tolist())
        contents.extend(map(t.content, a.tolist(), (b + kind.width).tolist()))
        owners.extend((owner + at).tolist())
        starts.extend((a - t.bounds[owner]).tolist())
        sizes.extend((b - a + 1).tolist())
    return keys, contents, owners, starts, sizes


def covered(spans, width: int, size: int):
    """Which of ``size`` symbols the windows [a, b) of ``spans`` cover, and how many maximal stretches that makes."""
    import numpy as np

    edge = np.zeros(size + 1, dtype=np.int32)
    for a, b in spans:
        edge[a] += 1
        edge[min(size, b - 1 + width)] -= 1
    mask = np.cumsum(edge[:-1]) > 0
    return mask, int(np.count_nonzero(np.diff(np.concatenate([[False], mask]).astype(np.int8)) == 1))


def merged(spans: list) -> list:
    """Half-open stretches in order, those that touch made one."""
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
