"""MinHash near-dedup: an inverted join on signature coordinates.

A document's set holds its distinct 3-word shingles. Documents with equal sets are one class. A class's signature has
``COORDINATES`` coordinates; each is made of two minima, so two classes agree in one with the square of their
similarity. The join:

1. Every class is posted under each coordinate-value pair. Pairs that one class alone holds are dropped, and so is
   a class that is left with fewer than ``matches`` pairs: no other can agree with it in as many coordinates.
2. Prefix: of the pairs that are left, the rarest first, all but ``matches - 1`` are looked at. Two
   classes with ``matches`` agreeing coordinates meet under one of them.
3. Under a pair, collisions over all coordinates are counted, and pairs of classes with ``matches`` or more are retained. Skip: a class that a
   retained pair has joined to a group is not met again there, so a group of m classes leaves m - 1 pairs, its tree, and not all of them. The list of a
   pair with more than ``LIST`` classes is dealt out as pairs of blocks of about that size, in which all of its classes still meet.
4. Retained pairs are closed to candidate components, and the full sets of a component meet. Inside, shingles
   are indexed and intersections counted; what reaches the similarity is linked. A component of more than ``BLOCK``
   classes, or ``BLOCK_SHINGLES`` shingles, is dealt out as pairs of blocks of at most about that size.

Links are thus confirmed on full sets, and all of a component's classes are compared: signatures only decide
what meets. A pair at the similarity bound fails to agree in ``matches`` of ``COORDINATES`` with a chance of about
2 in a million; all others that are similar enough meet for certain. A test measures it on thousands of pairs near the bound.

Defined results: null text or no word gives an empty set, 0 shingles and a component of its own. Repeated rows, and
rows that share an id, are judged by their sets; a null id is ordered after all others. A component is named by its
smallest id and kept by the class of that id (of several, the one with the smallest digest): ``report`` marks all rows of
both, ``keep_one`` returns one of them. Empty tables give empty results. Long texts are read whole. Extra columns are
not read by ``report`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genolake.llm.components import connected_components
from genolake.llm.runs import NULL_ID, word_hashes
from genolake.operators.skew import hand_back
from genolake.session import checkpoint, partitions

COORDINATES = 64
LIST = 20_000
BLOCK = 1000
BLOCK_SHINGLES = 2_000_000
PERCENT = 85
SHINGLE = 3


def matches_for(percent: int) -> int:
    """Coordinates in which a pair at this similarity agrees, but for a chance of some millionths."""
    p = (percent / 100) ** 2
    return max(1, int(COORDINATES * p - 4.8 * (COORDINATES * p * (1 - p)) ** 0.5))


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_draws: dict = {}


def shingle_set(text: str | None, size: int = SHINGLE):
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import numpy as np

    w, _ = word_hashes((text or "").encode("utf-8").translate(_LOWER))
    if not len(w):
        return w
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, (0x243F6A8885A308D3 * k) % (1 << 64), dtype=np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return np.unique(h)


def signature(shingles):
    """One 32-bit value per coordinate, never 0 in its low byte."""
    import numpy as np

    if "a" not in _draws:
        rng = np.random.default_rng(20_240_229)
        _draws["a"] = rng.integers(1, 1 << 63, 2 * COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _draws["b"] = rng.integers(0, 1 << 63, 2 * COORDINATES, dtype=np.uint64)
    low = np.full(2 * COORDINATES, ~np.uint64(0))
    for k in range(0, len(shingles), 2048):
        x = shingles[k : k + 2048, None] * _draws["a"][None, :] + _draws["b"][None, :]
        low = np.minimum(low, x.min(axis=0))
    v = low[0::2] * np.uint64(0xC2B2AE3D27D4EB4F) ^ (low[1::2] * np.uint64(0x165667B19E3779F9))
    v ^= v >> np.uint64(29)
    v = (v * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    return np.where(v & np.uint64(255) == 0, v | np.uint64(1), v)


def _record_batch(cols: list, kinds: tuple, names: list[str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _placed(docs: DataFrame, *columns) -> DataFrame:
    """``columns`` with the row's place: its id as ``_d`` and the digest of its text as ``mark``, which tells rows of an id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_d"), F.unhex(F.md5("text")).alias("mark"), *columns)


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, _d, mark, n, digest of the set and signature as coordinate-value numbers, per row."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        place = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                ns, digests, signatures = [], [], []
                for text in batch.column(3).to_pylist():
                    s = shingle_set(text, size)
                    ns.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signatures.append((signature(s) | place).astype(np.int64) if len(s) else None)
                yield _record_batch([batch.column(0), batch.column(1), batch.column(2), ns, digests, signatures], kinds, ["doc_id", "_d", "mark", "n", "digest", "signature"])

    keyed = _placed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "_d", "mark", "text")
    return keyed.mapInArrow(run, "doc_id long, _d long, mark binary, n long, digest binary, signature array<long>")


def collision_tree(marks, matches: int) -> list[tuple[int, int]]:
    """Pairs of rows of ``marks`` with at least ``matches`` collisions (equal marks that are not 0) that join all rows which such pairs join."""
    import numpy as np

    left, out = np.arange(len(marks)), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            met = np.count_nonzero((marks[left] == marks[at]) & (marks[at] != 0), axis=1) >= matches
            if met.any():
                found = left[met].tolist()
                out.extend((at, x) for x in found)
                front.extend(found)
                left = left[~met]
    return out


def candidate_edges(classes: DataFrame, matches: int, most: int = LIST) -> DataFrame:
    """(a, b): pairs of classes, by ``nid``, that agree in ``matches`` coordinates; a tree of each group under a coordinate-value pair."""
    n = partitions(classes.sparkSession)
    posted = classes.select("nid", F.explode("signature").alias("pair"))
    shared = posted.groupBy("pair").agg(F.count("*").alias("df")).filter("df > 1")
    held = posted.join(shared.hint("merge"), "pair").groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("df", "pair"))).alias("pairs"))
    held = held.filter(F.size("pairs") >= matches)
    prefix = held.select("nid", F.transform("pairs", lambda p: p["pair"]).alias("pairs"), F.transform("pairs", lambda p: F.ceil(p["df"] / most)).alias("blocks"), (F.size("pairs") - (matches - 1)).alias("k"))
    kinds, names = {"pair": "long", "block": "long", "nid": "long", "mark": "binary"}, ["pair", "block", "nid", "mark"]

    def post(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for nid, held, blocks, k in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                mark = np.zeros(COORDINATES, dtype=np.uint8)
                values = np.array(held, dtype=np.int64)
                mark[values >> 32] = values & 255
                raw = mark.tobytes()
                for pair, of in zip(held[:k], blocks, strict=False):
                    mine = (nid * 0x9E3779B97F4A7C15 >> 33) % of if of > 1 else 0
                    for other in range(of):
                        for col, x in zip(cols, (pair, min(mine, other) << 32 | max(mine, other), nid, raw), strict=True):
                            col.append(x)
                if len(cols[0]) > 20000:
                    yield _record_batch(cols, types, names)
                    cols = [[], [], [], []]
            if cols[0]:
                yield _record_batch(cols, types, names)

    def meet(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def close(nids, marks):
            tree = collision_tree(marks, matches)
            return [(int(nids[i]), int(nids[j])) for i, j in tree]

        key, nids, marks = None, np.zeros(0, np.int64), np.zeros((0, COORDINATES), np.uint8)
        for batch in batches:
            pair, block, nid = (batch.column(i).to_numpy() for i in range(3))
            raw = batch.column(3)
            mark = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)
            cuts = np.append(0, np.flatnonzero((pair[1:] != pair[:-1]) | (block[1:] != block[:-1])) + 1)
            edges = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pair)], strict=True):
                here = (int(pair[a]), int(block[a]))
                if here == key:
                    nids, marks = np.append(nids, nid[a:b]), np.concatenate([marks, mark[a:b]])
                    continue
                if len(nids) > 1:
                    edges.extend(close(nids, marks))
                key, nids, marks = here, nid[a:b], mark[a:b]
            if edges:
                yield _record_batch(list(zip(*edges, strict=True)), (pa.int64(), pa.int64()), ["a", "b"])
        if len(nids) > 1 and (edges := close(nids, marks)):
            yield _record_batch(list(zip(*edges, strict=True)), (pa.int64(), pa.int64()), ["a", "b"])

    posts = prefix.mapInArrow(post, ", ".join(f"{c} {t}" for c, t in kinds.items()))
    return posts.repartition(n, "pair", "block").sortWithinPartitions("pair", "block", "nid").mapInArrow(meet, "a long, b long").distinct()


def links_inside(sets: list, left: list[bool] | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of similar sets that join them to their components: fewer than there are sets.

    With ``left``, only pairs of a set of the left and one of the right block count.
    """
    import numpy as np

    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(sets)), sizes)
    keep = df[ids] > 1
    ids, of = ids[keep], of[keep]
    order = np.argsort(ids, kind="stable")
    posts, begin = of[order], np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(df)))])
    bounds = np.searchsorted(of, np.arange(len(sets) + 1))
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    side = None if left is None else np.array(left)
    out: list[tuple[int, int]] = []
    for x in range(1, len(sets)):
        mine = ids[bounds[x] : bounds[x + 1]]
        if not len(mine):
            continue
        lengths = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(posts[at], minlength=len(sets))[:x]
        linked = common * (100 + percent) >= percent * (sizes[:x] + sizes[x])
        if side is not None:
            linked &= side[:x] != side[x]
        for y in np.flatnonzero(linked).tolist():
            if (rx := root(x)) != (ry := root(y)):
                parent[max(rx, ry)] = min(rx, ry)
                out.append((y, x))
    return out


def confirm(docs: DataFrame, members: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(a, b) digests of classes whose sets are similar. members: (_d, mark, n, digest, root) of candidate components."""
    n = partitions(docs.sparkSession)
    # Sizes are summed and handed back per slice of a component, so a large one does not meet in one task.
    sliced = members.withColumn("slice", F.pmod(F.xxhash64("digest"), F.lit(64)).cast("int"))
    held = sliced.groupBy("root", "slice").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.sum("size") / block), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = held.groupBy("root").agg(blocks.alias("blocks"), F.sum("size").alias("size")).filter("size > 1").drop("size")
    told = held.select("root", "slice").join(sizes, "root")
    wanted = sliced.join(told.hint("merge"), ["root", "slice"]).select("_d", "mark", F.col("digest").alias("want"), "root", "blocks")
    found = _placed(docs, "text").join(wanted.hint("merge"), ["_d", "mark"]).select("text", "want", "root", "blocks")

    def build(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        names, kinds = ["root", "i", "j", "left", "digest", "shingles"], (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        for batch in batches:
            rows, size = [], 0
            for text, want, root, blocks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = shingle_set(text, shingle).tobytes()
                if hashlib.blake2b(raw, digest_size=16).digest() != want:
                    continue  # another text of this id and mark
                mine = int.from_bytes(want[:4], "little") % blocks
                for other in range(blocks):
                    rows.append((root, min(mine, other), max(mine, other), mine <= other, want, raw))
                    size += len(raw)
                if size > 8 << 20:
                    yield _record_batch(list(zip(*rows, strict=True)), kinds, names)
                    rows, size = [], 0
            if rows:
                yield _record_batch(list(zip(*rows, strict=True)), kinds, names)

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key, digests, sets, sides = None, [], [], []

        def close():
            found = links_inside(sets, sides if key[1] != key[2] else None, percent) if len(sets) > 1 else []
            if found:
                yield _record_batch([[digests[x] for x, _ in found], [digests[y] for _, y in found]], (pa.binary(), pa.binary()), ["a", "b"])

        for batch in batches:
            for root, i, j, left, digest, raw in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if key != (root, i, j):
                    if key is not None:
                        yield from close()
                    key, digests, sets, sides = (root, i, j), [], [], []
                if not digests or digests[-1] != digest:
                    digests.append(digest)
                    sets.append(np.frombuffer(raw, dtype=np.uint64))
                    sides.append(left)
        if key is not None:
            yield from close()

    built = found.mapInArrow(build, "root long, i int, j int, left boolean, digest binary, shingles binary")
    dealt = built.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j", "digest")
    return dealt.mapInArrow(compare, "a binary, b binary")


def resolve(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, _d, mark, n, digest, component (as a ``_d``) and whether the component is kept by the row's class and id, per row."""
    rows = checkpoint(sketches(docs, shingle))
    first = rows.filter("n > 0").groupBy("digest").agg(F.min(F.struct("_d", "mark")).alias("at"), F.first("signature").alias("signature"), F.first("n").alias("n"), F.count("*").alias("rows"))
    classes = checkpoint(first.select("digest", "at._d", "at.mark", "n", "signature", "rows", F.xxhash64("digest").alias("nid")))
    near = connected_components(candidate_edges(classes, matches_for(percent)))
    members = classes.select("_d", "mark", "n", "digest", "nid").join(near.withColumnRenamed("node", "nid"), "nid").select("_d", "mark", "n", "digest", "root")
    linked = connected_components(confirm(docs, members, percent, shingle, block))
    grouped = classes.select("digest", "_d").join(linked.withColumnRenamed("node", "digest"), "digest")
    smallest = grouped.groupBy("root").agg(F.min(F.struct("_d", "digest")).alias("lead"))
    moved = grouped.join(smallest, "root").select("digest", "lead")
    own = checkpoint(classes.join(moved, "digest", "left").select("digest", F.coalesce("lead", F.struct("_d", "digest")).alias("lead"), "rows"))
    # A class may hold a large share of the rows; rows without a word are no class and stay where they are.
    led = hand_back(rows.filter("n > 0").drop("signature"), own, "digest", "rows").unionByName(rows.filter("n = 0").drop("signature"), allowMissingColumns=True)
    kept = F.col("lead").isNull() | (F.col("lead") == F.struct("_d", "digest"))
    return led.select("doc_id", "_d", "mark", "n", "digest", F.coalesce("lead._d", "_d").alias("component"), kept.alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row."""
    return resolve(docs).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"),
        "kept",
    )


def keep_one(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, with the columns of the input; rows without a word all stay."""
    kept = resolve(docs, percent, shingle).filter("kept and n > 0").groupBy("digest").agg(F.min(F.struct("_d", "mark")).alias("at")).select("at.*")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    won = _placed(docs.filter(worded), F.struct(*columns).alias("_row")).join(kept.hint("merge"), ["_d", "mark"])
    first = F.row_number().over(Window.partitionBy("_d", "mark").orderBy(F.xxhash64("_row")))
    one = won.withColumn("_k", first).filter("_k = 1").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return one.union(docs.filter(~worded).select(*columns))
