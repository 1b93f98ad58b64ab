"""SimHash near-dedup: fuzzy hashing of fingerprints with the Golay code.

A fingerprint's bit is 1 where it is set in more than half of the XXH64 values of the text's shingles, repeats included. Distinct
fingerprints are the nodes; two are linked at ``MOST`` = 4 or fewer differing bits.

The binary Golay code has 4,096 codewords of 23 bits, and every word is within three bits of exactly one of
them, whose number is the word's index. A fingerprint is cut into four segments of 16 bits, which are words of the code with seven zeros.
Two words with at most two differing bits have a word within one bit of both, so the indices of all words within one bit of a
segment (one to six numbers, its near indices) meet those of the other. For words that differ in one bit it is
enough that each posts its own index and the larger ones of its near indices: if the two own indices differ, both post the larger.

Pigeonhole: if two fingerprints differ in at most four bits, one of these holds, and gives them a common key:

- two segments agree: key (both segments), six keys a fingerprint;
- one segment agrees and the others, none of which agrees, differ in at most two bits each: key (that segment, a near index of the next one);
- no segment agrees, so each differs in exactly one bit: key (indices of the first three segments).

Fingerprints are joined on these keys and verified by counting bits. Under a key, groups grow from a first
fingerprint by all that are linked with a member, and only these tree edges leave, fewer than there are fingerprints. Keys are counted
in ``CELLS`` cells first: those of a crowded cell are dealt out as pairs of blocks of about ``BLOCK`` fingerprints, so no
task compares more than two blocks at once. Every pair under a key still meets.

Defined results: null, empty and blank texts have the fingerprint zero, which is linked like any other. Texts with fewer than four words are
one shingle. Repeated rows and rows that share an id are judged by their texts. A null id is ordered after all others; a
component of null ids alone has a null component_id. Empty tables give empty results. Long texts are read whole. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.llm.components import connected_components
from genolake.operators.skew import hand_back
from genolake.session import checkpoint, partitions

SHINGLE = 4
MOST = 4
SEED = 42
#: Cells in which keys are counted, and fingerprints under one key that one task compares with each other.
CELLS = 1 << 16
BLOCK = 20_000
#: Shingles whose bits are counted at once.
STRETCH = 1 << 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_code: dict = {}


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_LOWER).split()  # bytes.split cuts at the six ASCII blanks alone


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    import numpy as np
    import xxhash

    words = _words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    ends = ends[-n:].tolist()
    counts = np.zeros(64, np.int64)
    view = memoryview(joined)
    for k in range(0, n, STRETCH):
        hashes = [xxhash.xxh64_intdigest(view[a:b], SEED) for a, b in zip(starts[k : k + STRETCH], ends[k : k + STRETCH], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def golay_indices():
    """The index of each 23-bit word's codeword: 12 data bits over the remainder by x^11 + x^9 + x^7 + x^6 + x^5 + x + 1."""
    import numpy as np

    words = np.arange(4096, dtype=np.int64) << 11
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (0b101011100011 << (bit - 11)), rest)
    codewords = words | rest
    index = np.full(1 << 23, -1, dtype=np.int16)
    flips = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    flips += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    for flip in flips:
        index[codewords ^ flip] = np.arange(4096)
    return index


def segment_tables():
    """For each 16-bit segment: its near indices and the indices it posts for one error, each as an array padded with -1."""
    import numpy as np

    if not _code:
        index = golay_indices()
        segments = np.arange(1 << 16)
        own = index[segments][:, None]
        around = index[segments[:, None] ^ (1 << np.arange(16))[None, :]]
        near = np.sort(np.concatenate([own, around], axis=1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = -np.sort(-near, axis=1)[:, :6]
        one = np.where(near >= own, near, -1)
        one = -np.sort(-one, axis=1)
        _code["near"], _code["one"] = near.astype(np.int64), one.astype(np.int64)
    return _code["near"], _code["one"]


def keys_of(prints):
    """(row, key) of all keys of an array of fingerprints (unsigned 64 bits). A key's top bits tell its kind."""
    import numpy as np

    near, one = segment_tables()
    prints = np.asarray(prints, dtype=np.uint64)
    seg = [((prints >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    rows, keys, kind, every = [], [], 0, np.arange(len(prints))
    for i in range(4):
        for j in range(i):
            rows.append(every)
            keys.append(kind << 40 | seg[i] << 16 | seg[j])
            kind += 1
    for i in range(4):
        index = near[seg[(i + 1) % 4]]
        held = index >= 0
        rows.append(np.nonzero(held)[0])
        keys.append((kind << 40 | seg[i][:, None] << 12 | index)[held])
        kind += 1
    a, b, c = (one[seg[i]] for i in range(3))
    triples = (kind << 40 | a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :]).reshape(len(prints), -1)
    held = ((a[:, :, None, None] >= 0) & (b[:, None, :, None] >= 0) & (c[:, None, None, :] >= 0)).reshape(len(prints), -1)
    rows.append(np.nonzero(held)[0])
    keys.append(triples[held])
    return np.concatenate(rows), np.concatenate(keys)


def tree_edges(prints, most: int = MOST) -> list[tuple[int, int]]:
    """Edges that join what is linked among distinct fingerprints: each is taken once, by the first group member it is linked with."""
    import numpy as np

    left, out = np.asarray(prints, dtype=np.uint64), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            met = np.bitwise_count(left ^ at) <= most
            if met.any():
                found = left[met]
                out.extend((int(at), int(x)) for x in found)
                front.extend(found)
                left = left[~met]
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (as a signed long) per row."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


def link_edges(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column ``print``) that join all linked ones to components."""
    n = partitions(prints.sparkSession)

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = np.zeros(CELLS, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                _, keys = keys_of(batch.column(0).slice(k, 2000).to_numpy(zero_copy_only=False).astype(np.uint64))
                held += np.bincount(_cell(keys), minlength=CELLS)
        full = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(held[full])], names=["cell", "n"])

    cells = prints.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # At most CELLS numbers come to the driver and go to the tasks, whatever the data.
    crowded = {r["cell"]: -(-r["n"] // block) for r in cells.filter(F.col("n") > block).collect()}

    def post(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        blocks_of = np.ones(CELLS, np.int64)
        blocks_of[list(crowded)] = list(crowded.values())
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                prints = batch.column(0).slice(k, 1000).to_numpy(zero_copy_only=False)
                rows, keys = keys_of(prints.astype(np.uint64))
                blocks = blocks_of[_cell(keys)]
                own = (prints[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
                at = np.repeat(np.arange(len(keys)), blocks)
                other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                mine = own[at]
                pair = (np.minimum(mine, other) << 32 | np.maximum(mine, other)) if crowded else other
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(pair), pa.array(prints[rows[at]])], names=["key", "blocks", "print"])

    def meet(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def linked(prints):
            edges = tree_edges(prints)
            return np.array(edges, dtype=np.uint64).astype(np.int64).reshape(-1, 2)

        rest_at, rest = None, np.zeros(0, np.int64)
        for batch in batches:
            keys, blocks, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.append(True, (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1]))
            starts = np.flatnonzero(new)
            bounds = np.append(starts, len(keys))
            found = []
            for i in np.flatnonzero((np.diff(bounds) > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)).tolist():
                here, group = (keys[bounds[i]], blocks[bounds[i]]), prints[bounds[i] : bounds[i + 1]]
                if i == 0 and here == rest_at:
                    group = np.concatenate([rest, group])
                elif i == 0 and len(rest) > 1:
                    found.append(linked(rest))
                if i == len(starts) - 1:
                    rest_at, rest = here, group  # the key may go on in the next batch
                elif len(group) > 1:
                    found.append(linked(group))
            if found and sum(map(len, found)):
                edges = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])
        if len(rest) > 1:
            edges = linked(rest)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    posts = prints.mapInArrow(post, "key long, blocks long, print long").repartition(n, "key", "blocks")
    return posts.sortWithinPartitions("key", "blocks", "print").mapInArrow(meet, "a long, b long")


def _cell(keys):
    import numpy as np

    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)


def components(docs: DataFrame, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint, component_id per row."""
    rows = checkpoint(fingerprints(docs, size))
    # Nulls are ordered after all ids: min() leaves them out and gives null for nulls alone.
    held = checkpoint(rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    roots = connected_components(link_edges(held.select("print"), block)).withColumnRenamed("node", "print")
    placed = checkpoint(held.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
    found = hand_back(placed.select("print", "root", "rows"), checkpoint(named), "root", "prints").select("print", "component_id", "rows")
    return hand_back(rows, found, "print", "rows").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def report(docs: DataFrame) -> DataFrame:
    return components(docs)
