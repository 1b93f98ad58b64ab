"""Cross-tokenizer alignment: an inverted index from token pairs to documents, as compressed bitmaps.

A document's bytes, a space and then its text, are cut by tokenizer A (byte-level) and by tokenizer B (pieces). Offsets where
tokens of both end cut the tokens into groups; an A token and a B token are linked where their bytes overlap.

1. ``encode``: documents are encoded whole and dealt to chunks of at most ``CHUNK`` documents, in which each has a place. For
   every pair of ids a chunk holds one bitmap of its places per binary digit of the number of links there: multiplicity planes. The
   bitmaps of a chunk's batches are OR-merged before they leave. A bitmap is a list of places, or, from ``DENSE`` places on, plain bits.
2. ``pair_counts``: OR-merging a posting's planes gives the bitmap of the documents that hold the pair; popcounts of
   it, and of the planes weighed by 2**plane, add up to the pair's documents and links. Chunks hold different documents, so their bitmaps
   stand side by side and popcounts are sums.
3. ``scores``: each posting meets its pair's counts and returns them to its chunk, where the planes hand them out to the documents.

Both tokenizers work inside stretches between white space, so texts are cut before a single space that stands between
two other characters, the stretches are encoded by the libraries, and what a worker has met is remembered (``REMEMBERED``; with
the same result beyond it). Byte by byte, tokens must give the text back; a text where they do not has no tokens.

Defined results: texts null, empty, or not given back by both tokenizers' tokens have zeros and an empty digest. Strings of special
tokens inside texts are plain text. Repeated rows, and rows that share an id, are documents of their own; a null id is
returned as it is. Empty tables give empty results. Long texts are encoded whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genolake.llm.tokens import slices, tokenizer_path
from genolake.session import partitions, scratch

#: Documents of a chunk (their places fit 12 bits), and links after which a chunk is closed.
CHUNK = 4096
CHUNK_LINKS = 6_000_000
#: Links that a task of the result scores, chunk by chunk.
TASK_LINKS = 4 * CHUNK_LINKS
#: Places from which a bitmap is kept as bits; both forms then have different sizes.
DENSE = CHUNK // 16
#: Stretches that a worker remembers, and the bytes that they and their groups may take; beyond either it begins anew.
REMEMBERED = 300_000
REMEMBERED_BYTES = 64 << 20
#: B ids below this number; a pair is A id * B_IDS + B id.
B_IDS = 1 << 20

ENCODED = "kind int, chunk long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pair long, planes array<binary>"
_aligners: dict = {}


def byte_decoder() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def links_of(ends_a, ends_b):
    """(A token, B token) places of all overlaps of two cuts of the same bytes, in order, and the overlaps of each A token."""
    import numpy as np

    first = np.searchsorted(ends_b, np.append(0, ends_a[:-1]), side="right")
    count = np.searchsorted(ends_b, ends_a, side="left") - first + 1
    before = np.cumsum(count) - count
    return np.repeat(np.arange(len(ends_a)), count), np.arange(int(count.sum())) - np.repeat(before - first, count), count


def joined(values, cuts, separator: str):
    """Strings of consecutive parts of an Arrow array, up to each cut, joined."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(0, cuts)), values), separator)


class Aligner:
    """Ids, links and groups of texts by two tokenizer files, stretch by stretch."""

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED) -> None:
        import os

        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        code = byte_decoder()
        found = {i: bytes(code[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in code for c in t)}
        self.bytes_a = [found.get(i, b"") for i in range(max(found) + 1)]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.length_a, self.length_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        if len(self.bytes_b) > B_IDS:
            raise ValueError(f"tokenizer B may have at most {B_IDS} ids")
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self.number: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.held = 0
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links; -1 links where the bytes are not given back
        self.pool, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _cut(self, stretches: list[bytes]):
        """(counts, pairs, groups as strings) of stretches that are encoded as one text; None if its tokens do not give it back or cross stretches."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        raw = b"".join(stretches)
        text = raw.decode("utf-8")
        ids_a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids_b = self.b.encode(text[1:])  # B puts a space before a text
        if any(i >= len(self.bytes_a) for i in ids_a) or b"".join([self.bytes_a[i] for i in ids_a]) != raw or b"".join([self.bytes_b[i] for i in ids_b]) != raw:
            return None
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        bounds = np.cumsum([len(s) for s in stretches])
        if not np.isin(bounds, both).all():
            return None
        at_a, at_b, count = links_of(ends_a, ends_b)
        to_a, to_b, to_group = (np.searchsorted(x, bounds, side="right") for x in (ends_a, ends_b, both))
        to_link = np.append(0, np.cumsum(count))[to_a]
        counts = np.diff(np.stack([to_a, to_b, to_group, to_link], axis=1), axis=0, prepend=0)
        sides = [joined(pa.array(ids).cast(pa.string()), np.searchsorted(ends, both, side="right"), ",") for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))]
        groups = joined(pc.binary_join_element_wise(*sides, "|"), to_group, ";")
        return counts, ids_a[at_a] * B_IDS + ids_b[at_b], groups.to_pylist()

    def _learn(self, stretches: list[bytes]) -> None:
        """Encode stretches, joined to longer texts where that makes no difference: between them stands one space, with no white space beside it."""
        import numpy as np

        texts = [s.decode("utf-8") for s in stretches]
        alone = [len(t) < 2 or t[1].isspace() or t[-1].isspace() or "▁" in t for t in texts]
        plain = [s for s, odd in zip(stretches, alone, strict=True) if not odd]
        order, counts, pairs = [], [self.counts], [self.pool]
        todo = [[s] for s, odd in zip(stretches, alone, strict=True) if odd] + [plain[k : k + 2000] for k in range(0, len(plain), 2000)]
        while todo:
            some = todo.pop()
            found = self._cut(some)
            if found is None and len(some) > 1:
                todo.extend([s] for s in some)
                continue
            one_counts, one_pairs, groups = found or (np.array([[0, 0, 0, -1]], np.int64), np.zeros(0, np.int64), [""])
            order.extend(some)
            counts.append(one_counts)
            pairs.append(one_pairs)
            self.groups.extend(groups)
            self.held += sum(map(len, some)) + sum(map(len, groups)) + 8 * len(one_pairs)
        base = len(self.number)
        self.number.update(zip(order, range(base, base + len(order)), strict=True))
        self.counts, self.pool = np.concatenate(counts), np.concatenate(pairs)
        self.begin = np.append(0, np.cumsum(np.maximum(self.counts[:, 3], 0)))

    def encode(self, column):
        """(counts, pairs, bounds, groups) of an Arrow string column of texts with their leading space.

        ``counts`` has a row per text (zeros for those without tokens), the linked pairs of text i are
        ``pairs[bounds[i] : bounds[i + 1]]``, and its groups are one string, None without tokens.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(column, "").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        rows = offsets - offsets[0]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        n = len(rows) - 1
        if not len(data):
            return np.zeros((n, 4), np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64), [None] * n
        first = _cuts(data)
        first[rows[:-1][rows[:-1] < len(data)]] = True
        at = np.flatnonzero(first)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data.copy())]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.number]
        if len(self.number) + len(new) > self.remembered:
            self._forget()
            new = distinct
        if new:
            self._learn(new)
        number = np.fromiter((self.number[w] for w in distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        of_row = np.searchsorted(at, rows)  # stretches of row i are of_row[i] : of_row[i + 1]
        per = self.counts[number]
        lost = np.append(0, np.cumsum(per[:, 3] < 0))
        # A text that is a space alone came from an empty one.
        sound = (lost[of_row[1:]] == lost[of_row[:-1]]) & (np.diff(rows) > 1)
        totals = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(np.maximum(per, 0), axis=0)])
        counts = np.where(sound[:, None], totals[of_row[1:]] - totals[of_row[:-1]], 0)
        used = np.repeat(sound, np.diff(of_row))
        begin, size = self.begin[number], np.where(used, np.maximum(per[:, 3], 0), 0)
        ends = np.cumsum(size)
        pairs = self.pool[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        places = number.tolist()
        groups = [";".join([self.groups[k] for k in places[a:b]]) if ok else None for a, b, ok in zip(of_row[:-1].tolist(), of_row[1:].tolist(), sound.tolist(), strict=True)]
        if self.held > REMEMBERED_BYTES:
            self._forget()
        return counts, pairs, np.append(0, np.cumsum(counts[:, 3])), groups


def _cuts(data):
    """Where a stretch begins: at a space between two characters that are no white space of any alphabet (when in doubt, none)."""
    import numpy as np

    kind = np.zeros(256, np.uint8)
    kind[[*range(9, 14), *range(28, 33)]] = 1  # blanks
    kind[[0xC2, 0xE1, 0xE2, 0xE3]] = 2  # first bytes of other white space
    k = kind[data]
    first = data == 32
    if len(data) > 1:
        first[:-1] &= k[1:] == 0
        first[1:] &= k[:-1] != 1
    first[-1] = first[0] = False
    for back in (2, 3):
        if len(data) > back:
            first[back:] &= ~((k[:-back] == 2) & (data[back - 1 : -1] >= 0x80))
    return first


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process and pair of files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def pack_planes(pairs, places):
    """Postings of a chunk: (distinct pairs, Arrow column of their planes) of links given as pairs and places."""
    return pack_cells([pairs << 12 | places])


def pack_cells(held: list):
    """``pack_planes`` of arrays of cells, pair << 12 | place for each link. The list is emptied, and all is sorted in place: a chunk has millions of links."""
    import numpy as np
    import pyarrow as pa

    cells = np.concatenate(held)
    held.clear()
    cells.sort()
    start = np.flatnonzero(_changes(cells))
    count = np.diff(np.append(start, len(cells)))
    cells = cells[start]
    del start
    digits = int(count.max()).bit_length() if len(count) else 0
    # Pair, digit and place side by side, so that their order is that of the numbers.
    bits = [np.zeros(0, np.int64)]
    for d in range(digits):
        some = cells[count & (1 << d) > 0]
        plane = some >> 12
        plane <<= 6
        plane |= d
        plane <<= 12
        some &= 4095
        plane |= some
        bits.append(plane)
        del some, plane
    del cells, count
    line = np.concatenate(bits)
    del bits
    line.sort()
    place = (line & 4095).astype(np.uint16)
    line >>= 12
    begin = np.flatnonzero(_changes(line))
    pair, digit = line[begin] >> 6, line[begin] & 63
    found = np.diff(np.append(begin, len(line)))
    del line
    # A pair's planes stand side by side from digit 0 on; digits without a place have an empty bitmap.
    first = np.flatnonzero(_changes(pair))
    each = np.diff(np.append(first, len(pair)))
    known, base = pair[first], np.append(0, np.cumsum(digit[first + each - 1] + 1))
    plane = np.repeat(base[:-1], each) + digit
    size = np.zeros(int(base[-1]), np.int64)
    size[plane] = found
    width = np.where(size >= DENSE, CHUNK // 8, 2 * size)
    offset = np.append(0, np.cumsum(width))
    raw = np.zeros(int(offset[-1]) // 2, np.uint16)
    raw[np.repeat(size < DENSE, width // 2)] = place[np.repeat(found < DENSE, found)]
    for k in np.flatnonzero(found >= DENSE).tolist():
        full = np.zeros(CHUNK, np.uint8)
        full[place[begin[k] : begin[k] + found[k]]] = 1
        raw[offset[plane[k]] // 2 : offset[plane[k] + 1] // 2] = np.packbits(full, bitorder="little").view(np.uint16)
    planes = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(raw)])
    return known, pa.ListArray.from_arrays(pa.array(base.astype(np.int32)), planes)


def _changes(values):
    """Where a sorted array has another value than before."""
    import numpy as np

    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


def spread_planes(column):
    """(row, digit, place) of every bit that is set in an Arrow column of planes."""
    import numpy as np

    bounds = column.offsets.to_numpy()
    planes = column.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
    bounds = bounds - bounds[0]
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    digit = np.arange(len(row)) - np.repeat(bounds[:-1], np.diff(bounds))
    if not len(planes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = planes.buffers()
    offsets = np.frombuffer(offsets, np.int32)[planes.offset : planes.offset + len(planes) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    width = np.diff(offsets)
    dense = width == CHUNK // 8
    listed = np.repeat(~dense, width)
    places = data[listed].view(np.uint16).astype(np.int64)
    of_place = np.repeat(np.flatnonzero(~dense), width[~dense] // 2)
    full = np.flatnonzero(dense)
    bits = np.unpackbits(data[~listed].reshape(len(full), CHUNK // 8), axis=1, bitorder="little")
    at, more = np.nonzero(bits)
    of_place, places = np.append(of_place, full[at]), np.append(places, more)
    return row[of_place], digit[of_place], places


def popcounts(column):
    """(documents, links) of each posting: the planes OR-merged and counted, and counted by 2**digit."""
    import numpy as np

    row, digit, place = spread_planes(column)
    merged = np.zeros((len(column), CHUNK), bool)
    merged[row, place] = True
    links = np.zeros(len(column), np.int64)
    np.add.at(links, row, np.int64(1) << digit)
    return merged.sum(axis=1, dtype=np.int64), links


def encode(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, with_groups: bool = False, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """Rows of documents (kind 0) and of postings (kind 1). A chunk's number holds that of its partition, so keep the rows in a table."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        tool = aligner(tokenizer_a or tokenizer_path("byte_bpe_50k.json"), tokenizer_b or tokenizer_path("piece_bpe_32k.model"))
        names = [c.split()[0] for c in ENCODED.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.binary())]
        chunk, place, links, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def rows(n, **given):
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names=names)

        def close():
            known, planes = pack_cells(held)
            for k in range(0, len(known), 20_000):
                some = known[k : k + 20_000]
                yield rows(len(some), kind=pa.array(np.ones(len(some), np.int32)), chunk=pa.array(np.full(len(some), chunk)), pair=pa.array(some), planes=planes.slice(k, len(some)))

        for batch in batches:
            for start, size in slices(batch.column(1), 1 << 20):
                for k in range(start, start + size, CHUNK):
                    part = batch.slice(k, min(CHUNK, start + size - k))
                    n = part.num_rows
                    if place and (place + n > CHUNK or links > chunk_links):
                        yield from close()
                        chunk, place, links = chunk + 1, 0, 0
                    counts, pairs, bounds, groups = tool.encode(part.column(1))
                    places = np.arange(place, place + n)
                    held.append(pairs << 12 | np.repeat(places, np.diff(bounds)))
                    digests = ["" if g is None else hashlib.sha256(g.encode()).hexdigest() for g in groups]
                    numbers = {c: pa.array(counts[:, i].copy()) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                    shown = {"groups": pa.array(groups, pa.string())} if with_groups else {}
                    yield rows(n, kind=pa.array(np.zeros(n, np.int32)), chunk=pa.array(np.full(n, chunk)), place=pa.array(places.astype(np.int32)), doc_id=part.column(0), groups_sha256=pa.array(digests), **numbers, **shown)
                    place, links = place + n, links + len(pairs)
        if held:
            yield from close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit(" "), F.col("text")).alias("text")).mapInArrow(run, ENCODED)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """pair, a_id, b_id, n_docs, n_links and whether no pair of its B id has more links."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 4000):
                part = batch.slice(k, 4000)
                n_docs, n_links = popcounts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_docs), pa.array(n_links)], names=["pair", "n_docs", "n_links"])

    counted = encoded.filter("kind = 1").select("pair", "planes").mapInArrow(run, "pair long, n_docs long, n_links long")
    totals = counted.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    ids = totals.select("pair", F.floor(F.col("pair") / B_IDS).cast("int").alias("a_id"), F.pmod("pair", F.lit(B_IDS)).cast("int").alias("b_id"), "n_docs", "n_links")
    # A B id has at most as many pairs as A has ids.
    return ids.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b_id")))


def scores(encoded: DataFrame, pairs: DataFrame) -> DataFrame:
    """Documents with n_best, count_sum and doc_count_sum, the sums over their links of 'best' and of the pair's links and documents.

    The pairs of a shuffle partition are a small hash table, so postings are not sorted to meet them. The result takes a task and
    a file for every ``TASK_LINKS`` links, and one for each core at least, not one for each shuffle partition.
    """
    n = partitions(encoded.sparkSession)
    links = encoded.filter("kind = 0").agg(F.sum("n_links")).first()[0] or 0
    tasks = max(encoded.sparkSession.sparkContext.defaultParallelism, -(-links // TASK_LINKS))
    shown = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    postings = encoded.filter("kind = 1").select("pair", "chunk", "planes").join(pairs.select("pair", "n_docs", F.col("n_links").alias("count"), "best").hint("shuffle_hash"), "pair")
    met = postings.select("chunk", F.lit(1).alias("kind"), "planes", "n_docs", "count", F.col("best").cast("long").alias("best"))
    both = encoded.filter("kind = 0").select("chunk", "kind", "place", *shown).unionByName(met, allowMissingColumns=True)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at, lines, sums = None, [], np.zeros((CHUNK, 3), np.int64)
        for batch in batches:
            chunks, kinds = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunks)], strict=True):
                part = batch.slice(a, b - a)
                if chunks[a] != at:
                    yield from _scored(lines, sums, shown)
                    at, lines = chunks[a], []
                    sums[:] = 0
                if kinds[a] == 0:
                    lines.append(part.select(["place", *shown]))
                    continue
                for k in range(0, part.num_rows, 4000):
                    some = part.slice(k, 4000)
                    row, digit, place = spread_planes(some.column("planes"))
                    for c, name in enumerate(("best", "count", "n_docs")):
                        np.add.at(sums[:, c], place, some.column(name).to_numpy()[row] << digit)
        yield from _scored(lines, sums, shown)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long, doc_count_sum long"
    return both.repartition(n, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, schema).coalesce(tasks)


def _scored(lines: list, sums, shown: list[str]) -> Iterator:
    import pyarrow as pa

    for part in lines:
        found = sums[part.column("place").to_numpy()]
        more = [pa.array(found[:, c].copy()) for c in range(3)]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in shown), *more], names=[*shown, "n_best", "count_sum", "doc_count_sum"])


def index(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, with_groups: bool = False, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """``encode`` as a table in the shared folder."""
    path = scratch(docs.sparkSession, "alignment")
    encode(docs, tokenizer_a, tokenizer_b, with_groups, chunk_links).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(ENCODED).parquet(path)


def alignments(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """One row per document with its scores and its groups as text, ``a1,a2|b1;a3|b2,b3`` (null without tokens)."""
    encoded = index(docs, tokenizer_a, tokenizer_b, with_groups=True)
    return scores(encoded, pair_counts(encoded))


def report(docs: DataFrame) -> DataFrame:
    encoded = index(docs)
    return scores(encoded, pair_counts(encoded)).drop("groups")
