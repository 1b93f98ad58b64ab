"""Substring dedup: automata of repeated phrases.

A window is 50 consecutive words. A word goes when a window over it also starts in a document with a smaller id.

1. Confirm. ``runs`` brings the stretches that may recur together, each bucket of documents sending a content
   once. There, windows are compared word by word: one that stands in two documents or more is confirmed, with its first document.
   Confirmed windows in a row with one first document are a passage.
2. Compile. A bucket gets back the passages that it holds in a later document, as places in one of its own texts, joins
   those that follow one another in all texts that hold them, and compiles them into its Aho-Corasick automaton. The automata are
   thus sharded as the documents are, and each holds only what can occur there.
3. Stream. All documents of the bucket pass whole through its automaton, which locates every occurrence of
   every passage; those in documents after the passage's first one are removed.

Defined results: null text has no word; texts under 50 words lose nothing. A null id is ordered after all others. Rows that
share an id never remove each other's words. Empty tables give empty results. Long texts are read whole. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.llm.runs import WordTexts, covered, deal, in_order, marked_runs, merged, recurring, table_of
from genolake.session import partitions

WIDTH = WordTexts.width
#: Contents that are compared at once; a minimiser's contents stay together.
BLOCK_BYTES = 2 << 20
HELD = "key long, content binary, _b int, _d long, _h long, start int, last long, holders long"
PASSAGES = "_b int, _d long, _h long, start int, windows int, first long, holders long"


def held_contents(bucket, marks) -> object:
    """Contents of a bucket that may recur: where its first document has each, the last document that has it, and a hash of all that do."""
    d, h, texts, _ = in_order(bucket)
    found: dict[tuple[int, bytes], list] = {}
    for key, content, i, start, _ in zip(*marked_runs(texts, marks, WordTexts), strict=True):
        if (there := found.get((key, content))) is None:
            found[key, content] = [d[i], h[i], start, d[i], 0]
        else:
            there[3] = d[i]  # texts come in the order of their ids
            there[4] = hash((there[4], i, start - there[2]))
    b = bucket.column("_b")[0].as_py() if found else 0
    return table_of(list(zip(*((k, c, b, *x) for (k, c), x in found.items()), strict=True)) or [[]] * 8, HELD)


def first_documents(contents: list[bytes], firsts: list[int]) -> list:
    """For each content, an array with the first document of each of its windows: the smallest of ``firsts`` over the contents that hold the window.

    ``contents`` are different and in the order of ``firsts``. Digests only sort the windows; words are compared.
    """
    import numpy as np

    from genolake.llm.runs import gram_hashes

    numbers: dict[bytes, int] = {}
    texts = [np.array([numbers.setdefault(w, len(numbers)) for w in c.split(b" ")], dtype=np.int64) for c in contents]
    words = np.concatenate(texts)
    size = np.array([len(t) - WIDTH + 1 for t in texts])
    begin = np.cumsum([0, *(len(t) for t in texts)])[:-1]
    text_of = np.repeat(np.arange(len(texts)), size)
    at = np.repeat(begin, size) + np.arange(len(text_of)) - np.repeat(np.cumsum(size) - size, size)
    digest = gram_hashes(words.astype(np.uint64), WIDTH)[at]
    order = np.argsort(digest, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = digest[order][1:] != digest[order][:-1]
    leader = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # of equal digests the first text
    offsets = np.arange(WIDTH)
    first = np.empty(len(order), dtype=np.int64)
    for k in range(0, len(order), 1 << 16):
        mine, lead = order[k : k + (1 << 16)], leader[k : k + (1 << 16)]
        other = mine != lead
        differ = other.copy()
        differ[other] = (words[at[mine[other]][:, None] + offsets] != words[at[lead[other]][:, None] + offsets]).any(axis=1)
        if differ.any():  # two windows with one digest: told apart by their words
            exact: dict[tuple, int] = {}
            for i in np.argsort(text_of, kind="stable").tolist():
                first[i] = exact.setdefault(tuple(words[at[i] : at[i] + WIDTH].tolist()), firsts[text_of[i]])
            break
        first[mine] = np.asarray(firsts, dtype=np.int64)[text_of[lead]]
    return np.split(first, np.cumsum(size)[:-1])


def confirmed_passages(held: DataFrame) -> DataFrame:
    """(_b, _d, _h, start, windows, first): passages that a bucket holds in a document after their first."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        groups: list = []  # (content, first document, [row]) of different contents
        keys: list = []  # number of contents of each minimiser in ``groups``
        size = 0

        def passages() -> list:
            rows = []
            order = sorted(range(len(groups)), key=lambda i: groups[i][1])
            several = [n > 1 for n in keys for _ in range(n)]
            compared = [i for i in order if several[i]]
            found = dict(zip(compared, first_documents([groups[i][0] for i in compared], [groups[i][1] for i in compared]), strict=True)) if compared else {}
            for i, (content, smallest, holders) in enumerate(groups):
                firsts = found.get(i)
                if firsts is None:
                    cuts, firsts = [0, content.count(b" ") + 2 - WIDTH], [smallest]
                else:
                    change = np.flatnonzero(np.diff(firsts)) + 1
                    cuts, firsts = [0, *change.tolist(), len(firsts)], firsts[np.append(0, change)].tolist()
                for b, d, h, start, last, who in holders:
                    for a, z, first in zip(cuts[:-1], cuts[1:], firsts, strict=True):
                        if first < last:
                            rows.append((b, d, h, start + a, z - a, first, who))
            groups.clear()
            keys.clear()
            return rows

        key, out = None, []
        for batch in batches:
            for k, content, b, d, h, start, last, who in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if k != key:
                    if size >= BLOCK_BYTES:
                        out, size = out + passages(), 0
                    key = k
                    keys.append(0)
                if keys[-1] and groups[-1][0] == content:  # rows come in the order of key, content, id
                    groups[-1][2].append((b, d, h, start, last, who))
                else:
                    groups.append((content, d, [(b, d, h, start, last, who)]))
                    keys[-1] += 1
                    size += len(content)
            if len(out) >= 20000:
                yield from table_of(list(zip(*out, strict=True)), PASSAGES).to_batches()
                out = []
        out += passages()
        if out:
            yield from table_of(list(zip(*out, strict=True)), PASSAGES).to_batches()

    dealt = held.repartition(partitions(held.sparkSession), "key").sortWithinPartitions("key", "content", "_d")
    return dealt.mapInArrow(run, PASSAGES)


def compile_automaton(passages: list[tuple[list[bytes], int]]):
    """(automaton, numbers of words): a passage's value is (its windows, its first document)."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, first in passages:
        automaton.add_word(tuple([numbers.setdefault(w, len(numbers) + 1) for w in words]), (len(words) - WIDTH + 1, first))
    automaton.make_automaton()
    return automaton, numbers


def occurrences(words: list[bytes], d: int, automaton, numbers: dict[bytes, int]) -> list[tuple[int, int]]:
    """Windows of this document that a passage of an earlier one holds, as half-open ranges."""
    get = numbers.get
    out = []
    for end, (windows, first) in automaton.iter(tuple([get(w, 0) for w in words])):
        if first < d:
            at = end - WIDTH + 2 - windows
            if out and out[-1][0] <= at <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], at + windows))
            else:
                out.append((at, at + windows))
    return out


OUT = "doc_id long, n_words long, n_removed long, kept string"


def locate(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, the words that are kept, joined by spaces, and the removed stretches of words (start, end), per row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A window of words has WIDTH bytes and the spaces between them at least. Shorter texts, above all null and empty ones, stay where they are.
    long = F.coalesce(F.octet_length("text") >= 2 * WIDTH - 1, F.lit(False))
    texts, buckets = deal(rows.filter(long))
    marks = recurring(texts, buckets, WordTexts, hot)
    held = texts.groupBy("_b").cogroup(marks.groupBy("_b")).applyInArrow(held_contents, HELD)
    passages = confirmed_passages(held)

    def stream(bucket, passages):
        from itertools import compress

        import pyarrow as pa

        d, h, texts, place = in_order(bucket)
        at = {x: i for i, x in enumerate(zip(d, h, strict=True))}
        wanted: dict[tuple[int, int, int], list] = {}
        for x, y, start, windows, first, who in zip(*(passages.column(c).to_pylist() for c in ("_d", "_h", "start", "windows", "first", "holders")), strict=True):
            wanted.setdefault((at[x, y], first, who), []).append((start, start + windows))
        split = [(t or "").encode("utf-8").split() for t in texts]
        automaton, numbers = compile_automaton([(split[i][a : b - 1 + WIDTH], first) for (i, first, _), spans in wanted.items() for a, b in merged(spans)])
        rows = []
        for words, i in zip(split, d, strict=True):
            found = occurrences(words, i, automaton, numbers) if wanted and len(words) >= WIDTH else []
            stretches, kept = [], words
            if found:
                mask, _ = covered(found, WIDTH, len(words))
                kept = list(compress(words, (~mask).tolist()))
                stretches = merged([(a, b - 1 + WIDTH) for a, b in found])
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8"), [{"start": a, "end": b} for a, b in stretches]))
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        found = pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), spans), strict=True)], names=["n_words", "n_removed", "kept", "spans"])
        return found.take(pa.array(place)).add_column(0, "doc_id", bucket.column("doc_id").cast(pa.int64()))

    found = texts.groupBy("_b").cogroup(passages.groupBy("_b")).applyInArrow(stream, f"{OUT}, spans array<struct<start: int, end: int>>")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    none = F.array().cast("array<struct<start: int, end: int>>")
    short = rows.filter(~long).withColumn("_w", words).select("doc_id", F.size("_w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join("_w", " ").alias("kept"), none.alias("spans"))
    return found.unionByName(short)


def report(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row."""
    return locate(docs, hot).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
