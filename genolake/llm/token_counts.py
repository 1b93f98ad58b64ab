"""Token counts: offset-mapped attribution of tokens to sections.

A document is one field or several, joined by line feeds, and is encoded once, as a whole. The tokenizer is byte-level and lossless,
so the running sum of token lengths gives each token's place; in characters it reaches from the one that holds its first byte to the
one that holds its last. Sections are character spans too: here the lines of each field, each with the line feed that
ends it. Tokens and sections, both in order, are joined as intervals. A token that crosses a boundary is allocated by the rule:

- ``start``: whole, to the section that holds its first character (default);
- ``majority``: whole, to the section that holds most of its characters, the first of equals;
- ``proportional``: in parts, by characters.

In each rule a document's sections sum to its number of tokens.

Defined results: null fields count as empty; an empty field has one empty section, and a document of one empty field no token. Repeated rows are
counted one by one. A null id is returned as it is. Empty tables give empty results. A long text is encoded whole.
Columns other than the fields are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.llm.tokens import rank_encoder, tokenizer_path

RULES = ("start", "majority", "proportional")
SCHEMA = "doc_id long, field string, section int, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long"


def field_sections(fields: list[str]) -> tuple[str, list[int], list[int]]:
    """(document, bounds of its sections in characters, number of the field of each section)."""
    bounds, owner, at = [0], [], 0
    for k, text in enumerate(fields):
        lines = text.split("\n")
        if len(lines) > 1 and not lines[-1] and k == len(fields) - 1:
            lines.pop()  # the last line feed ends a line and begins none
            ends = [len(x) + 1 for x in lines]
        else:
            ends = [len(x) + 1 for x in lines]
            ends[-1] -= k == len(fields) - 1
        for size in ends:
            at += size
            bounds.append(at)
            owner.append(k)
    return "\n".join(fields), bounds, owner


def token_spans(text: str, token_bytes):
    """First character of each token, and the one after its last."""
    import numpy as np

    ends = np.cumsum(np.asarray(token_bytes, dtype=np.int64))
    starts = ends - token_bytes
    if text.isascii():
        return starts, ends
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def attribute(starts, ends, bounds, rule: str = "start"):
    """Tokens per section and crossing tokens per section (counted where the token starts)."""
    import numpy as np

    bounds = np.asarray(bounds, dtype=np.int64)
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, np.asarray(ends) - 1, side="right") - 1
    cross = np.flatnonzero(first != last)
    crossing = np.bincount(first[cross], minlength=n)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), crossing
    counts = np.bincount(np.delete(first, cross), minlength=n).astype(float)
    for t in cross.tolist():
        inside = np.arange(first[t], last[t] + 1)
        parts = np.minimum(bounds[inside + 1], ends[t]) - np.maximum(bounds[inside], starts[t])
        if rule == "majority":
            counts[inside[int(np.argmax(parts))]] += 1
        else:
            counts[inside] += parts / parts.sum()
    return counts, crossing


def count_tokens(docs: DataFrame, rule: str = "start", tokenizer: str | None = None, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """One row per document, field and section; ``section`` counts from 0 in each document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not fields:
        raise ValueError("at least one field is needed")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoding, lengths = rank_encoder(tokenizer or tokenizer_path("byte_bpe_50k.tiktoken"))
        types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            cols: list[list] = [[] for _ in types]
            for doc_id, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, bounds, owner = field_sections([v or "" for v in values])
                tokens = lengths[np.asarray(encoding.encode_ordinary(text), dtype=np.int64)]
                counts, crossing = attribute(*token_spans(text, tokens), bounds, rule)
                n = len(owner)
                for col, found in zip(cols, ([doc_id] * n, [fields[k] for k in owner], range(n), bounds[:-1], bounds[1:], counts.tolist(), crossing.tolist(), [len(tokens)] * n), strict=True):
                    col.extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    columns = [F.col(f"`{f}`").cast("string").alias(f"f{k}") for k, f in enumerate(fields)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).mapInArrow(run, SCHEMA)
