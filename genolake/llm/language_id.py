"""Language identification by multilingual mixture inference.

Training sums hashed character trigrams per language over all labelled training rows; the model is a table
of ``BUCKETS`` numbers per language, whatever the input. A document is a mixture: expectation-maximisation
finds the proportions of languages that explain its trigrams, then nested sets of languages (the heaviest
first, as long as the next one explains a trigram's worth of the text) are fitted again and the set with the best penalised
likelihood is selected. The prediction is the
heaviest language of that set, the score its proportion. Documents of a batch are fitted together.

Defined results: null text or text without a letter gives ``und`` with score 0, as does a model without any
language. Rows with null text or null language teach nothing; neither do rows with a null id, which count as not
held out. Repeated rows teach as often as they occur. Equal proportions go to the language first in the
alphabet. Whole texts are read, however long. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.session import partitions

BUCKETS = 1 << 15
BLOCK = 1 << 11
SMOOTHING = 0.5
FIRST_STEPS, SET_STEPS = 8, 6
#: Log-likelihood that each further language must add, per log of the number of trigrams.
PENALTY = 6.0
#: The model is a table of ``BUCKETS`` numbers per language, which the driver and every worker hold: 128 MB at this many.
MOST_LANGUAGES = 1000

_letters = None


def trigram_counts(text: str):
    """Counts of ``BUCKETS`` hashed trigrams of letters, or None without a letter."""
    global _letters
    import numpy as np

    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters[c] if len(c) else np.zeros(0, bool)
    if not letter.any():
        return None
    c = np.concatenate([[32], np.where(letter, c, 32), [32]]).astype(np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h = (h >> np.uint32(17))[c[1:-1] != 32]
    return np.bincount(h, minlength=BUCKETS)


def train(docs: DataFrame, lang_col: str = "lang"):
    """(languages, log-probabilities) from every row with a text and a language; one small matrix."""
    import numpy as np

    spark = docs.sparkSession

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (c := trigram_counts(text)) is not None:
                    if lang in held:
                        held[lang] += c
                    else:
                        held[lang] = c.astype(np.int64)
        rows = [(lang, b, c[b * BLOCK : (b + 1) * BLOCK].tobytes()) for lang, c in held.items() for b in range(BUCKETS // BLOCK)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["lang", "block", "counts"])

    def add(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            for lang, b, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c = np.frombuffer(raw, dtype=np.int64)
                held[lang, b] = held[lang, b] + c if (lang, b) in held else c
        rows = [(lang, b, c.tobytes()) for (lang, b), c in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["lang", "block", "counts"])

    schema = "lang string, block int, counts binary"
    labelled = docs.select("text", F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    rows = labelled.mapInArrow(count, schema)
    summed = rows.repartition(partitions(spark), "lang", "block").mapInArrow(add, schema).collect()  # BUCKETS numbers per language
    langs = sorted({r["lang"] for r in summed})
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model holds at most {MOST_LANGUAGES}")
    counts = np.zeros((len(langs), BUCKETS))
    for r in summed:
        counts[langs.index(r["lang"]), r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], dtype=np.int64)
    probs = counts + SMOOTHING
    return langs, np.log(probs / probs.sum(axis=1, keepdims=True)).astype(np.float32) if langs else None


def _fit(p, c, doc_of, starts, totals, weights, steps: int):
    """Expectation-maximisation for all documents at once; returns weights and log-likelihoods."""
    import numpy as np

    for _ in range(steps):
        r = p * weights[doc_of]
        s = r.sum(axis=1)
        r *= (c / s)[:, None]
        weights = np.add.reduceat(r, starts, axis=0) / totals[:, None]
    s = (p * weights[doc_of]).sum(axis=1)
    return weights, np.add.reduceat(c * np.log(s), starts)


def infer(counts: list, log_probs, penalty: float = PENALTY):
    """Weights per document over the languages of its selected set (0 outside it)."""
    import numpy as np

    n_langs = log_probs.shape[0]
    grams = [np.flatnonzero(c) for c in counts]
    sizes = np.array([len(g) for g in grams])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    g = np.concatenate(grams)
    c = np.concatenate([x[y] for x, y in zip(counts, grams, strict=True)]).astype(np.float32)
    doc_of = np.repeat(np.arange(len(counts)), sizes)
    totals = np.add.reduceat(c, starts).astype(np.float32)
    logp = log_probs.T[g]
    # Scaled by each trigram's most likely language, so that products stay in range.
    top = logp.max(axis=1)
    p = np.exp(logp - top[:, None])
    weights = np.full((len(counts), n_langs), 1.0 / n_langs, dtype=np.float32)
    weights, _ = _fit(p, c, doc_of, starts, totals, weights, FIRST_STEPS)
    order = np.argsort(-weights, axis=1, kind="stable")
    best = np.zeros_like(weights)
    single = np.add.reduceat(c[:, None] * (logp - top[:, None]), starts, axis=0)
    one = single.argmax(axis=1)
    best[np.arange(len(counts)), one] = 1
    score = single.max(axis=1)
    for size in range(2, n_langs + 1):
        share = np.take_along_axis(weights, order, axis=1)[:, size - 1]
        rows = np.flatnonzero(share * totals >= 1)
        if not len(rows):
            break
        start = np.zeros((len(rows), n_langs), dtype=np.float32)
        np.put_along_axis(start, order[rows, :size], 1.0 / size, axis=1)
        inside = np.isin(doc_of, rows)
        local = np.searchsorted(rows, doc_of[inside])
        first = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
        w, ll = _fit(p[inside], c[inside], local, first, totals[rows], start, SET_STEPS)
        ll = ll - penalty * (size - 1) * np.log(np.maximum(totals[rows], 2))
        better = ll > score[rows]
        best[rows[better]], score[rows[better]] = w[better], ll[better]
    return best


def predict(docs: DataFrame, model, keep: tuple[str, ...] = ("doc_id",), docs_at_once: int = 200) -> DataFrame:
    """lang_pred, score and the selected languages for every row, with the columns of ``keep``."""
    spark = docs.sparkSession
    langs, log_probs = model
    shared = spark.sparkContext.broadcast((langs, log_probs))
    text = docs.select(*keep, "text")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        langs, log_probs = shared.value
        for whole in batches:
            for k in range(0, max(1, whole.num_rows), docs_at_once):
                batch = whole.slice(k, docs_at_once)
                pred, score, found = ["und"] * batch.num_rows, [0.0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
                counted = [(i, c) for i, t in enumerate(batch.column(len(keep)).to_pylist()) if langs and t and (c := trigram_counts(t)) is not None]
                if counted:
                    weights = infer([c for _, c in counted], log_probs)
                    for (i, _), w in zip(counted, weights, strict=True):
                        top = int(np.argmax(w))
                        pred[i], score[i] = langs[top], min(1.0, max(0.0, float(w[top])))
                        found[i] = [langs[j] for j in np.argsort(-w, kind="stable") if w[j] > 0]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j) for j in range(len(keep))), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.list_(pa.string()))],
                    names=[*keep, "lang_pred", "score", "languages"],
                )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in text.schema.fields if f.name in keep)
    return text.mapInArrow(run, f"{fields}, lang_pred string, score double, languages array<string>")


def report(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict every row."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = train(docs.filter(fold != 2))
    marked = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    return predict(marked, model, keep=("doc_id", "held_out"))
