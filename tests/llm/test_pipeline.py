"""The pipeline and the registered queries over a small corpus, against brute force."""

import os
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from genolake.llm import packing, quality_rules, tokens
from genolake.llm.queries import ORACLE_SQL, QUERIES
from test_dedup import components, corpus, removed_bytes

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    stop = list(quality_rules.STOP_WORDS)
    rows = []
    for i, t in corpus(11, 80):
        w = (t or "").split(" ")
        for k in range(0, len(w), 6):  # prose: every sixth word is a frequent one
            w[k] = stop[(i + k) % len(stop)]
        rows.append((i, None if t is None else " ".join(w), "en", f"s{i % 3}", len(t or "")))
    rows += [(2000, rows[5][1], "en", "s", 1), (2001, rows[6][1] + "\n", "de", "s", 2), (2002, "&&& " * 60, "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, f"u{i}", f"<p>{i % 4}" * 300) for i in range(12)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, [float(i % 7), float(i * i % 5), 1.0]) for i in range(20)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), rows


def stays(text):
    """Whether a text passes every rule, word by word."""
    t = text or ""
    words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = len({p for x in at.values() if len(x) > 1 for i in x for p in range(i, i + 5)})
    n = len(words)
    symbols, stop = len(re.findall(r"[#*$%&|<>]", t)), sum(w.lower() in quality_rules.STOP_WORDS for w in words)
    return not (n < 10 or 100 * repeated > 20 * n or not 200 * n <= 100 * sum(map(len, words)) <= 1200 * n or 100 * symbols > 10 * n or 100 * stop < 5 * n or 100 * (len(lines) - len(set(lines))) > 40 * len(lines))


def test_stages(spark, sf_dir):
    folder, rows = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, now = docs.columns, {r[0]: r[1] for r in rows}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k == 4:
            break
        got = {r.doc_id: r.text for r in out.collect()}
        assert out.columns == columns
        if k == 0:
            now = {i: t for i, t in now.items() if stays(t)}
        elif k == 1:
            best = {}
            for i, t in sorted(now.items(), key=lambda x: (-len(x[1]), x[0])):
                best.setdefault(SPACE.sub("", t), i)
            now = {i: now[i] for i in best.values()}
        elif k == 2:
            now = {i: now[i] for i, (_, _, keep) in components(list(now.items()), 5, 80).items() if keep}
        else:
            expected = removed_bytes(list(now.items()))
            assert got.keys() == now.keys()
            assert all(len(now[i].encode()) - expected[i][1] >= len(got[i].encode()) for i in now)
            assert {i for i in now if got[i] == now[i]} == {i for i in now if expected[i][1] == 0}
            now = got
        assert got == now and 0 < len(got)
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
    e = tokens.word_encoder(tokens.tokenizer_path("word_bpe_49k.json"))
    ids = {i: np.array([*e.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID], "<u4") for i, t in now.items()}
    pieces = out.collect()
    assert {p.doc_id for p in pieces} == ids.keys() and sum(p.length for p in pieces) == sum(map(len, ids.values()))
    assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].astype("<u4").tobytes()) for p in pieces)
    whole = corpus_pipeline.run(spark, folder)
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(whole) == key(out)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_run_on_odd_tables(spark, tmp_path):
    """An empty table; and null and repeated ids, nulls in every column and names that operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _b string, digest string, kept string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    stop = list(quality_rules.STOP_WORDS)
    text = lambda k: " ".join(stop[(k + i) % len(stop)] if i % 5 == 0 else f"word{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (1, text(1)), (1, text(2)), (None, text(3)), (None, text(3)), (None, text(4)), (5, None), (6, ""), (7, text(1) + " ")]
    spark.createDataFrame([(i, t, None, None, None, "b", "d", "k") for i, t in rows], schema).write.parquet(str(tmp_path / "odd/documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted(str(p.doc_id) for p in got) == ["1", "7", "None", "None"]


def test_run_on_a_very_long_text(spark, tmp_path):
    """Two megabytes in one document go through every stage whole."""
    stop = list(quality_rules.STOP_WORDS)
    long = " ".join(stop[i // 5 % len(stop)] if i % 5 == 0 else f"w{i:x}" for i in range(300_000))
    rows = [(1, long), (2, long + "  "), (3, "short " + " ".join(stop[:12]) + " and some words of its own here")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Of the two copies the one with more characters stays.
    assert {p.doc_id for p in got} <= {2, 3} and 2 in {p.doc_id for p in got}
    ids = tokens.word_encoder(tokens.tokenizer_path("word_bpe_49k.json")).tokenizer.encode(long, add_special_tokens=False).ids
    mine = sorted((p.piece, p.start, p.length, p.ids_crc32) for p in got if p.doc_id == 2)
    whole = np.array([*ids, packing.END_ID], "<u4")
    assert mine == [(k, k * 4096, len(whole[k * 4096 : (k + 1) * 4096]), zlib.crc32(whole[k * 4096 : (k + 1) * 4096].tobytes())) for k in range(-(-len(whole) // 4096))]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query(spark, sf_dir, name):
    folder, rows = sf_dir
    got = QUERIES[name](spark, folder)
    key = next(c for c in ("page_id", "vec_id", "doc_id") if c in got.columns)
    expected = {"page_id": set(range(12)), "vec_id": set(range(20))}.get(key) or {r[0] for r in rows}
    assert {r[key] for r in got.select(key).collect()} == expected
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    got = QUERIES["op9_mixture_language_id"](spark, "/root/testdata/sf0.001").join(docs, "doc_id").filter("held_out and length(text) > 200")
    right, total = got.filter("lang = lang_pred").count(), got.count()
    assert total > 20 and right >= 0.95 * total
