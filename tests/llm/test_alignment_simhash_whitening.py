"""Alignment, Golay SimHash and whitening against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from genolake.llm import simhash_golay, token_align, whitening

SCHEMA = "doc_id long, text string"
ODD = [
    None, "", " ", "  ", "\n", "x", " x", "x ", "a  b", "a\tb\n\nc", "foo  bar", "foo 　bar", "  x", "don't I'll", "¿qué  tal? ", "▁ a ▁b x▁ y",
    "<s> </s> <unk> <0x41> <|endoftext|> <|endoftext|>x", "日本語 テキスト です", "🙂 🙂🙂 é ﬁ", "\x00 \x1c a \x85 b", "1234 5678 12,5", "​ ﻿ x", "a\rb\r\nc", "x" * 3000, "é " * 50, "ab " * 700,
]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def texts(seed, n=80):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß,.-1") for _ in range(r.randrange(1, 9))) for _ in range(120)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out).split(" ")
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 150))))
    return out


# --- alignment -------------------------------------------------------------------------------------------


def whole_tokens(text, tools):
    """Ids and bytes of both cuts of a whole text, straight from the libraries."""
    a, b, code = tools
    one = a.encode(" " + text, add_special_tokens=False)
    ids_b = b.encode(text)
    bytes_a = [bytes(code[c] for c in a.id_to_token(i)) for i in one.ids]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    return one.ids, ids_b, bytes_a, bytes_b


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    assert set(token_align.byte_decoder()) == set(ByteLevel.alphabet())
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), token_align.byte_decoder()


def aligned(rows, tools):
    """The contract's result, one row per document, from all pairs of tokens."""
    held = []
    for doc_id, text in rows:
        links, groups = [], []
        full = (" " + (text or "")).encode()
        if text:
            ids_a, ids_b, bytes_a, bytes_b = whole_tokens(text, tools)
            if b"".join(bytes_a) == full == b"".join(bytes_b):
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
                first = 0
                for i, x in enumerate(ids_a):
                    while first < len(ids_b) and ends_b[first] <= starts_a[i]:
                        first += 1
                    j = first
                    while j < len(ids_b) and starts_b[j] < ends_a[i]:
                        links.append((x, ids_b[j]))
                        j += 1
                at = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    mine = [",".join(str(x) for x, e in zip(ids, ends, strict=True) if at < e <= end) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))]
                    groups.append("|".join(mine))
                    at = end
                held.append((doc_id, len(ids_a), len(ids_b), groups, links))
                continue
        held.append((doc_id, 0, 0, [], []))
    counts = Counter(p for *_, links in held for p in links)
    docs = Counter(p for *_, links in held for p in set(links))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for doc_id, n_a, n_b, groups, links in held:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest, sum(docs[p] for p in links)))
    return sorted(out, key=repr)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "doc_count_sum"]


def test_alignment_equals_brute_force(spark, tools):
    rows = list(enumerate(ODD)) + [(None, "a b a b"), (None, None), (3, "shared id"), (3, "shared id"), (3, "other")]
    rows += [(100 + i, t) for i, t in enumerate(texts(1))]
    got = sorted((tuple(r) for r in token_align.report(frame(spark, rows)).select(*ALIGNED).collect()), key=repr)
    assert got == aligned(rows, tools)


def test_stretches_equal_whole_texts(tools):
    r = random.Random(5)
    alphabet = ["a", "B", "é", " ", " ", "  ", "\n", "\t", "'s", "12", "▁", " ", "　", " ", "\x85", "¿", "日", "🙂", ".", "<s>", "\x1f", "é", "İ"]
    import pyarrow as pa

    some = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 40))) for _ in range(1500)] + [t or "" for t in ODD]
    for remembered in (200_000, 10):
        tool = token_align.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), remembered)
        for k in range(0, len(some), 300):
            part = some[k : k + 300]
            counts, pairs, bounds, groups = tool.encode(pa.array([" " + t for t in part]))
            for i, text in enumerate(part):
                ids_a, ids_b, bytes_a, bytes_b = whole_tokens(text, tools)
                sound = text and b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b)
                assert (groups[i] is not None) == bool(sound)
                if sound:
                    parts = [g.split("|") for g in groups[i].split(";")]
                    assert [int(x) for p in parts for x in p[0].split(",")] == list(ids_a) and [int(x) for p in parts for x in p[1].split(",")] == ids_b
                    assert bounds[i + 1] - bounds[i] == counts[i][3]


def test_planes_hold_multiplicities():
    r = np.random.default_rng(3)
    pairs, places = r.integers(0, 40, 60_000), r.integers(0, token_align.CHUNK, 60_000)
    pairs, places = np.append(pairs, [7] * 300 + [41] * 5), np.append(places, [9] * 300 + [0] * 5)
    known, planes = token_align.pack_planes(pairs, places)
    assert known.tolist() == sorted(set(pairs.tolist()))
    row, digit, place = token_align.spread_planes(planes)
    got = Counter()
    for i, d, p in zip(row.tolist(), digit.tolist(), place.tolist(), strict=True):
        got[int(known[i]), p] += 1 << d
    want = Counter(zip(pairs.tolist(), places.tolist(), strict=True))
    assert got == want
    docs, links = token_align.popcounts(planes)
    assert docs.tolist() == [len({p for x, p in want if x == k}) for k in known.tolist()]
    assert links.tolist() == [sum(n for (x, _), n in want.items() if x == k) for k in known.tolist()]
    empty, none = token_align.pack_planes(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert not len(empty) and not len(none)


def test_small_chunks_and_pair_table(spark, tools):
    rows = [(i, t) for i, t in enumerate(texts(2, 60))]
    encoded = token_align.index(spark.createDataFrame(rows, SCHEMA).repartition(12), chunk_links=0)  # a chunk per batch
    assert encoded.select("chunk").distinct().count() == 12
    pairs = token_align.pair_counts(encoded)
    got = sorted((tuple(r) for r in token_align.scores(encoded, pairs).select(*ALIGNED).collect()), key=repr)
    assert got == aligned(rows, tools)
    counts = pairs.toPandas().astype({"a_id": "int64"})
    assert (counts["pair"] == counts["a_id"] * token_align.B_IDS + counts["b_id"]).all() and (counts["n_links"] >= counts["n_docs"]).all()
    shown = token_align.alignments(frame(spark, rows[:3])).collect()
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in shown)


def test_packing_takes_few_bytes_a_link():
    r = np.random.default_rng(4)
    pairs, places = r.integers(0, 20_000, 1_000_000), r.integers(0, token_align.CHUNK, 1_000_000)
    tracemalloc.start()
    token_align.pack_planes(pairs, places)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(pairs)  # 104 when pairs, places and their order were arrays of their own


def test_one_index_file_a_task_and_few_result_files(spark, tools):
    rows = [(i, t) for i, t in enumerate(texts(6, 60))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        encoded = token_align.index(frame(spark, rows))
        assert len(encoded.inputFiles()) == 3
        done = token_align.scores(encoded, token_align.pair_counts(encoded))
        assert done.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert sorted((tuple(r) for r in done.select(*ALIGNED).collect()), key=repr) == aligned(rows, tools)
        none = token_align.index(frame(spark, []))
        assert token_align.scores(none, token_align.pair_counts(none)).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# --- SimHash ---------------------------------------------------------------------------------------------


def plain_fingerprint(text, size=4):
    import xxhash

    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(nodes, linked):
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(nodes))]


def simhash_brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints, lambda x, y: (x ^ y).bit_count() <= 4)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True)), key=repr)


def test_simhash_equals_brute_force(spark):
    rows = list(enumerate(ODD)) + [(None, "only null"), (None, None), (4, "Two words"), (4, "two WORDS"), (9, "x")]
    rows += [(500 - i, t) for i, t in enumerate(texts(3, 120))]
    found = simhash_golay.report(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == simhash_brute(rows)


@pytest.mark.parametrize("block", [20_000, 7])
def test_links_of_every_kind_are_found(spark, block):
    """Fingerprints in chains of up to four differing bits, in every split over the segments; crowded keys as pairs of blocks."""
    r = random.Random(8)
    prints = {0, (1 << 64) - 1}
    for _ in range(250):
        base = r.getrandbits(64)
        prints.add(base)
        for _ in range(r.randrange(1, 4)):
            for b in r.sample(range(64), r.randrange(1, 6)):
                base ^= 1 << b
            prints.add(base)
    hot = r.getrandbits(64)
    prints |= {hot ^ r.getrandbits(24) for _ in range(300)}  # two segments agree, most of them are not linked
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    from genolake.llm.components import connected_components

    edges = simhash_golay.link_edges(spark.createDataFrame([(p,) for p in signed], "print long").repartition(3), block)
    roots = {x["node"]: x["root"] for x in connected_components(edges).collect()}
    want = plain_components(prints, lambda x, y: (x ^ y).bit_count() <= 4)
    groups: dict = {}
    for p, root in zip(signed, want, strict=True):
        groups.setdefault(root, []).append(p)
    for members in groups.values():
        assert {roots.get(p, p) for p in members} == {min(members)}


def test_golay_keys_meet_by_counting():
    """Pairs of random fingerprints at distance four, for many splits of the errors, share a key; the code is perfect."""
    index = simhash_golay.golay_indices()
    assert (index >= 0).all() and (np.bincount(index) == 2048).all()
    r = np.random.default_rng(4)
    one = r.integers(0, 1 << 63, 4000, dtype=np.uint64) << np.uint64(1)
    two = one.copy()
    for i in range(len(one)):
        for b in r.choice(64, r.integers(1, 5), replace=False).tolist():
            two[i] ^= np.uint64(1 << b)
    for i in range(0, 4000, 100):  # one error in each segment
        two[i] = one[i] ^ np.uint64(sum(1 << (16 * s + int(r.integers(0, 16))) for s in range(4)))
    (ra, ka), (rb, kb) = simhash_golay.keys_of(one), simhash_golay.keys_of(two)
    met = set(zip(ra.tolist(), ka.tolist(), strict=True)) & set(zip(rb.tolist(), kb.tolist(), strict=True))
    assert {i for i, _ in met} == set(range(4000))


# --- whitening -------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def test_whitening_against_numpy(spark):
    r = np.random.default_rng(1)
    base = (r.normal(size=(300, 12)) * np.arange(1, 13)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    rows += [(1000 + i, base[7].tolist(), 1) for i in range(200)] + [(1000, base[7].tolist(), 1), (None, base[3].tolist(), None)]
    bad = [(2000, None, 0), (2001, [None] * 12, 0), (2002, [1.0] * 11 + [math.nan], 0), (2003, [1.0] * 11 + [math.inf], 0)]
    df = spark.createDataFrame(rows + bad, VECTORS).repartition(3)
    got = whitening.report(df.withColumn("n", df.label).withColumn("key", df.label)).toPandas()
    x = np.floor(1024 * np.array([v for _, v, _ in rows], dtype=np.float32).astype(float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    cov = np.cov((x - total / n).T, bias=True)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == n * 8 and set(got["n"]) == {n} and set(got["vec_id"].dropna()) == {i for i, *_ in rows if i is not None}
    deviation = {i: int(((n * v - total) ** 2).sum()) for (i, *_), v in zip(rows, x, strict=True)}
    for c in range(8):
        part = got[got["component"] == c + 1]
        z = {i: float(w) for (i, *_), w in zip(rows, (x - total / n) @ u[:, c] / np.sqrt(e[c]), strict=True)}
        mine = np.array([(m, z[i if i == i else None]) for i, m in zip(part["vec_id"], part["whitened"], strict=True)])
        sign = np.sign((mine[:, 0] * mine[:, 1]).sum())
        assert np.allclose(mine[:, 0], sign * mine[:, 1], atol=1e-9)
        assert np.allclose(part["explained"], e[c] / e.sum(), rtol=1e-9)
    assert all(deviation[i if i == i else None] == d for i, d in zip(got["vec_id"], got["deviation"], strict=True))
    assert set(got["identity_error"]) and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1


def test_weight_of_one_fits_distinct_vectors(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 3))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)] + [(100 + i, base[0].tolist(), 0) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = whitening.whiten(df, weights="one").toPandas()
    assert set(got["n"]) == {40} and len(got) == 540 * 3 and got["identity_error"].max() < 1e-9
    assert whitening.whiten(df).toPandas()["n"].max() == 540
    with pytest.raises(ValueError):
        whitening.whiten(df, weights="none")


def test_whitening_of_odd_tables(spark):
    assert whitening.report(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.report(spark.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS)).count() == 0
    same = whitening.report(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    flat = whitening.report(spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 2.0, 3.0], 0), (4, [9.0, 1.0, 3.0], 0)], VECTORS)).collect()
    assert {(r["vec_id"], r["component"], r["n"]) for r in flat} == {(i, c, 2) for i, d in ((1, 2), (2, 2), (3, 3), (4, 3)) for c in range(1, d + 1)}
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in flat)
    huge = whitening.report(spark.createDataFrame([(1, [1e30, 1.0], 0), (2, [-1e30, 2.0], 0), (3, [0.0, 5.0], 0)], VECTORS)).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge if r["vec_id"] < 3)


def test_whitening_runs_no_job_per_shuffle_partition(spark):
    """Sums and matrices reach the driver in as many partitions as they fill; lengths whose matrices have several stripes stay whole."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=300 if i % 3 else 4).tolist(), 0) for i in range(60)]
    df, sc, before = spark.createDataFrame(rows, VECTORS), spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    usual = sorted(map(str, ((r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 6)) for r in whitening.report(df).filter("component < 4").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        sc.setJobGroup("whitening-jobs", "")
        whitening.report(df).schema
        jobs = len(sc.statusTracker().getJobIdsForGroup("whitening-jobs"))
        many = sorted(map(str, ((r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 6)) for r in whitening.report(df).filter("component < 4").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 97, jobs
    assert many == usual and len(many) == 180


def test_empty_and_clashing_columns(spark):
    empty = frame(spark, [], 1)
    assert token_align.report(empty).count() == simhash_golay.report(empty).count() == 0
    rows = frame(spark, [(1, "a b c d e"), (2, "a b c d e")])
    extra = rows.selectExpr("doc_id", "text", "1 AS print", "2 AS chunk", "'x' AS kind", "3 AS place", "4 AS rows", "5 AS component_id")
    assert [tuple(r) for r in token_align.report(extra).orderBy("doc_id").collect()] == [tuple(r) for r in token_align.report(rows).orderBy("doc_id").collect()]
    assert {r["component_id"] for r in simhash_golay.report(extra).collect()} == {1}
