"""Dedup operators against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re

import pytest
from genolake.llm import exact_dedup, minhash_join, phrase_dedup, runs, suffix_dedup
from genolake.llm.components import connected_components

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 8))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passages = [text(r.randrange(52, 90)) for _ in range(4)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.15 and rows:
            t = r.choice(rows)[1]
        elif kind < 0.4:
            t = text(r.randrange(5, 40)) + " " + r.choice(passages) + "\n" + text(r.randrange(5, 40))
        elif kind < 0.6 and rows:
            w = (r.choice(rows)[1] or "x").split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            t = " ".join(w)
        elif kind < 0.7:
            t = (text(9) + "\n") * r.randrange(1, 12)
        else:
            t = text(r.randrange(1, 200))
        rows.append((i * 3, t))
    return rows + [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "Two words"), (1005, "two WORDS")]


def removed_bytes(rows, width=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if (s := b[p : p + width]) in seen:
                mask[p : p + width] = b"\x01" * width
            seen.add(s)
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        spans = sum(1 for k, m in enumerate(mask) if m and (k == 0 or not mask[k - 1]))
        out[i] = (len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return out


def removed_words(rows, width=50):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        mask = bytearray(len(w))
        for p in range(len(w) - width + 1):
            if first.setdefault(tuple(w[p : p + width]), i) < i:
                mask[p : p + width] = b"\x01" * width
        kept = " ".join(x for x, m in zip(w, mask, strict=True) if not m)
        out[i] = (len(w), sum(mask), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, None), (2, None), (1, 2)])
def test_suffix_family_is_exact(spark, seed, hot):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(frame(spark, rows), hot).collect()}
    assert got == removed_bytes(rows)
    assert sum(v[1] for v in got.values()) > 0


@pytest.mark.parametrize(("seed", "hot"), [(1, None), (3, None), (1, 2)])
def test_phrase_automata_are_exact(spark, seed, hot):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_dedup.report(frame(spark, rows), hot).collect()}
    assert got == removed_words(rows)
    assert sum(v[1] for v in got.values()) > 0


def first_seen(strings):
    seen, out = set(), []
    for s in strings:
        out.append(s in seen)
        seen.add(s)
    return out


def test_dense_family_in_small_batches():
    import numpy as np

    rows = corpus(5)
    family = suffix_dedup.DenseFamily(batch=7)
    data = np.frombuffer(b"".join((t or "").encode() for _, t in rows), np.uint8)
    starts = np.arange(0, min(len(data) - 100, 4000))
    assert family.add(data, starts).tolist() == first_seen(data[s : s + 100].tobytes() for s in starts.tolist())
    sizes = [len(x) for x in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_family_levels_grow_geometrically_over_batches_of_documents():
    r = random.Random(12)
    family, came, got = suffix_dedup.SuffixFamily(), [], []
    for n in range(1, 65):
        batch = [bytes(r.choice(b"ab") for _ in range(100 + r.randrange(6))) if r.random() < 0.8 or not came else r.choice(came) for _ in range(16)]
        got += family.add(batch)
        came += batch
        sizes = [len(x) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 1 + n.bit_length()
        assert all(level == sorted(level) for level in family.levels)
        assert sum(sizes) == len(set(came))
    assert got == first_seen(came)
    assert family.add([came[0][:100], came[5] + b"x"]) == [True, False]  # a suffix that begins an older one is there already


def test_shard_settles_inner_strings():
    r = random.Random(13)
    core = bytes(r.randrange(256) for _ in range(140))
    contents = [b"x" + core, core + b"y", core[10:] + b"z", bytes(r.randrange(256) for _ in range(150)), b"x" + core]
    shard, expected, seen = suffix_dedup.Shard(), [], set()
    for i, c in enumerate(contents):
        for p in range(len(c) - 99):
            if c[p : p + 100] in seen:
                expected.append((i, p))
            seen.add(c[p : p + 100])
    for size in (1, 2, 5):
        shard = suffix_dedup.Shard()
        got = []
        for k in range(0, 5, size):
            got += [(k + i, p) for i, a, b in shard.add([7, 7, 7, 8, 7][k : k + size], contents[k : k + size]) for p in range(a, b)]
        assert sorted(got) == expected


def test_automaton_locates_every_occurrence():
    r = random.Random(14)
    words = [b"%d" % r.randrange(40) for _ in range(400)]
    passages = [(words[0:55], 3), (words[200:300], 5), (words[240:290], 9)]
    automaton, numbers = phrase_dedup.compile_automaton(passages)
    text = words[230:320] + [b"new"] + words[0:55] + words[0:55]
    found = phrase_dedup.occurrences(text, 7, automaton, numbers)
    first = {}
    for w, f in passages:
        for p in range(len(w) - 49):
            first[tuple(w[p : p + 50])] = min(f, first.get(tuple(w[p : p + 50]), 99))
    expected = {p for p in range(len(text) - 49) if first.get(tuple(text[p : p + 50]), 99) < 7}
    # The passage of documents 5 and 9 is held whole only where all its words are.
    whole = {p for w, f in passages if f < 7 for at in range(len(text) - len(w) + 1) if text[at : at + len(w)] == w for p in range(at, at + len(w) - 49)}
    assert {p for a, b in found for p in range(a, b)} == whole <= expected


def test_first_documents_compare_words(monkeypatch):
    import numpy as np

    r = random.Random(15)
    texts = [[b"%d" % r.randrange(30) for _ in range(80)] for _ in range(6)]
    texts += [texts[0][5:70], texts[1][:60] + texts[2][:60], texts[0][5:70] + [b"end"]]
    firsts = [1, 1, 4, 5, 7, 7, 8, 9, 12]
    first = {}
    for t, f in zip(texts, firsts):
        for p in range(len(t) - 49):
            first.setdefault(tuple(t[p : p + 50]), f)
    expected = [[first[tuple(t[p : p + 50])] for p in range(len(t) - 49)] for t in texts]
    run = lambda: [x.tolist() for x in phrase_dedup.first_documents([b" ".join(t) for t in texts], firsts)]
    assert run() == expected
    hashes = runs.gram_hashes
    monkeypatch.setattr(runs, "gram_hashes", lambda s, k: hashes(s, k) % np.uint64(7) if k == 50 else hashes(s, k))
    assert run() == expected  # equal digests of different windows change nothing


def test_runs_hold_every_window_once(monkeypatch):
    import numpy as np

    monkeypatch.setattr(runs, "POSITION_BITS", 8)
    symbols = np.random.default_rng(1).integers(0, 5, 1000).astype(np.uint64)
    bounds = [0, 30, 30, 45, 400, 1000]
    for b in (None, bounds):
        key, first, last = runs.find_runs(symbols, 20, 6, b)
        windows = [p for x, y in zip(first, last, strict=True) for p in range(x, y + 1)]
        assert windows == [p for p in range(981) if b is None or not any(p < c < p + 20 for c in b)]
        h = runs.gram_hashes(symbols, 6)
        for k, x, y in zip(key, first, last, strict=True):
            assert any(h[p] == k for p in range(y, x + 15))


@pytest.mark.parametrize("run", [phrase_dedup.report, suffix_dedup.report])
def test_long_texts_and_a_passage_in_every_document(spark, run, monkeypatch):
    r = random.Random(16)
    text = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    passage, long = text(70), text(30_000)
    rows = [(i, text(r.randrange(1, 90)) + " " + passage + " " + text(r.randrange(1, 90))) for i in range(60)]
    rows += [(200, long), (201, text(40) + " " + long[1000:150_000] + " " + text(5_000) + " " + long[:2000])]
    rows += [(300 + i, rows[3][1]) for i in range(40)]
    parts = text(300).split(" ")
    for i in range(40):  # stretches of one text, cut anywhere
        a = r.randrange(240)
        rows.append((400 + i, " ".join(parts[a : a + r.randrange(55, 300)])))
    for hot, n in ((None, 4), (3, 4), (None, 1)):
        monkeypatch.setattr(runs, "partitions", lambda s: n)  # noqa: B023
        got = {x.doc_id: tuple(x)[1:] for x in run(frame(spark, rows), hot).collect()}
        assert got == (removed_words if run is phrase_dedup.report else removed_bytes)(rows)


def test_repeated_rows_and_ids(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(7, passage), (7, passage), (7, passage + " x"), (None, passage), (3, "y " + passage)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed) for r in phrase_dedup.report(frame(spark, rows)).collect())
    assert got == [(-1, 60, 60), (3, 61, 0), (7, 60, 60), (7, 60, 60), (7, 61, 60)]
    assert suffix_dedup.report(frame(spark, rows)).count() == 5


@pytest.mark.parametrize("run", [phrase_dedup.report, suffix_dedup.report, suffix_dedup.remove_repeats, exact_dedup.report, exact_dedup.keep_one, minhash_join.report, minhash_join.keep_one])
def test_empty_and_clashing(spark, run):
    assert run(frame(spark, [])).count() == 0
    names = ["_d", "_h", "_spans", "_row", "_keys", "len", "run", "best", "rows", "digest", "n", "key", "start", "kept", "_n", "_k", "n_words", "_b", "shard", "spans"]
    rows = [(i, t, *[f"{i}"] * len(names)) for i, t in corpus(4, 20)]
    wide = spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in names))
    out = run(wide)
    assert out.count() > 0
    if run in (suffix_dedup.remove_repeats, exact_dedup.keep_one, minhash_join.keep_one):
        assert out.columns == wide.columns
        assert all(r["_d"] == str(r["doc_id"]) for r in out.collect())


def test_remove_repeats_keeps_the_first(spark):
    p = " ".join(f"é{i}" for i in range(90))
    rows = [(1, "one " + p), (2, p + " two"), (3, "short")]
    got = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: "one " + p, 2: " two", 3: "short"}


def test_exact_dedup(spark):
    rows = [(4, "a b"), (2, "ab"), (9, "a  b"), (1, "c"), (1, "c"), (None, "c"), (5, None), (6, "  "), (8, "D")]
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.report(frame(spark, rows)).collect())
    assert got == [("1", "1", 3, True), ("1", "1", 3, True), ("2", "9", 3, False), ("4", "9", 3, False), ("5", "6", 2, False), ("6", "6", 2, True), ("8", "8", 1, True), ("9", "9", 3, True), ("None", "1", 3, False)]
    kept = sorted(r.doc_id for r in exact_dedup.keep_one(frame(spark, rows)).collect())
    assert kept == [1, 6, 8, 9]
    for n in (1, 5, 16):
        again = exact_dedup.resolve(frame(spark, rows), n).drop("len").collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in again) == got


def test_binomial_rounds_pair_the_runs(spark):
    entries = spark.range(8).selectExpr("cast(id as int) as run", "0 as slice", "unhex('aa') as sha", "1 as n_chars_norm", "2l as second_hash", "struct(cast(-id as int) as neg_len, false as no_id, id as doc_id) as best", "1l as rows")
    for k, left in enumerate(([0, 2, 4, 6], [0, 4], [0])):
        entries = exact_dedup.exchange(entries, k, 3)
        got = {r.run: (r.best.doc_id, r.rows) for r in entries.collect()}
        assert got == {i: (i + 2 ** (k + 1) - 1, 2 ** (k + 1)) for i in left}


def test_exact_dedup_of_long_texts_and_a_hot_digest(spark):
    long = "ab c" * 100_000
    rows = [(i, "same text" if i % 3 == 0 else f"t {i}") for i in range(300)] + [(1000, long), (1001, " " + long)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.report(frame(spark, rows)).collect()}
    assert all(got[i] == ((0, 100, i == 0) if i % 3 == 0 else (i, 1, True)) for i in range(300))
    assert got[1000] == (1001, 2, False) and got[1001] == (1001, 2, True)


def components(rows, k=3, percent=85):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("seed", "block"), [(1, 1000), (2, 1000), (1, 2)])
def test_minhash_links_are_complete(spark, seed, block, monkeypatch):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = corpus(seed, 40)
    for i in range(40):  # a large group at every distance from its first text
        w = list(base)
        for _ in range(r.randrange(0, 12)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((5000 + i, " ".join(w)))
    out = minhash_join.resolve(frame(spark, rows), block=block)
    got = {x.doc_id: (x.n, x.component, x._d == x.component) for x in out.collect()}
    assert got == components(rows)


def test_minhash_recall_near_the_bound(spark):
    """Families of four texts in chains of pairs just above the bound, and partial copies at 80 %: every component is found."""
    r = random.Random(21)
    rows, low = [], 0
    for i in range(1000):
        w = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(40, 120))]
        for k in range(4):
            rows.append((10 * i + k, " ".join(w)))
            w = list(w)
            for _ in range(max(1, len(w) // 45)):  # each changed word costs three shingles
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    sets = {i: {tuple(t.split(" ")[j : j + 3]) for j in range(len(t.split(" ")) - 2)} for i, t in rows}
    similarity = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(1000):
        for a in range(10 * i, 10 * i + 4):
            for b in range(a + 1, 10 * i + 4):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low += similarity(a, b) < 0.88
                    root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.doc_id: x.component_id for x in minhash_join.report(frame(spark, rows)).collect()}
    assert low > 100 and got == {i: find(i) for i in sets}
    chains = []
    for i in range(150):  # the whole, its first 80 %, and its last 60 %, which meets the whole only through another
        w = [f"y{r.randrange(10**6)}" for _ in range(100)]
        chains += [(10**6 + 10 * i + k, " ".join(p)) for k, p in enumerate((w[41:], w, w[: 84], w[20:]))]
    got = {x.doc_id: x.component for x in minhash_join.resolve(frame(spark, chains), percent=80, shingle=5).collect()}
    assert got == {i: c for i, (_, c, _) in components(chains, 5, 80).items()}


def test_minhash_of_very_long_texts(spark, monkeypatch):
    r = random.Random(22)
    w = [f"w{r.randrange(10**5)}" for _ in range(60_000)]
    rows = [(i, " ".join([f"v{i}"] * (i + 1) + w)) for i in range(4)] + [(9, " ".join(w[:20_000]))]
    monkeypatch.setattr(minhash_join, "BLOCK_SHINGLES", 70_000)
    got = {x.doc_id: x.component_id for x in minhash_join.report(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}


def test_minhash_repeated_rows(spark):
    t = "one two three four five six seven"
    rows = [(3, t), (3, t), (3, "other words here and there now"), (None, t.upper()), (9, None), (8, "")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash_join.report(frame(spark, rows)).collect())
    assert got == [("3", 4, "3", True), ("3", 5, "3", True), ("3", 5, "3", True), ("8", 0, "8", True), ("9", 0, "9", True), ("None", 5, "3", False)]


def test_minhash_keeps_one_row_of_each_component(spark):
    r = random.Random(6)
    text = lambda k: " ".join(f"w{r.randrange(10**6)}" for _ in range(k))
    base, shared = text(90), text(90)
    near = lambda t, k: " ".join([*t.split(" ")[:-1], f"x{k}"])
    rows = [(5, base), (None, near(base, 1)), (None, near(base, 2)), (5, near(base, 3)), (7, near(base, 4))]  # one component, led by id 5
    rows += [(None, near(shared, 1)), (None, near(shared, 2))]  # one component without an id
    rows += [(None, text(k)) for k in (30, 40, 50)] + [(9, text(30)), *[(9, text(40))] * 2, (2, base[::-1]), (2, base[::-1]), (2, base[::-1].upper())]
    rows += [(None, None), (None, ""), (None, " \n"), (9, ""), (9, ""), (5, None)]
    brute = components([((10**9 if i is None else i, k), t) for k, (i, t) in enumerate(rows)])  # by row: the smallest (id, place) is the root
    leads = {}
    for (i, k), (n, top, _) in brute.items():
        leads.setdefault(top if n else (i, k), []).append((i, k))
    out = sorted((10**9 if x.doc_id is None else x.doc_id, x.text or "") for x in minhash_join.keep_one(frame(spark, rows)).collect())
    assert len(out) == len(leads) == 14
    left = list(out)
    for (i, _), members in leads.items():  # one row of each component, and of its smallest id
        may = {(j, rows[k][1] or "") for j, k in members if j == i}
        assert any(x in may for x in left)
        left.remove(next(x for x in left if x in may))
    assert not left
    marked = sorted((str(x.doc_id), x.n_shingles, x.kept) for x in minhash_join.report(frame(spark, rows)).collect())
    assert sum(x[2] for x in marked) == len(out) + 3  # equal sets under one id are marked together
    assert sum(x[2] for x in marked if x[1] == 0) == 6


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 200, 201: 200}


def test_components_of_few_edges_lie_in_few_files(spark):
    """Checkpoints of small tables have a file for each core, not one for each shuffle partition."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "53")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(50, 50), (60, None), (70, 71), (71, 70)]
        got = connected_components(spark.createDataFrame(edges, "a long, b long"))
        assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert {r.node: r.root for r in got.collect()} == {i: i // 10 * 10 for i in range(40)} | {50: 50, 70: 70, 71: 70}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
