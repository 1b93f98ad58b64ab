"""Token, packing, piece, language, rule and archive operators."""

import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from genolake.llm import language_id, packing, piece_nbest, quality_rules, token_counts, tokens, warc

SCHEMA = "doc_id long, text string"
ODD = ["", None, "  ", "the cat sat", "É ñ ß 日本語", "a<|endoftext|>b", "line one\nline two\n\nx", "ﬁ ½ İ Σς", "x y z\x1ca", "𝔘 abc", "don't they'll", "aaaa" * 400]


def frame(spark, texts, start=1):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, start)], SCHEMA)


def test_word_encoder_equals_the_library():
    import pyarrow as pa

    for remembered in (1000, 2):
        e = tokens.WordEncoder(tokens.tokenizer_path("word_bpe_49k.json"), remembered)
        texts = ODD + ["the cat", "The CAT, the dog.", "H\u0331, h\u0331,", "it's, 7., x... é, …, <|ENDOFTEXT|>, <|endoftext|>,", " lead", "trail ", "a\x0b\x0cb", "cat's.", "CAT'S"]
        column = pa.array(["skipped", *texts])[1:]
        for _ in range(2):
            ids, cuts = e.encode(column)
            assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert e.encode(pa.array([], pa.string()))[1].tolist() == [0]
    assert list(tokens.slices(pa.array(["aa", None, "bbbb", "", "c"]), 3)) == [(0, 2), (2, 1), (3, 2)]


def test_words_whose_last_character_changes():
    """Every character that is longer in lower case or decomposes, before a mark: the ids are the library's."""
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("word_bpe_49k.json")
    changed = [c for c in map(chr, [*range(128, 0xD800), *range(0xE000, 0x30000)]) if len(c.lower()) > 1 or len(unicodedata.normalize("NFC", c)) > 1]
    some = [f"{w}{c}{m}" for c in changed for w in ("", "x") for m in (".", ",!")] + ["AL\u0130.", "x \u0130, y", "\u0130\u0307.", "\u0958?"]
    ids, cuts = tokens.WordEncoder(path).encode(pa.array(some))
    want = Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)
    assert "\u0130" in changed and [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [w.ids for w in want]


def test_packing_places_every_piece_once(spark):
    import numpy as np

    r = random.Random(1)
    texts = [" ".join(r.choice(["alpha", "beta", "xyz"]) for _ in range(r.randrange(0, 90))) for _ in range(150)] + ODD
    got = packing.pack(frame(spark, texts), limit=64).collect()
    e = tokens.word_encoder(tokens.tokenizer_path("word_bpe_49k.json"))
    ids = [np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
    by_doc, by_sequence = {}, {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for k, raw in enumerate(ids, 1):
        pieces = sorted(by_doc[k], key=lambda p: p.piece)
        assert [p.start for p in pieces] == list(range(0, len(raw) // 4, 64))
        assert [p.ids_crc32 for p in pieces] == [zlib.crc32(raw[4 * p.start : 4 * (p.start + p.length)]) for p in pieces]
        assert sum(p.length for p in pieces) == len(raw) // 4
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    assert len(by_sequence) <= 1.05 * packing.fewest(sum(map(len, ids)) // 4, 64)
    assert packing.pack(frame(spark, [])).count() == 0


def test_words_are_remembered_without_case_and_marks():
    """One entry for all forms of a word, bounded, with the library's ids."""
    import pyarrow as pa

    forms = ["Word word, WORD! word.", "  word;\tWord?!", None, "", "caf\u00e9, Cafe\u0301! \u0130. x\u037e; \u212b,", "<|endoftext|>. <|ENDOFTEXT|> ,.;", "\u4e2d\u6587, \u00bd. 12, it's,"]
    path = tokens.tokenizer_path("word_bpe_49k.json")
    for remembered in (1000, 12, 1):
        encoder = tokens.WordEncoder(path, remembered)
        for k in range(4):
            rows = [*forms, " ".join(f"w{k}q{i}, w0q{i}" for i in range(9))]
            ids, cuts = encoder.encode(pa.array(["left out", *rows]).slice(1))
            for row, a, b in zip(rows, cuts, cuts[1:]):
                assert ids[a:b].tolist() == encoder.tokenizer.encode(row or "", add_special_tokens=False).ids, row
    encoder = tokens.WordEncoder(path, 3)
    for text in ("Word word, WORD! word.", "word;", "other Word?"):
        encoder.encode(pa.array([text]))
    assert {"word", "other", "?"} == set(encoder.known)


def test_packing_takes_no_task_per_shuffle_partition(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "53")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = packing.pack(frame(spark, [f"text {i} of some words" for i in range(40)]), limit=64)
        assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert len({(r.sequence_id, r.offset) for r in got.collect()}) == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_packing_of_repeated_rows_null_ids_and_clashing_columns(spark):
    long = "word " * 9000
    rows = [(1, "a b", *"xyz"), (1, "a b", *"xyz"), (None, "c", *"xyz"), (None, None, *"xyz"), (5, long, *"xyz")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA + ", bucket string, length string, rank string")).collect()
    assert sorted((str(p.doc_id), p.piece, p.start, p.length) for p in got) == [("1", 0, 0, 3)] * 2 + [("5", 0, 0, 4096), ("5", 1, 4096, 4096), ("5", 2, 8192, 809), ("None", 0, 0, 1), ("None", 0, 0, 2)]
    assert len({(p.sequence_id, p.offset) for p in got}) == len(got)


def test_sum_index_is_exact():
    r = random.Random(8)
    for _ in range(60):
        counts = {r.randrange(1, 41): r.randrange(1, 4) for _ in range(r.randrange(1, 12))}
        index = packing.SumIndex(counts, 40)
        for _ in range(6):
            bag = [x for x in range(41) for _ in range(min(3, int(index.left[x])))]
            for s in range(1, 41):
                fewest = next((k for k in (1, 2, 3) if any(sum(c) == s for c in itertools.combinations(bag, k))), None)
                found = index.exact(s)
                assert (found and len(found)) == fewest and (not found or sum(found) == s)
                assert not found or all(found.count(x) <= index.left[x] for x in found)
            if bag:
                index.left[r.choice(bag)] -= 1


def test_best_fit_only_where_no_exact_sum_is_left():
    r = random.Random(9)
    counts = {r.randrange(1, 61): r.randrange(1, 9) for _ in range(25)}
    left = [x for x, n in counts.items() for _ in range(n)]
    for lengths, times in packing.plan_patterns(counts, 60):
        rest = list(left)
        rest.remove(lengths[0])
        gap = 60 - lengths[0]
        closes = any(sum(c) == gap for k in (1, 2, 3) for c in set(itertools.combinations(sorted(rest), k))) if len(rest) < 60 else None
        assert sum(lengths) == 60 or not gap or closes is not True
        for x in lengths * times:
            left.remove(x)
    assert not left


def test_plan_uses_everything():
    r = random.Random(2)
    for _ in range(30):
        counts = {r.randrange(1, 101): r.randrange(1, 30) for _ in range(r.randrange(1, 40))}
        plan = packing.plan_patterns(counts, 100)
        used = {}
        for lengths, times in plan:
            assert sum(lengths) <= 100 and times > 0
            for x in lengths:
                used[x] = used.get(x, 0) + times
        assert used == counts
    assert packing.plan_patterns({60: 5, 40: 5, 20: 10}, 100) == [((60, 40), 5), ((20, 20, 20, 20, 20), 2)]


def test_token_counts_allocate_every_token(spark):
    for rule in token_counts.RULES:
        rows = token_counts.count_tokens(frame(spark, ODD), rule).collect()
        total, declared = {}, {}
        for r in rows:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            declared[r.doc_id] = r.doc_tokens
        assert declared.keys() == set(range(1, len(ODD) + 1))
        assert all(abs(total[k] - declared[k]) < 1e-9 for k in total)
    starts, ends = [0, 3, 7], [3, 7, 10]
    counts, crossing = token_counts.attribute(starts, ends, [0, 5, 10], "start")
    assert counts.tolist() == [2, 1] and crossing.tolist() == [1, 0]
    assert token_counts.attribute(starts, ends, [0, 4, 10], "majority")[0].tolist() == [1, 2]
    assert token_counts.attribute(starts, ends, [0, 4, 10], "proportional")[0].tolist() == [1.25, 1.75]
    with pytest.raises(ValueError):
        token_counts.count_tokens(frame(spark, []), "other")


def attributed(text, bounds, rule):
    """Token by token and character by character: (tokens, crossing tokens) of each section."""
    encoding, _ = tokens.rank_encoder(tokens.tokenizer_path("byte_bpe_50k.tiktoken"))
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    section_of = [k for k in range(len(bounds) - 1) for _ in range(bounds[k], bounds[k + 1])]
    counts, crossing, at = [0.0] * (len(bounds) - 1), [0] * (len(bounds) - 1), 0
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        held = [section_of[c] for c in sorted(set(char_of[at : at + size]))]
        at += size
        crossing[held[0]] += held[0] != held[-1]
        if rule == "start":
            counts[held[0]] += 1
        elif rule == "majority":
            counts[max(sorted(set(held)), key=held.count)] += 1
        else:
            for k in held:
                counts[k] += 1 / len(held)
    return counts, crossing


def test_token_counts_equal_brute_force(spark):
    texts = ODD + ["\n\n\n", "a\n\n\n  b\n   c\n", "𝔘𝔘\n日本\n\n", "end\n", "word " * 20_000 + "\n" + "é\n" * 3000]
    titles = [f"title {i}\n\n  more" if i % 3 else None for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, u, "x") for i, (t, u) in enumerate(zip(texts, titles))] * 2, SCHEMA + ", title string, section string")
    for fields in (("text",), ("title", "text"), ("text", "title")):
        for rule in token_counts.RULES:
            rows = token_counts.count_tokens(docs, rule, fields=fields).collect()
            assert len(rows) % 2 == 0
            by_doc = {}
            for x in rows:
                by_doc.setdefault(x.doc_id, {}).setdefault(x.section, []).append(x)
            assert by_doc.keys() == set(range(len(texts)))
            for i, sections in by_doc.items():
                whole = "\n".join((texts[i] if f == "text" else titles[i]) or "" for f in fields)
                one = [sections[k][0] for k in range(len(sections))]
                assert all(len(s) == 2 and s[0] == s[1] for s in sections.values())  # the repeated rows
                bounds = [0, *(x.end_char for x in one)]
                assert bounds[-1] == len(whole) and [x.start_char for x in one] == bounds[:-1]
                assert all(whole[b - 1] == "\n" for b in bounds[1:-1]) and [x.field for x in one] == sorted((x.field for x in one), key=fields.index)
                counts, crossing = attributed(whole, bounds, rule)
                assert max(abs(x.n_tokens - c) for x, c in zip(one, counts)) < 1e-6 and [x.n_crossing for x in one] == crossing
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
    assert [x.doc_id for x in token_counts.count_tokens(docs.select(F.lit(None).cast("long").alias("doc_id"), "text").limit(1)).collect()] == [None]
    assert token_counts.field_sections(["a\nb", "", "c\n"]) == ("a\nb\n\nc\n", [0, 2, 4, 5, 7], [0, 0, 1, 2])
    assert token_counts.field_sections([""]) == ("", [0, 0], [0])


def zipf(m):
    """Independent costs: pieces in the order of the merges get the log of Zipf's law, in millionths."""
    import math

    size = m.sp.get_piece_size()
    order = [m.sp.id_to_piece(i) for i in range(size) if not (m.sp.is_control(i) or m.sp.is_unknown(i) or m.sp.is_byte(i) or m.sp.is_unused(i))]
    order.sort(key=lambda p: -m.sp.get_score(m.sp.piece_to_id(p)))
    every = math.log(sum(1 / k for k in range(1, len(order) + 1)))
    return {p: round(1e6 * (math.log(k) + every)) for k, p in enumerate(order, 1)}


def segmentations(m, costs, word):
    """Every one as (cost, lengths of its pieces from the end, ids), best first, longer last pieces first among equals."""
    other, out = max(costs.values()) + 10_000_000, []

    def go(i, cost, lengths, ids):
        if i == len(word):
            out.append((cost, [-x for x in reversed(lengths)], ids))
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in costs:
                go(j, cost + costs[word[i:j]], [*lengths, j - i], ids + m.sp.piece_to_id(word[i:j]).to_bytes(4, "little"))
            elif j == i + 1:
                raw = b"".join(m.sp.piece_to_id(f"<0x{b:02X}>").to_bytes(4, "little") for b in word[i].encode())
                go(j, cost + other, [*lengths, 1], ids + raw)

    go(0, 0, [], b"")
    return [(c, ids) for c, _, ids in sorted(out)]


def test_piece_search_equals_enumeration():
    m = piece_nbest.piece_model(tokens.tokenizer_path("piece_bpe_32k.model"))
    costs = zipf(m)
    assert {p: c for p, (_, c) in m.vocab.items()} == costs
    r = random.Random(3)
    words = ["▁the", "▁", "x", "▁日本𝔘a", "▁aaaaaaa", "▁end.,", "▁éaé!"] + ["▁" + "".join(r.choice("aeionrstéü𝔘.") for _ in range(r.randrange(1, 9))) for _ in range(60)]
    for w in words:
        whole = segmentations(m, costs, w)
        for n in (1, 2, 3, 5):
            got, then = m.search(w, n)
            assert got == whole[:n]
        got, then = m.search(w, 2, 1)
        assert got == whole[:1] and then == (whole[1][0] if len(whole) > 1 else None)
        cost, ids, dear, back = m.learn(w)
        assert (cost, ids, back) == (*whole[0], w) and dear == (whole[1][0] - cost if len(whole) > 1 else float("inf"))
    for text in ("the cat", "a b c", "tion, er x", "aa aa aa", "x"):
        parts = [segmentations(m, costs, w)[:3] for w in m.words.findall(m.sp.normalize(text))]
        every = sorted((sum(c for c, _ in x), b"".join(i for _, i in x)) for x in itertools.product(*parts))
        assert [c for c, _ in m.nbest(text, 3)] == [c for c, _ in every[:3]] and set(m.nbest(text, 3)) <= set(every)
    text = "▁it's.▁a.b,,▁x.▁▁.c\n\n▁é,é▁1.5▁日本."
    assert "".join(m.words.findall(text)) == text
    for n in (1, 3):  # the chain of links and the whole lattice have the same best segmentations
        assert m.search(text.split("\n")[0], n)[0] == m.nbest("it's. a.b,, x.  .c", n)
    tie = m.nbest("aa aa", 3)
    first = [m.search(w, 2)[0] for w in ("▁aa", "▁aa")]
    assert tie[1][1] == first[0][1][1] + first[1][0][1] and tie[2][1] == first[0][0][1] + first[1][1][1]


def test_pieces_of_long_texts_repeated_rows_and_null_ids(spark):
    r = random.Random(7)
    long = "".join(r.choice("abcdefé") for _ in range(20_000))
    rows = [(1, long, "c", "d"), (None, "a  b\n\nc", "c", "d"), (None, "a  b\n\nc", "c", "d"), (1, "x" * 3000 + " 𝔘" * 50, "c", "d")]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_pieces string, decoded_sha256 string")
    got = piece_nbest.encode_decode(docs).collect()
    assert len(got) == 4 and all(x.round_trip for x in got)
    assert all(len(set(x.nbest_crc32)) == 3 and x.nbest_scores == sorted(x.nbest_scores, reverse=True) for x in got)
    assert sorted(str(x.doc_id) for x in got) == ["1", "1", "None", "None"] and len({x.ids_crc32 for x in got}) == 3
    m = piece_nbest.piece_model(tokens.tokenizer_path("piece_bpe_32k.model"))
    assert all(m.sp.decode(m.sp.encode(t)) == piece_nbest.plain(m.decode(m.sp.encode(t))) for t in ("the cat", "a é b", long[:500]))


def test_pieces_round_trip(spark):
    rows = piece_nbest.encode_decode(frame(spark, ODD)).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(1, len(ODD) + 1))
    assert all(r.round_trip for r in rows)
    assert rows[0].n_pieces == 0 and rows[0].nbest_scores == [0.0]
    assert piece_nbest.encode_decode(frame(spark, [])).count() == 0


def test_languages_are_learned_and_mixtures_found(spark):
    r = random.Random(4)
    letters = {"aa": "abcdefg", "bb": "lmnopqr", "cc": "stuvwxy"}
    text = lambda k, n: " ".join("".join(r.choice(letters[k]) for _ in range(5)) for _ in range(n))
    rows = [(i, text(k := ["aa", "bb", "cc"][i % 3], 40), k, "s") for i in range(90)]
    rows += [(100, text("aa", 100) + " " + text("bb", 60), "aa", "s"), (101, None, "aa", "s"), (102, "12 34 !", "bb", "s"), (103, text("cc", 3), None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in language_id.report(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:90])
    assert {got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows} == {True}
    assert sorted(got[100].languages) == ["aa", "bb"] and got[100].lang_pred == "aa" and 0.5 < got[100].score < 0.75
    assert got[101].lang_pred == got[102].lang_pred == "und" and got[101].score == 0
    assert got[103].lang_pred == "cc"
    none = language_id.report(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {x.lang_pred for x in none.collect()} == {"und"}
    assert language_id.report(docs.limit(0)).count() == 0


def repeat_words(words):
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)})


def test_quality_measures(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(["the", "of", "cat", "dog", "x#"]) for _ in range(r.randrange(0, 60))) for _ in range(60)]
    texts += [None, "", "\n\n \t", "a b c d e\na b c d e\n\nf", "\x0bthe\x0cend\r\n", "é" * 5000, ("one two three four five six\n" * 300)]
    got = {x.doc_id: x for x in quality_rules.report(frame(spark, texts)).collect()}
    for i, t in enumerate(texts, 1):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat_words(words))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == expected
        base = len(words) < 10 or 100 * expected[4] > 20 * len(words)
        assert got[i].base_failed == base and (not base or not got[i].kept)
    kept = quality_rules.keep_good(frame(spark, texts))
    assert kept.columns == ["doc_id", "text"] and kept.count() == sum(x.kept for x in got.values())
    assert quality_rules.report(frame(spark, [])).count() == 0


def test_archives(spark, tmp_path):
    long = "<p>é" + "x" * 1200
    rows = [(1, "http://a/1", long), (2, "http://a b/2", long), (3, None, "short"), (4, "", "short"), (5, "http://e", None), (7, "http://g", "y\r\n\r\nWARC/1.1\r\n" * 90), (7, "http://g", "y\r\n\r\nWARC/1.1\r\n" * 90), (6, "u", "y\r\n\r\nWARC/1.1\r\n" * 90), (None, "n", long)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.report(spark, pages).collect())
    n, m = len(long.encode()), len(rows[5][2])
    assert got == [("1", n, "revisit", "2"), ("2", n, "response", "None"), ("3", 5, "response", "None"), ("4", 5, "response", "None"), ("5", 0, "response", "None"), ("6", m, "revisit", "7"), ("7", m, "response", "None"), ("7", m, "response", "None"), ("None", n, "revisit", "2")]
    assert warc.report(spark, pages.limit(0)).count() == 0


def test_foreign_archives(spark, tmp_path):
    """A member per record, plain files and contents of any bytes; ids are the same when converted again."""
    import gzip
    import hashlib
    import os

    r = random.Random(10)
    image = bytes(r.randrange(256) for _ in range(3000))
    http = lambda payload: b"HTTP/1.0 200 OK\r\nServer: \xe9\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    blocks = {"a": [image, "café".encode("latin-1") * 400, b"short"], "b": [image, b"x" * 2000], "c": [image]}
    os.makedirs(tmp_path / "arc")
    for name, payloads in blocks.items():
        records = [(f"http://{name}/{k}", "1.2.3.4", "20010203040506", http(p)) for k, p in enumerate(payloads)] + [("dns:x", "1.2.3.4", "20010203040506", b"\xff\xfe")]
        whole = warc.arc_file(1 + len(payloads) % 2, f"{name}.arc", records) + b"\n"
        if name == "b":
            (tmp_path / "arc/b.arc").write_bytes(whole)
            continue
        starts = [at for at, _, _ in warc.parse_arc(whole)] + [len(whole)]
        (tmp_path / f"arc/{name}.arc.gz").write_bytes(b"".join(gzip.compress(whole[x:y]) for x, y in zip(starts, starts[1:])))
    runs = []
    for k in range(2):
        warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / f"warc{k}"))
        got = warc.read_warc(spark, str(tmp_path / f"warc{k}")).collect()
        assert all(x.block_ok for x in got)
        runs.append(sorted((x.record_id, x.record_type, x.refers_to_id, x.payload_bytes, x.payload_digest) for x in got))
    assert runs[0] == runs[1]
    assert sorted((t, n, d) for _, t, _, n, d in runs[0]) == sorted(
        ("revisit" if p is image and name != "c" else "response", len(p), hashlib.sha1(p).hexdigest()) for name, ps in blocks.items() for p in ps
    )
    kept = next(i for i, t, _, _, d in runs[0] if t == "response" and d == hashlib.sha1(image).hexdigest())
    assert {to for _, t, to, _, _ in runs[0] if t == "revisit"} == {kept}
    assert warc.inflate(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab" and warc.inflate(b"plain") == b"plain"
    with pytest.raises(ValueError):
        warc.inflate(gzip.compress(b"a" * 100)[:-9])


def test_headers_with_bare_line_feeds(spark, tmp_path):
    """Old servers ended header lines in LF, or in both ways; a record without a blank line is all header."""
    import hashlib
    import os

    payload = b"<p>\n\nold\r\n\r\n" + b"x" * 2000
    heads = [b"HTTP/1.0 200 OK\nServer: s\nX-Page-Id: 7\n\n", b"HTTP/1.0 200 OK\r\nServer: s\n\r\n", b"HTTP/1.0 200 OK\nServer: s\r\n\n", b"HTTP/1.0 200 OK\r\nServer: s\r\n\r\n"]
    assert all(warc.split_http(h + payload) == (h, payload) for h in heads) and warc.split_http(heads[0][:-2]) == (heads[0][:-2], b"")
    assert warc.http_field(heads[0], b"X-Page-Id") == "7" and warc.http_field(heads[3], b"server") == "s"
    os.makedirs(tmp_path / "arc")
    records = [(f"http://h/{k}", "1.2.3.4", "20010203040506", h + payload) for k, h in enumerate(heads)]
    (tmp_path / "arc/a.arc").write_bytes(warc.arc_file(1, "a.arc", records))
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert sorted(x.record_type for x in got) == ["response", "revisit", "revisit", "revisit"]
    assert {(x.payload_digest) for x in got} == {hashlib.sha1(payload).hexdigest()}
    assert sum(x.payload_bytes == len(payload) for x in got) >= 1


def test_payload_longer_than_an_archive(spark):
    long = "é\n" * (3 << 20)  # 9 MB of text, over two archives' size
    pages = spark.createDataFrame([(1, "u", long), (2, "v", "short"), (3, "w", long)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.report(spark, pages).collect()}
    assert got == {1: (9 << 20, "revisit", 3), 2: (5, "response", None), 3: (9 << 20, "response", None)}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    records = [("http://x/", "1.2.3.4", "20010203040506", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\n"), ("dns:x", "1.2.3.4", "20010203040506", b"10.0.0.1\n")]
    data = warc.arc_file(version, "f.arc", records) + b"\n"
    (_, description, _), *parsed = warc.parse_arc(data)
    assert description["url"] == "filedesc://f.arc"
    assert [(f["url"], b) for _, f, b in parsed] == [(u, b) for u, _, _, b in records]
    assert all(data[o:].startswith(f["url"].encode()) for o, f, _ in parsed)
    assert warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    with pytest.raises(ValueError):
        warc.parse_arc_line(b"http://x 1.2.3.4 2001", version)
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-20]))
    line = b"http://x 1.2.3.4 20010203040506 text/html; charset=utf-8" + (b" 200 - - 0 f" if version == 2 else b"") + b" 12\n"
    assert warc.parse_arc_line(line, version)["mime"] == "text/html; charset=utf-8"


def test_language_set_may_hold_every_language():
    import numpy as np

    from genolake.llm import language_id

    seen = np.zeros((5, language_id.BUCKETS))
    for k in range(5):
        seen[k, 50 * k : 50 * k + 50] = 40
    probs = seen + language_id.SMOOTHING
    log_probs = np.log(probs / probs.sum(axis=1, keepdims=True)).astype(np.float32)
    texts = [seen[list(parts)].sum(axis=0).astype(np.int64) for parts in ([2], [0, 3], [0, 1, 2, 3], [0, 1, 2, 3, 4])]
    sets = [set(np.flatnonzero(w).tolist()) for w in language_id.infer(texts, log_probs)]
    assert sets == [{2}, {0, 3}, {0, 1, 2, 3}, {0, 1, 2, 3, 4}]


def test_mixtures_equal_those_of_one_document_at_a_time():
    """Expectation-maximisation and the choice of the set, trigram by trigram."""
    import math

    import numpy as np

    r = np.random.default_rng(5)
    langs, buckets = 4, 300
    log_probs = np.log(r.dirichlet(np.full(buckets, 0.2), langs) + 1e-6)
    log_probs = np.pad(log_probs, ((0, 0), (0, language_id.BUCKETS - buckets)), constant_values=-20).astype(np.float32)
    counts = []
    for _ in range(40):
        mix = r.dirichlet(np.full(langs, 0.3))
        grams = r.choice(buckets, size=r.integers(1, 400), p=(p := (mix @ np.exp(log_probs[:, :buckets]))) / p.sum())
        counts.append(np.bincount(grams, minlength=language_id.BUCKETS))

    def fit(c, start, steps):
        w = dict(start)
        for _ in range(steps):
            new = dict.fromkeys(w, 0.0)
            for g, k in c.items():
                part = {j: w[j] * math.exp(log_probs[j, g]) for j in w}
                for j in w:
                    new[j] += k * part[j] / sum(part.values())
            w = {j: x / sum(c.values()) for j, x in new.items()}
        return w, sum(k * math.log(sum(w[j] * math.exp(log_probs[j, g]) for j in w)) for g, k in c.items())

    got = language_id.infer(counts, log_probs)
    sizes = set()
    for c, weights in zip(counts, got):
        c = {int(g): int(c[g]) for g in np.flatnonzero(c)}
        n = sum(c.values())
        first, _ = fit(c, dict.fromkeys(range(langs), 1 / langs), language_id.FIRST_STEPS)
        order = sorted(first, key=lambda j: -first[j])
        single = {j: sum(k * float(log_probs[j, g]) for g, k in c.items()) for j in range(langs)}
        best = max(single, key=single.get)
        chosen, score = {best: 1.0}, single[best]
        for size in range(2, langs + 1):
            if first[order[size - 1]] * n < 1:
                break
            w, ll = fit(c, dict.fromkeys(order[:size], 1 / size), language_id.SET_STEPS)
            ll -= language_id.PENALTY * (size - 1) * math.log(max(n, 2))
            if ll > score:
                chosen, score = w, ll
        sizes.add(len(chosen))
        assert max(abs(chosen.get(j, 0.0) - float(weights[j])) for j in range(langs)) < 1e-3
    assert len(sizes) > 1


def test_languages_of_repeated_rows_null_ids_long_texts_and_clashing_columns(spark):
    r = random.Random(6)
    letters = {"aa": "abcdefg", "bb": "lmnopqr"}
    text = lambda k, n: " ".join("".join(r.choice(letters[k]) for _ in range(5)) for _ in range(n))
    rows = [(i, text(k := ["aa", "bb"][i % 2], 40), k, "x", "y") for i in range(40)]
    rows += [(50, text("bb", 50_000), None, "x", "y")] * 2 + [(None, text("aa", 30), None, "x", "y"), (None, "", None, "x", "y")]
    got = language_id.report(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out string")).collect()
    assert len(got) == len(rows)
    assert sorted((x.lang_pred, x.held_out) for x in got if x.doc_id is None) == [("aa", False), ("und", False)]
    assert [x.lang_pred for x in got if x.doc_id == 50] == ["bb", "bb"]
