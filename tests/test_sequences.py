"""Golden cases of demultiplexing and trimming, and unit cases of the DNA functions."""

import doctest

import pytest
from pyspark.sql import functions as F

from genolake.functions import dna
from genolake.operators import demultiplex as dm
from genolake.operators import trimming as tr

MOTIF = "C[AT]GC"
TAGS = [("ind1", "AAA", 0), ("ind2", "TTT", 1), ("ind3", "GGG", 2), ("ind4", "CCC", 3)]


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame(TAGS, "sample string, tag string, tag_rank int")


def reads(spark, *pairs):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs, 197391)], "read_id long, seq string, seq2 string")


def test_doctests():
    assert doctest.testmod(dna).failed == 0
    assert doctest.testmod(tr).failed == 0


def test_motifs():
    assert dna.motif_pattern("G^CWG_C") == "GC[AT]GC"
    assert [dna.motif_length(p) for p in ("AAA", "AAAC[AT]GC", "AAAC[AT]G[AT]C", "AAAC[AT][AT]GC")] == [3, 7, 8, 8]
    assert dna.expand("AAAC[AT]GC") == ["AAACAGC", "AAACTGC"]


def test_both_mates(spark, tags):
    r = reads(spark, ("TTTTCAACCTGGAGTTCCAC", "TTTGTAGCTGAGATCGGAAG"), ("AAATCAACCTGGAGTTCCAC", "ATAGTAGCTGAGATCGGAAG"))
    assert [tuple(x) for x in dm.both_start(r, tags).collect()] == [(197391, "ind2", "TCAACCTGGAGTTCCAC", "GTAGCTGAGATCGGAAG")]
    either = sorted(tuple(x) for x in dm.either_start(r, tags).collect())
    assert either == [(197391, "ind2", "TCAACCTGGAGTTCCAC", "GTAGCTGAGATCGGAAG", 2), (197392, "ind1", "TCAACCTGGAGTTCCAC", "ATAGTAGCTGAGATCGGAAG", 1)]


def test_first_mate_and_window(spark, tags):
    r = reads(spark, ("TTTTCAACCTGGAGTTCCAC", "GTAGCTGAGATCGGAAG"), ("TAAATAGCTACATHACTACAT", "CTCAGCTGGACTCGACT"))
    assert [(x.read_id, x.sample) for x in dm.first_starts(r, tags).collect()] == [(197391, "ind2")]
    assert sorted((x.read_id, x.sample) for x in dm.within(r, tags, 10).collect()) == [(197391, "ind2"), (197392, "ind1")]
    several = tags.union(spark.createDataFrame([("ind4", "AATTGGC", 4)], tags.schema))
    got = sorted((x.sample, x.clip1) for x in dm.first_starts(reads(spark, ("CCCTCAACCTGGAGTTCCAC", ""), ("AATTGGCTAGCTACATHACTACAT", "")), several).collect())
    assert got == [("ind4", "TAGCTACATHACTACAT"), ("ind4", "TCAACCTGGAGTTCCAC")]


def test_motif_after_tag(spark, tags):
    r = reads(spark, ("ATTTCAGCCCTGGAGTTCCAC", "GTAGCTGAGATCGGAAG"), ("TAAATAGCTACATHACTACAT", "CTCAGCTGGACTCGACT"))
    assert [(x.read_id, x.sample, x.clip1) for x in dm.with_motif(r, tags, MOTIF, 10).collect()] == [(197391, "ind2", "CAGCCCTGGAGTTCCAC")]


def test_tag_chimera(spark, tags):
    r = reads(spark, ("ATTTCAGCCCTGGAGTTCCAC", "GTAGCTGAGATCGGAAG"), ("TAGCTACATAACTACAT", "AAACAGCCCTGGAGTTCCAA"), ("GGTTAACC", "CCGGTTAA"), ("TTTCAGCAAAA", "AAACTGCTTTT"))
    got = {x.read_id: (x.sample, x.clip1, x.clip2) for x in dm.either_with_motif(r, tags, MOTIF, 20).collect()}
    assert got[197394] == ("chimera", "TTTCAGCAAAA", "AAACTGCTTTT") and 197393 not in got
    assert got[197392][0] == "ind1" and got[197392][2] == "CAGCCCTGGAGTTCCAA"
    assert got[197391][:2] == ("ind2", "CAGCCCTGGAGTTCCAC")


def test_substitutions(spark, tags):
    r = reads(spark, ("TATGGCC", ""), ("NTTGGCC", ""), ("TAGGGCC", ""))
    got = {x.read_id: (x.sample, x.mismatches) for x in dm.fuzzy_start(r, tags, 1).collect()}
    assert got == {197391: ("ind2", 1), 197392: ("ind2", 1)}
    window = dm.within(reads(spark, ("CCGCAAATTT", "")), spark.createDataFrame([("x", "GATA", 0)], "sample string, tag string, tag_rank int"), 10, 2)
    assert [(x.at, x.clip1) for x in window.collect()] == [(3, "ATTT")]


def test_substitutions_with_motif(spark, tags):
    """Tag and motif a base late; an N in the motif counts as a substitution."""
    r = reads(spark, ("ATTTCAGCCCTGGAGTTCCAC", "GTAGCTGAGATCGGAAG"), ("TAAATTTCTACATHACTACAT", "CTCAGCTGGACTCGACT"), ("ATTTCANCCCTGGAGTTCCAC", "GTAGCTGAGATCGGAAG"))
    got = {x.read_id: (x.sample, x.at, x.clip1) for x in dm.with_motif(r, tags, MOTIF, 10, 1).collect()}
    assert got == {197391: ("ind2", 2, "CAGCCCTGGAGTTCCAC"), 197393: ("ind2", 2, "CANCCCTGGAGTTCCAC")}
    both = {x.read_id: (x.sample, x.clip1) for x in dm.either_with_motif(r, tags, MOTIF, 10, 1).collect()}
    assert both[197391] == ("ind2", "CAGCCCTGGAGTTCCAC") and both[197393] == ("ind2", "CANCCCTGGAGTTCCAC")


def test_substitutions_in_all_methods_equal_brute_force(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    seq = lambda k: "".join(rnd.choice("ACGTNacgt") for _ in range(k))
    pairs = [(seq(rnd.randrange(0, 25)), seq(rnd.randrange(0, 25))) for _ in range(300)] + [(None, "AAACAGC"), ("", "")]
    sheet = [("a", "AAA", 0), ("b", "ACGT", 1), ("c", "TT", 2), ("a", "GGCAT", 3)]
    r, t = reads(spark, *pairs), spark.createDataFrame(sheet, "sample string, tag string, tag_rank int")

    def at(s, pattern, most, window, anchored):
        s = (s or "").upper()[:window]
        for i in range(1 if anchored else len(s)):
            if i + len(pattern) <= len(s):
                off = sum(x not in p for x, p in zip(s[i:], pattern))
                if off <= most:
                    return i, off
        return None

    for most in (0, 1, 2):
        expected = {k: {} for k in ("both", "either", "first", "window", "motif")}
        for i, (x, y) in enumerate(pairs, 197391):
            for k, window, anchored, motif in (("first", None, True, ""), ("window", 9, False, ""), ("motif", 14, False, MOTIF)):
                hits = [(h[1], rank, sample, h[0], len(tag)) for sample, tag, rank in sheet if (h := at(x, dm.pattern_classes(tag + motif), most, window, anchored))]
                if hits:
                    _, _, sample, place, n = min(hits)
                    expected[k][i] = (sample, (x or "")[place + n :])
            two = [(s, tag, rank, at(x, tag, most, None, True), at(y, tag, most, None, True)) for s, tag, rank in sheet]
            if hits := [(h1[1] + h2[1], rank, s, len(tag)) for s, tag, rank, h1, h2 in two if h1 and h2]:
                _, _, s, n = min(hits)
                expected["both"][i] = (s, x[n:], y[n:])
            if hits := [(min(h[1] for h in (h1, h2) if h), rank, s, len(tag), bool(h1), bool(h2)) for s, tag, rank, h1, h2 in two if h1 or h2]:
                _, _, s, n, h1, h2 = min(hits)
                expected["either"][i] = (s, x[n:] if h1 else x, y[n:] if h2 else y, h1 + h2)
        for many in (2_000, 1):
            monkeypatch.setattr(dm, "MANY_TAGS", many)
            assert {x.read_id: (x.sample, x.clip1, x.clip2) for x in dm.both_start(r, t, most).collect()} == expected["both"]
            assert {x.read_id: (x.sample, x.clip1) for x in dm.first_starts(r, t, most).collect()} == expected["first"]
        assert {x.read_id: (x.sample, x.clip1, x.clip2, x.n_mates) for x in dm.either_start(r, t, most).collect()} == expected["either"]
        assert {x.read_id: (x.sample, x.clip1) for x in dm.within(r, t, 9, most).collect()} == expected["window"]
        assert {x.read_id: (x.sample, x.clip1) for x in dm.with_motif(r, t, MOTIF, 14, most).collect()} == expected["motif"]
    assert dm.first_starts(r, t.limit(0)).count() == dm.either_with_motif(r, t.limit(0), MOTIF).count() == 0


def test_chimeras_routes_and_summary(spark, tags):
    r = reads(spark, ("TTTTCAACC", "TTTGTAGC"), ("AAATGCAGCC", "AAAGTAG"), ("GATC", "GATC"))
    routed = dm.route(r, dm.both_start(r, tags), dm.site_chimeras(r, "GC[AT]GC"))
    assert {x.read_id: x.destination for x in routed.collect()} == {197391: "ind2", 197392: "chimeras", 197393: "unassigned"}
    s = dm.summary(routed).first()
    assert (s.reads, s.assigned, s.unassigned, s.chimeras, s.percent_assigned) == (3, 1, 1, 1, 33.3333)
    assert dm.summary(routed.limit(0)).first().percent_assigned is None
    assert {x.ind: x.assigned for x in dm.stats_per_sample(dm.both_start(r, tags), tags).collect()} == {"ind1": 1, "ind2": 1, "ind3": 0, "ind4": 0}


def test_indistinct(spark):
    t = spark.createDataFrame([("a", "TTAC", 0), ("b", "TTAG", 1), ("b", "TTAGCTT", 2)], "sample string, tag string, tag_rank int")
    assert sorted((x.t1, x.t2) for x in dm.indistinct_tags(t, 1).collect()) == [("TTAC", "TTAG"), ("TTAC", "TTAGCTT"), ("TTAG", "TTAC")]
    assert dm.indistinct_tags(t, 0).count() == 0
    with pytest.raises(ValueError):
        dm.sheet(t, 2)


def test_trimming(spark):
    adapters = spark.createDataFrame([("adp2_rc", "TTT")], "adapter string, adp_seq string")
    r = spark.createDataFrame([(1, "GGGGGGGGGGTTT"), (2, "GGGGGGGGGGTT")], "read_id long, seq string")
    exact = tr.exact_starts(r, adapters)
    assert {x.read_id: x.start for x in exact.collect()} == {1: 10, 2: -1}
    assert {x.read_id: x.trimmed for x in tr.trim(r, exact).collect()} == {1: "G" * 10, 2: "GGGGGGGGGGTT"}
    fuzzy = tr.fuzzy_starts(r, adapters)
    assert {x.read_id: x.start for x in fuzzy.collect()} == {1: 10, 2: 10}
    assert [tr.local_starts([s], a)[0] for s, a in (("CCCCCCCCCCTT", "TTT"), ("CCCCCCCCCCCTATT", "CTATTT"), ("CCCCCCCCCCTGT", "TTT"))] == [10, 10, 10]
    assert tr.exact_starts(r, adapters.limit(0)).count() == tr.fuzzy_starts(r, adapters.limit(0)).count() == 0


def test_local_alignment_scores_are_the_best():
    """Every pair of substrings aligned with affine gaps: the start found belongs to a best alignment."""
    import functools
    import random

    rnd = random.Random(4)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(rnd.randrange(0, 9))) for _ in range(40)]

    def best_from(seq, adapter, start):
        @functools.cache
        def go(i, j, state):
            out = 0.0 if state == "m" else float("-inf")  # an alignment ends with a match
            if i < len(seq) and j < len(adapter):
                out = max(out, (5.0 if seq[i] == adapter[j] else -4.0) + go(i + 1, j + 1, "m"))
            if i < len(seq):
                out = max(out, (-0.5 if state == "i" else -9.0) + go(i + 1, j, "i"))
            if j < len(adapter):
                out = max(out, (-0.5 if state == "d" else -9.0) + go(i, j + 1, "d"))
            return out

        return max((5.0 if seq[start] == a else -4.0) + go(start + 1, k + 1, "m") for k, a in enumerate(adapter)) if start < len(seq) else 0.0

    for adapter in ("ACG", "TTAC"):
        for seq, found in zip(seqs, tr.local_starts(seqs, adapter)):
            scores = [best_from(seq, adapter, k) for k in range(len(seq))]
            top = max(scores, default=0.0)
            assert found == -1 if top <= 0 else scores[found] == top


def test_pairs_are_trimmed_by_mate(spark):
    adapters = spark.createDataFrame([("one", "TTT", "1"), ("two", "CCC", "2"), ("any", "GG", "both")], "adapter string, adp_seq string, mate string")
    r = reads(spark, ("AATTTCCC", "AATTTCCC"), ("AAGGTTT", "ACACAC"), ("ACACCC", "GGA"), ("ACAC", "ACAC"))
    pairs = tr.trim_pairs(r, adapters)
    assert {x.read_id: (x.trimmed1, x.trimmed2) for x in pairs.collect()} == {197391: ("AA", "AATTT"), 197392: ("AA", "ACACAC"), 197393: ("ACACCC", ""), 197394: ("ACAC", "ACAC")}
    assert tuple(tr.pair_counters(pairs).first()) == (4, 1, 1, 1)
    log = {(x.read_id, x.mate, x.adapter): x.start for x in tr.match_log(pairs).collect()}
    assert len(log) == 16 and log[197391, 1, "one"] == 2 and log[197391, 2, "two"] == 5 and log[197393, 2, "any"] == 0 and log[197394, 1, "any"] == -1


def test_adapter_removal_equals_brute_force(spark):
    import random

    rnd = random.Random(5)
    adapter = "ACGTTGCA"
    seqs = ["".join(rnd.choice("ACGT") for _ in range(rnd.randrange(0, 12))) for _ in range(25)]
    for _ in range(25):
        part = list(adapter[: rnd.randrange(2, 9)])
        for _ in range(rnd.randrange(0, 2)):
            k = rnd.randrange(len(part))
            part[k] = rnd.choice(["", "A", "C", part[k] + "T"])
        seqs.append("".join(rnd.choice("ACGT") for _ in range(rnd.randrange(0, 6))) + "".join(part) + rnd.choice(["", "", "GAT"]))

    def distance(a, b, indels):
        if not indels:
            return sum(x != y for x, y in zip(a, b)) if len(a) == len(b) else 99
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
        return row[-1]

    for indels in (True, False):
        expected = []
        for s in seqs:
            found = [(-i, e, a) for i in range(3, 9) for a in range(len(s) + 1) for z in ([len(s)] if i < 8 else range(a, len(s) + 1)) if (e := distance(adapter[:i], s[a:z], indels)) <= int(0.2 * i + 1e-9)]
            expected.append(min(found)[2] if found else len(s))
        assert tr.adapter_cuts(seqs, adapter, indels=indels).tolist() == expected
    r = spark.createDataFrame([(1, "GGGGACGTTGCAGG", "I" * 14), (2, None, None)], "read_id long, seq string, qual string")
    assert [(x.read_id, x.seq, x.qual) for x in tr.remove_adapter(r, adapter).collect()] == [(1, "GGGG", "IIII"), (2, None, None)]


def test_fragment_mates(spark):
    got = tr.fragment_mates(spark.createDataFrame([("f", "AACCGGTTAC"), ("g", "AC")], "name string, seq string"), 4).collect()
    assert [tuple(x) for x in got] == [("f", "AACC", "GTAA"), ("g", "AC", "GT")]


def test_cleaning(spark):
    r = spark.createDataFrame([(1, "A" * 40, "I" * 36 + "####"), (2, "A" * 30, "I" * 30), (3, "N" * 20 + "A" * 30, "I" * 50)], "read_id long, seq string, qual string")
    assert [(x.read_id, len(x.seq)) for x in tr.quality_trim(r).collect()] == [(1, 36)]


def test_insert_motif(spark):
    got = spark.range(1).select(dna.insert_motif(dna.insert_motif(F.lit("A" * 20), F.lit(2), F.lit("TT")), F.lit(10), F.lit("TT")).alias("s"), dna.reverse_complement(F.lit("AACGN")).alias("rc")).first()
    assert got.s == "ATTAAAAAATTAAAAAAAAA" and got.rc == "NCGTT"


def test_safe_mismatches(spark):
    t = spark.createDataFrame([("a", "AAAAA", 0), ("b", "TTTAA", 1)], "sample string, tag string, tag_rank int")
    assert dm.safe_mismatches(t, 4) == 2
    assert dm.safe_mismatches(spark.createDataFrame([("a", "AC", 0), ("b", "ACG", 1)], t.schema), 1) == -1
    assert [r.tag for r in dm.too_long(t, 8, 4).collect()] == ["AAAAA", "TTTAA"]
