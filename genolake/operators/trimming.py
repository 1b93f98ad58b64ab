"""Find and trim adapters, and clean reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from genolake.functions.dna import reverse_complement

MOST_ADAPTERS = 1_000
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 5.0, -4.0, -9.0, -0.5


def _listed(adapters: DataFrame, *columns: str) -> list:
    """The adapters, once their number is known to be small, in the order of their names."""
    rows = adapters.select(*columns).orderBy(*columns).limit(MOST_ADAPTERS + 1).collect()
    if len(rows) > MOST_ADAPTERS:
        raise ValueError(f"an adapter table has at most {MOST_ADAPTERS} rows")
    return rows


def exact_starts(reads: DataFrame, adapters: DataFrame, seq: str = "seq") -> DataFrame:
    """(read_id, adapter, start): 0-based place of the adapter's first occurrence, -1 if there is none."""
    found = [F.struct(F.lit(r["adapter"]).alias("adapter"), (F.instr(F.col(seq), F.lit(r["adp_seq"])) - 1).alias("start")) for r in _listed(adapters, "adapter", "adp_seq")]
    return reads.select("read_id", F.inline(F.array(*found))) if found else reads.select("read_id", F.lit("").alias("adapter"), F.lit(0).alias("start")).limit(0)


def local_starts(seqs: list[str], adapter: str):
    """0-based start in each sequence of the first best local alignment (affine gaps), -1 without one.

    >>> local_starts(["CCCCCCCCCCCTATT", ""], "CTATTT").tolist()
    [10, -1]
    """
    import numpy as np

    n, size = len(seqs), max(map(len, seqs), default=0)
    letters = np.frombuffer(b"".join(s.encode("ascii", "replace").ljust(size, b"\0") for s in seqs), dtype=np.uint8).reshape(n, size).T
    best, found = np.zeros(n), np.full(n, -1, dtype=np.int64)
    # One row per base of the adapter; all reads in one go, column by column.
    places = np.arange(size + 1)[:, None]
    h, origin = np.zeros((size + 1, n)), np.broadcast_to(places, (size + 1, n)).copy()
    e, e_origin = np.full((size + 1, n), -np.inf), origin.copy()
    for base in adapter.encode():
        score = np.where(letters == base, MATCH, MISMATCH)
        opened, extended = h + GAP_OPEN, e + GAP_EXTEND
        e_origin = np.where(opened >= extended, origin, e_origin)
        e = np.maximum(opened, extended)
        diagonal = h[:-1] + score
        start = np.where(h[:-1] > 0, origin[:-1], places[:-1])
        new_h, new_o = np.zeros((size + 1, n)), np.broadcast_to(places, (size + 1, n)).copy()
        f, f_origin = np.full(n, -np.inf), np.zeros(n, dtype=np.int64)
        for j in range(1, size + 1):
            via = np.maximum(np.maximum(diagonal[j - 1], e[j]), f)
            up = via > 0
            new_h[j] = np.where(up, via, 0)
            came = np.where(via == diagonal[j - 1], start[j - 1], np.where(via == e[j], e_origin[j], f_origin))
            new_o[j] = np.where(up, came, j)
            opens = new_h[j] + GAP_OPEN >= f + GAP_EXTEND
            f_origin = np.where(opens, new_o[j], f_origin)
            f = np.where(opens, new_h[j] + GAP_OPEN, f + GAP_EXTEND)
        h, origin = new_h, new_o
        top = h.argmax(axis=0)
        high = h[top, np.arange(n)]
        better = high > best
        best[better], found[better] = high[better], origin[top, np.arange(n)][better]
    return found


def fuzzy_starts(reads: DataFrame, adapters: DataFrame, seq: str = "seq") -> DataFrame:
    """Exact place where there is one, else the start of the best local alignment."""
    listed = [(r["adapter"], r["adp_seq"]) for r in _listed(adapters, "adapter", "adp_seq")]

    @pandas_udf("array<int>")
    def aligned(seqs):
        import numpy as np
        import pandas as pd

        texts = seqs.fillna("").tolist()
        found = np.empty((len(texts), len(listed)), dtype=np.int32)
        for k, (_, adapter) in enumerate(listed):
            exact = np.fromiter((t.find(adapter) for t in texts), np.int32, len(texts))
            rest = np.flatnonzero(exact < 0)
            for at in range(0, len(rest), 2000):
                rows = rest[at : at + 2000]
                exact[rows] = local_starts([texts[i] for i in rows], adapter)
            found[:, k] = exact
        return pd.Series(list(found))

    names = F.array(*[F.lit(a) for a, _ in listed]) if listed else F.array().cast("array<string>")
    pairs = F.arrays_zip(names.alias("adapter"), aligned(F.col(seq)).alias("start"))
    return reads.select("read_id", F.explode(pairs).alias("x")).select("read_id", "x.adapter", "x.start")


def trim(reads: DataFrame, starts: DataFrame, seq: str = "seq") -> DataFrame:
    """Cut reads at the first adapter that was found."""
    cut = starts.filter("start >= 0").groupBy("read_id").agg(F.min("start").alias("cut"))
    at = F.coalesce("cut", F.length(seq)).cast("int")
    return reads.join(cut, "read_id", "left").select("read_id", at.alias("cut"), F.substring(F.col(seq), F.lit(1), at).alias("trimmed"))


def trim_exact(reads: DataFrame, adapters: DataFrame, seq: str = "seq") -> DataFrame:
    """Cut reads at the first exact place of any adapter; a read stays in its row."""
    places = [F.instr(F.col(seq), F.lit(r["adp_seq"])) - 1 for r in _listed(adapters, "adp_seq")]
    hit = F.array_min(F.filter(F.array(*places).cast("array<int>"), lambda p: p >= 0))
    at = F.coalesce(hit, F.length(seq))
    return reads.select("read_id", at.alias("cut"), F.substring(F.col(seq), F.lit(1), at).alias("trimmed"))


def _places(seq: str, adapters: list) -> Column:
    """Map of adapter to its first exact place (0-based, -1: none)."""
    return F.map_from_arrays(F.array(*[F.lit(r["adapter"]) for r in adapters]).cast("array<string>"), F.array(*[F.instr(F.col(seq), F.lit(r["adp_seq"])) - 1 for r in adapters]).cast("array<int>"))


def trim_pairs(reads: DataFrame, adapters: DataFrame) -> DataFrame:
    """Both mates cut at the first of their adapters: those for the mate, and those for both.

    Adds cut1, cut2, trimmed1, trimmed2 and, as the log of matches, places1 and places2 (adapter to place, -1: none).
    A pair stays in its row, so nothing is shuffled.
    """
    listed = _listed(adapters, "adapter", "adp_seq", "mate")
    out = reads
    for k, seq in (("1", "seq"), ("2", "seq2")):
        out = out.withColumn(f"places{k}", _places(seq, [r for r in listed if r["mate"] in (k, "both")]))
    for k, seq in (("1", "seq"), ("2", "seq2")):
        hit = F.array_min(F.filter(F.map_values(f"places{k}"), lambda p: p >= 0))
        out = out.withColumn(f"cut{k}", F.coalesce(hit, F.length(seq)))
        out = out.withColumn(f"trimmed{k}", F.substring(F.col(seq), F.lit(1), F.col(f"cut{k}")))
    return out


def match_log(pairs: DataFrame) -> DataFrame:
    """(read_id, mate, adapter, start): one row per read and adapter looked for."""
    of = lambda k: pairs.select("read_id", F.lit(k).alias("mate"), F.explode(f"places{k}").alias("adapter", "start"))
    return of(1).union(of(2))


def pair_counters(pairs: DataFrame) -> DataFrame:
    """How many pairs there are, and in how many both mates, only the first or only the second were cut."""
    one, two = F.col("cut1") < F.length("seq"), F.col("cut2") < F.length("seq2")
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(one & two).alias("trimmed_pairs"), F.count_if(one & ~two).alias("trimmed_r1"), F.count_if(~one & two).alias("trimmed_r2"))


def write_trimmed(pairs: DataFrame, path: str) -> dict:
    """Write both trimmed mates (``kind=r1``, ``kind=r2``, FASTQ or FASTA by whether there are qualities) and the log of matches (``kind=log``, read, mate, adapter and place)
    from one pass over the reads; the counters are observed in the same pass and returned.

    pairs: what ``trim_pairs`` gives, with ``qual`` and ``qual2`` or without.
    """
    from pyspark.sql import Observation

    name, one, two = F.col("read_id").cast("string"), F.col("cut1") < F.length("seq"), F.col("cut2") < F.length("seq2")

    def record(k: str, qual: str) -> Column:
        if qual not in pairs.columns:
            return F.concat(F.lit(">"), name, F.lit("\n"), F.col(f"trimmed{k}"))
        return F.concat(F.lit("@"), name, F.lit("\n"), F.col(f"trimmed{k}"), F.lit("\n+\n"), F.substring(F.col(qual), F.lit(1), F.col(f"cut{k}")))

    logged = lambda k: F.transform(F.map_entries(f"places{k}"), lambda e: F.struct(F.lit("log").alias("kind"), F.concat_ws("\t", name, F.lit(k), e["key"], e["value"].cast("string")).alias("value")))
    reads = F.array(*[F.struct(F.lit(f"r{k}").alias("kind"), record(k, q).alias("value")) for k, q in (("1", "qual"), ("2", "qual2"))])
    counters = Observation("trimmed")
    counted = pairs.observe(
        counters, F.count(F.lit(1)).alias("pairs"), F.count_if(one & two).alias("trimmed_pairs"), F.count_if(one & ~two).alias("trimmed_r1"), F.count_if(~one & two).alias("trimmed_r2")
    )
    lines = counted.select(F.explode(F.concat(reads, logged("1"), logged("2"))).alias("x")).select("x.kind", "x.value")
    lines.write.partitionBy("kind").text(path)
    return counters.get


def adapter_cuts(seqs: list[str], adapter: str, tolerance: float = 0.2, overlap: int = 3, indels: bool = True):
    """Where a 3' adapter begins in each sequence (its length: nowhere).

    The adapter may stand inside, or its first bases (``overlap`` or more) at the end. At most ``tolerance`` errors per base that
    takes part. The longest part of the adapter is taken, then the fewest errors, then the leftmost place.
    """
    import numpy as np

    n, m = len(seqs), len(adapter)
    length = np.fromiter(map(len, seqs), np.int64, n)
    size = int(length.max(initial=0))
    letters = np.frombuffer(b"".join(s.encode("ascii", "replace").ljust(size, b"\0") for s in seqs), dtype=np.uint8).reshape(n, size).T
    far = 1 << 20
    errors, origin = np.zeros((size + 1, n), dtype=np.int64), np.broadcast_to(np.arange(size + 1)[:, None], (size + 1, n)).copy()
    cut, rows = length.copy(), np.arange(n)
    for i, base in enumerate(adapter.encode(), 1):
        # Cost and start in one number, so that the smaller start wins among equals.
        before = errors * far + origin
        new = np.empty_like(before)
        new[0] = i * far if indels else far * far
        for j in range(1, size + 1):
            step = before[j - 1] + (letters[j - 1] != base) * far
            new[j] = np.minimum(np.minimum(step, before[j] + far), new[j - 1] + far) if indels else step
        errors, origin = new // far, new % far
        most = int(tolerance * i + 1e-9)
        if i < m:
            ok = (errors[length, rows] <= most) & (i >= overlap)
            cut = np.where(ok, origin[length, rows], cut)
        else:
            inside = np.arange(size + 1)[:, None] <= length
            low = np.where(inside & (errors <= most), new, far * far).min(axis=0)
            if m >= overlap:
                cut = np.where(low < far * far, low % far, cut)
    return cut


def remove_adapter(reads: DataFrame, adapter: str, tolerance: float = 0.2, overlap: int = 3, indels: bool = True, seq: str = "seq") -> DataFrame:
    """``reads`` with ``cut``, and sequence (and quality) cut there."""

    @pandas_udf("int")
    def at(seqs):
        import pandas as pd

        texts = seqs.fillna("").tolist()
        parts = [adapter_cuts(texts[k : k + 2000], adapter, tolerance, overlap, indels) for k in range(0, len(texts), 2000)]
        return pd.Series([int(x) for p in parts for x in p], dtype="int32")

    out = reads.withColumn("cut", at(F.col(seq))).withColumn(seq, F.substring(F.col(seq), F.lit(1), F.col("cut")))
    return out.withColumn("qual", F.substring(F.col("qual"), F.lit(1), F.col("cut"))) if "qual" in reads.columns else out


def fragment_mates(fragments: DataFrame, length: int) -> DataFrame:
    """(name, seq, seq2): the mates that a sequencer reads from both ends of each fragment."""
    return fragments.select("name", F.substring("seq", 1, length).alias("seq"), reverse_complement(F.substr("seq", F.greatest(F.length("seq") - length + 1, F.lit(1)), F.lit(length))).alias("seq2"))


def quality_trim(reads: DataFrame, least: int = 20, shortest: int = 35, most_n: float = 0.2, offset: int = 33) -> DataFrame:
    """Cut the 3' end where the summed shortfall of base qualities is largest, then drop short and vague reads."""
    n = F.length("qual")
    deficits = F.transform(F.sequence(F.lit(1), n), lambda i: F.lit(least + offset) - F.ascii(F.substr(F.col("qual"), n - i + 1, F.lit(1))))
    sums = F.aggregate(
        deficits,
        F.struct(F.lit(0).alias("s"), F.lit(0).alias("i"), F.lit(0).alias("best"), F.lit(0).alias("cut"), F.lit(False).alias("stop")),
        lambda a, d: F.struct(
            (a["s"] + d).alias("s"),
            (a["i"] + 1).alias("i"),
            F.when(~a["stop"] & (a["s"] + d > a["best"]), a["s"] + d).otherwise(a["best"]).alias("best"),
            F.when(~a["stop"] & (a["s"] + d > a["best"]), a["i"] + 1).otherwise(a["cut"]).alias("cut"),
            (a["stop"] | (a["s"] + d < 0)).alias("stop"),
        ),
    )
    kept = reads.filter(n > 0).withColumn("keep", n - sums["cut"]).withColumn("seq", F.substring(F.col("seq"), F.lit(1), F.col("keep"))).withColumn("qual", F.substring(F.col("qual"), F.lit(1), F.col("keep")))
    return kept.drop("keep").filter((F.length("seq") >= shortest) & (F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit(""))) <= most_n * F.length("seq")))
