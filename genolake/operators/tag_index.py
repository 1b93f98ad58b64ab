"""Tags with substitutions by an index of their parts, for sheets that are too long for a loop over tags.

A tag is cut into more seeds than substitutions are allowed, single bases if it is short. A read that differs from it in at most ``most`` bases
agrees with it in all but ``most`` seeds, in full and in their places, so reads and tags meet in an equi join on a digest of what is left
when any ``most`` seeds are taken out (``MOST_KEYS`` keys at most, else fewer and longer seeds), and are verified by counting. With single bases hardly more meets than matches.

What meets are the distinct starts of reads, as long as the longest tag, and the distinct tags, so a tag that many reads carry or that stands on
many rows is looked up once; starts with an exact tag are found by that first. The best tag of each start then goes back to its reads
(``skew.hand_back``), and pairs of tags to their rows. Neither side has to fit anywhere, so a sheet may be of any length.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genolake.operators.skew import hand_back
from genolake.session import checkpoint, partitions

MOST_LENGTHS = 100
#: Keys of a tag of one length, and of all lengths together.
MOST_KEYS, ALL_KEYS = 64, 256


def seed_bounds(length: int, most: int, lengths: int = 1) -> list[tuple[int, int]]:
    """0-based (start, end) of the seeds of a tag, in order, as equal as can be, and as many as give few keys.

    >>> seed_bounds(5, 1)
    [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    >>> seed_bounds(7, 2, 100)
    [(0, 2), (2, 4), (4, 7)]
    """
    n = most + 1
    while n < length and comb(n + 1, most) <= min(MOST_KEYS, ALL_KEYS // lengths):
        n += 1
    return [(length * k // n, length * (k + 1) // n) for k in range(n)]


def _lengths(tags: DataFrame, tag: str) -> list[int]:
    found = sorted(r[0] for r in tags.filter(F.col(tag).isNotNull()).select(F.length(tag)).distinct().limit(MOST_LENGTHS + 1).collect())
    if len(found) > MOST_LENGTHS:
        raise ValueError(f"tags of at most {MOST_LENGTHS} different lengths")
    return found


def _keyed(texts: DataFrame, name: str, lengths: list[int], most: int, levels: list[int], own: bool = False) -> DataFrame:
    """``texts`` with every (key, out) of a text, ``out`` being how many seeds are taken out: of tags of that length only (``own``), or of all tags that the text may start with."""
    text, cut = F.col(name), []
    for n in lengths:
        seeds = seed_bounds(n, most, len(lengths))
        for out in levels:
            for gone in combinations(range(len(seeds)), out):
                left = [F.substring(text, a + 1, b - a) for k, (a, b) in enumerate(seeds) if k not in gone]
                key = F.xxhash64(F.lit(n), F.lit(",".join(map(str, gone))), F.concat(*left))
                cut.append(F.when(F.length(text) == n if own else F.length(text) >= n, F.struct(key.alias("key"), F.lit(out).alias("out"))))
    return texts.withColumn("s", F.explode(F.array(*cut))).filter("s is not null").select(*texts.columns, "s.*")


def _far(a: Column, b: Column) -> Column:
    """Bases in which ``b`` differs from the start of ``a``, compared base by base."""
    places = F.sequence(F.lit(1), F.length(b))
    return F.aggregate(places, F.lit(0), lambda n, i: n + (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))).cast("int"))


def seeded_starts(reads: DataFrame, tags: DataFrame, most: int = 1, seq: str = "seq") -> DataFrame:
    """(read_id, sample, mismatches, clip1): tags at the start with at most ``most`` substitutions, fewest first, then by ``tag_rank``.

    Case is ignored. A tag that is shorter than ``most + 1`` bases has empty seeds and matches whatever its bases allow.
    """
    sheet = tags.select(F.upper("tag").alias("tag"), "sample", "tag_rank").filter("tag is not null").groupBy("tag").agg(F.min(F.struct("tag_rank", "sample")).alias("first"))
    n, lengths = partitions(reads.sparkSession), _lengths(sheet, "tag")
    if not lengths:
        return reads.limit(0).select("read_id", F.lit("").alias("sample"), F.lit(0).alias("mismatches"), F.col(seq).alias("clip1"))
    starts = reads.select("read_id", seq, F.upper(F.substring(seq, 1, lengths[-1])).alias("start"))
    distinct = starts.filter("start is not null").groupBy("start").agg(F.count("*").alias("_n"))
    best = lambda far: F.min(F.when(F.col("first").isNotNull(), F.struct(far.alias("mismatches"), "first.tag_rank", "first.sample", "tag"))).alias("best")
    whole = F.explode(F.array(*[F.when(F.length("start") >= k, F.substring("start", 1, k)) for k in lengths]))
    exact = distinct.select("start", "_n", whole.alias("tag")).filter("tag is not null").join(sheet, "tag", "left").groupBy("start").agg(best(F.lit(0)), F.min("_n").alias("_n"))
    exact = checkpoint(exact.repartition(n, "start"))
    found = exact.filter("best is not null")
    if most:
        asked = _keyed(exact.filter("best is null").select("start", "_n"), "start", lengths, most, [most]).repartition(n, "key")
        index = _keyed(sheet, "tag", lengths, most, [most], own=True).drop("out").repartition(n, "key")
        met = asked.join(index, "key").filter(F.length("start") >= F.length("tag")).withColumn("far", _far(F.col("start"), F.col("tag"))).filter(F.col("far") <= most)
        found = checkpoint(found.unionByName(met.groupBy("start").agg(best(F.col("far")), F.min("_n").alias("_n"))))
    hit = hand_back(starts, found, "start", "_n")
    return hit.select("read_id", "best.sample", "best.mismatches", F.substr(F.col(seq), F.length("best.tag") + 1, F.length(seq)).alias("clip1"))


def indistinct_pairs(tags: DataFrame, most: int = 0) -> DataFrame:
    """(s1, t1, s2, t2): tags of different samples of which the shorter, t1, matches the start of the longer, t2.

    Distinct tags are compared; equal rows of the sheet count as often as they stand there.
    """
    n, lengths = partitions(tags.sparkSession), _lengths(tags, "tag")
    t1 = tags.select(F.col("sample").alias("s1"), F.col("tag").alias("t1"))
    t2 = tags.select(F.col("sample").alias("s2"), F.col("tag").alias("t2"))
    if not lengths:
        return t1.limit(0).crossJoin(t2.limit(0))
    texts = checkpoint(tags.select(F.upper("tag").alias("u")).filter("u is not null").distinct().repartition(n, "u"))
    levels = list(range(most + 1))
    short = _keyed(texts.toDF("u1"), "u1", lengths, most, levels, own=True).repartition(n, "key")
    long = _keyed(texts.toDF("u2"), "u2", lengths, most, levels).drop("out").repartition(n, "key")
    # A pair counts once: where no seed is taken out but those in which it differs.
    bounds = F.array(*[F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b - a).alias("n")) for a, b in seed_bounds(k, most, len(lengths))]) for k in lengths])
    own = F.element_at(bounds, F.array_position(F.array(*[F.lit(k) for k in lengths]), F.length("u1")).cast("int"))
    apart = F.aggregate(own, F.lit(0), lambda k, s: k + (F.substr("u1", s["a"] + 1, s["n"]) != F.substr("u2", s["a"] + 1, s["n"])).cast("int"))
    met = short.join(long, "key").filter(F.length("u1") <= F.length("u2")).filter(apart == F.col("out")).filter(_far(F.col("u2"), F.col("u1")) <= most)
    # What joins is small and its result, or the work on it, is not: dealt to all partitions whatever its size.
    longer = met.select("u1", "u2").join(t2.withColumn("u2", F.upper("t2")), "u2").repartition(n, "u1")
    pairs = longer.join(t1.withColumn("u1", F.upper("t1")).repartition(n, "u1"), "u1").filter(F.col("s1") != F.col("s2"))
    return pairs.select("s1", "t1", "s2", "t2")
