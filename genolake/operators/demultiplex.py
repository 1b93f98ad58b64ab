"""Assign reads to samples by DNA tags.

A tag table is a sample sheet: its size is checked, and it is sent to the tasks, which compare a batch of reads with each
tag in turn, so a read stays where it is and nothing is joined or shuffled. Exact tags at the start of a read are looked up instead,
by a hash join with the broadcast sheet per tag length. Long sheets with substitutions (``MANY_TAGS``) go through the index of ``tag_index``.

With ``most`` substitutions allowed over tag and motif together, a tag matches at the leftmost place that has no more. Of
several tags that match, that with the fewest substitutions is taken, then the one with the smallest ``tag_rank``. Case is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genolake.operators.tag_index import MOST_LENGTHS, indistinct_pairs, seeded_starts

MOST_TAGS = 100_000
MANY_TAGS = 2_000


def sheet(tags: DataFrame, most: int = MOST_TAGS) -> DataFrame:
    """The tag table, marked for broadcast once its size is known to be small."""
    if tags.limit(most + 1).count() > most:
        raise ValueError(f"a tag table has at most {most} rows")
    return F.broadcast(tags)


def pattern_classes(pattern: str) -> list[str]:
    """The bases that each place of a pattern allows.

    >>> pattern_classes("ac[AT]g")
    ['A', 'C', 'AT', 'G']
    """
    return [x.strip("[]") for x in re.findall(r"\[[^]]*\]|.", pattern.upper())]


def leftmost(seqs: list, patterns: list[list[str]], most: int, window: int | None, anchored: bool) -> Iterator:
    """For each pattern, the 0-based place (-1: none) and the number of substitutions of its leftmost match in every sequence."""
    import numpy as np

    raw = [(s or "").upper().encode("ascii", "replace")[:window] for s in seqs]
    length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    longest = max((len(p) for p in patterns), default=0)
    width = min(int(length.max(initial=0)), longest) if anchored else int(length.max(initial=0))
    bases = np.frombuffer(b"".join(r[:width].ljust(width, b"\0") for r in raw), dtype=np.uint8).reshape(len(raw), width)
    off = {c: np.ascontiguousarray((~np.isin(bases, np.frombuffer(c.encode(), np.uint8))).T).view(np.uint8) for c in {c for p in patterns for c in p}}
    for p in patterns:
        place, count = np.full(len(raw), -1, dtype=np.int64), np.zeros(len(raw), dtype=np.int64)
        for start in range(1 if anchored else max(0, width - len(p) + 1)):
            if start + len(p) > width:
                break
            found = np.zeros(len(raw), dtype=np.uint8)
            for k, c in enumerate(p):
                found += off[c][start + k]
            hit = (found <= most) & (place < 0) & (start + len(p) <= length)
            place[hit], count[hit] = start, found[hit]
        yield place, count


PLACED = "tag int, at1 int, at2 int, off1 int, off2 int"


def placed(reads: DataFrame, tags: DataFrame, mates: str, motif: str = "", most: int = 0, window: int | None = None, anchored: bool = False) -> DataFrame:
    """``reads`` that a tag matches, with the tag, its sample, and its 1-based place (0: none) and substitutions in each mate.

    ``mates``: ``first``, ``second``, ``both`` (the same tag in both) or ``either``.
    """
    from pyspark.sql.functions import pandas_udf

    known = [(r["tag"], r["sample"]) for r in sheet(tags).orderBy("tag_rank").collect()]
    patterns = [pattern_classes(t + motif) for t, _ in known]

    @pandas_udf(PLACED)
    def best(*columns):
        import numpy as np
        import pandas as pd

        n = len(columns[0])
        chosen, at, off = np.full(n, -1), np.full((2, n), -1), np.zeros((2, n), dtype=np.int64)
        least = np.full(n, np.iinfo(np.int64).max)
        runs = [leftmost(c.tolist(), patterns, most, window, anchored) for c in columns]
        for k, found in enumerate(zip(*runs, strict=True)):
            hits = [place >= 0 for place, _ in found]
            cost = sum(np.where(h, count, 0) for h, (_, count) in zip(hits, found, strict=True))
            ok = np.logical_or.reduce(hits) if mates == "either" else np.logical_and.reduce(hits)
            if mates == "either":  # a mate that matches with fewer counts
                cost = np.min([np.where(h, count, most + 1) for h, (_, count) in zip(hits, found, strict=True)], axis=0)
            better = ok & (cost < least)
            chosen[better], least[better] = k, cost[better]
            for m, (place, count) in enumerate(found):
                at[m, better], off[m, better] = place[better], count[better]
        return pd.DataFrame({"tag": chosen, "at1": at[0] + 1, "at2": at[1] + 1, "off1": off[0], "off2": off[1]})

    columns = {"first": ["seq"], "second": ["seq2"]}.get(mates, ["seq", "seq2"])
    names = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(s).alias("sample")) for t, s in known]) if known else F.array().cast("array<struct<tag:string,sample:string>>")
    hit = reads.withColumn("_p", best(*columns)).filter("_p.tag >= 0").withColumn("_t", F.get(names, F.col("_p.tag")))
    return hit.select(*reads.columns, "_t.tag", "_t.sample", "_p.at1", "_p.at2", "_p.off1", "_p.off2")


def looked_up(reads: DataFrame, tags: DataFrame, mates: str) -> DataFrame:
    """What ``placed`` gives for exact tags at the start, by a hash lookup per length of tag: no Python, no shuffle, and a read stays in its row."""
    own = sheet(tags).select(F.upper("tag").alias("tag"), "sample", "tag_rank").groupBy("tag").agg(F.min(F.struct("tag_rank", "sample")).alias("first"))
    lengths = sorted(r[0] for r in own.select(F.length("tag")).distinct().limit(MOST_LENGTHS + 1).collect())
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"tags of at most {MOST_LENGTHS} different lengths")
    columns = {"first": ["seq"], "second": ["seq2"], "both": ["seq"]}.get(mates, ["seq", "seq2"])
    out, hits = reads, []
    for n in lengths:
        for c in columns:
            name = f"_hit{len(hits)}"
            side = F.broadcast(own.filter(F.length("tag") == n).select(F.col("tag").alias("_key"), F.struct("first.tag_rank", "first.sample", "tag").alias(name)))
            out = out.join(side, F.upper(F.substring(c, 1, n)) == F.col("_key"), "left").drop("_key")
            hits.append(F.when(F.startswith(F.upper("seq2"), F.col(f"{name}.tag")), F.col(name)) if mates == "both" else F.col(name))
    if not hits:
        return reads.limit(0).select(*reads.columns, F.lit("").alias("tag"), F.lit("").alias("sample"), *[F.lit(0).alias(c) for c in ("at1", "at2", "off1", "off2")])
    best = out.withColumn("_t", F.array_min(F.array_compact(F.array(*hits)))).filter("_t is not null")
    at = lambda c: F.coalesce(F.startswith(F.upper(c), F.col("_t.tag")).cast("int"), F.lit(0)) if c in reads.columns else F.lit(0)
    return best.select(*reads.columns, "_t.tag", "_t.sample", at("seq").alias("at1"), at("seq2").alias("at2"), F.lit(0).alias("off1"), F.lit(0).alias("off2"))


def _many(tags: DataFrame) -> bool:
    return tags.limit(MANY_TAGS + 1).count() > MANY_TAGS


def _rest(seq: str, skip: Column | int) -> Column:
    return F.substr(F.col(seq), (skip if isinstance(skip, Column) else F.lit(skip)) + 1, F.length(seq))


def both_start(reads: DataFrame, tags: DataFrame, most: int = 0) -> DataFrame:
    """Method 1: both mates start with the tag; both are clipped."""
    n = F.length("tag")
    hit = placed(reads, tags, "both", most=most, anchored=True) if most else looked_up(reads, tags, "both")
    return hit.select("read_id", "sample", _rest("seq", n).alias("clip1"), _rest("seq2", n).alias("clip2"))


def either_start(reads: DataFrame, tags: DataFrame, most: int = 0) -> DataFrame:
    """Methods 2 and 3: either mate starts with the tag; only mates that do are clipped. ``n_mates`` counts them."""
    hit = placed(reads, tags, "either", most=most, anchored=True) if most else looked_up(reads, tags, "either")
    clip = lambda c, at: F.when(F.col(at) > 0, _rest(c, F.length("tag"))).otherwise(F.col(c))
    both = (F.col("at1") > 0).cast("int") + (F.col("at2") > 0).cast("int")
    return hit.select("read_id", "sample", clip("seq", "at1").alias("clip1"), clip("seq2", "at2").alias("clip2"), both.alias("n_mates"))


def first_starts(reads: DataFrame, tags: DataFrame, most: int = 0) -> DataFrame:
    """Method 4a: the first mate starts with the tag."""
    hit = placed(reads, tags, "first", most=most, anchored=True) if most else looked_up(reads, tags, "first")
    return hit.select("read_id", "sample", _rest("seq", F.length("tag")).alias("clip1"))


def within(reads: DataFrame, tags: DataFrame, window: int | None = None, most: int = 0) -> DataFrame:
    """Method 4b: the tag lies within the first ``window`` bases; the read is clipped to the end of the match."""
    hit = placed(reads, tags, "first", most=most, window=window)
    return hit.select("read_id", "sample", F.col("at1").alias("at"), _rest("seq", F.col("at1") - 1 + F.length("tag")).alias("clip1"))


def with_motif(reads: DataFrame, tags: DataFrame, motif: str, window: int | None = None, most: int = 0) -> DataFrame:
    """Method 4c: the tag is followed by what the enzyme leaves (a pattern); the motif stays on the read."""
    hit = placed(reads, tags, "first", motif, most, window)
    return hit.select("read_id", "sample", F.col("at1").alias("at"), _rest("seq", F.col("at1") - 1 + F.length("tag")).alias("clip1"))


def either_with_motif(reads: DataFrame, tags: DataFrame, motif: str, window: int | None = None, most: int = 0) -> DataFrame:
    """Method 4d: tag and motif in either mate; mates with tags of different samples make a chimera.

    Each mate's tag is the best one for that mate. A mate without a match is clipped at the place of the other one's.
    """
    from pyspark.sql.functions import pandas_udf

    known = [(r["tag"], r["sample"]) for r in sheet(tags).orderBy("tag_rank").collect()]
    patterns = [pattern_classes(t + motif) for t, _ in known]
    lengths = [len(t) for t, _ in known]

    @pandas_udf("tag int, skip int")
    def best(seqs):
        import numpy as np
        import pandas as pd

        chosen, skip, least = np.full(len(seqs), -1), np.zeros(len(seqs), dtype=np.int64), np.full(len(seqs), most + 1)
        for k, (place, count) in enumerate(leftmost(seqs.tolist(), patterns, most, window, False)):
            better = (place >= 0) & (count < least)
            chosen[better], least[better], skip[better] = k, count[better], place[better] + lengths[k]
        return pd.DataFrame({"tag": chosen, "skip": skip})

    names = F.array(*[F.lit(s) for _, s in known]) if known else F.array().cast("array<string>")
    both = reads.withColumn("_1", best("seq")).withColumn("_2", best("seq2")).filter("_1.tag >= 0 OR _2.tag >= 0")
    s1, s2 = (F.when(F.col(f"{m}.tag") >= 0, F.get(names, F.col(f"{m}.tag"))) for m in ("_1", "_2"))
    skip1, skip2 = (F.when(F.col(f"{m}.tag") >= 0, F.col(f"{m}.skip")) for m in ("_1", "_2"))
    chimera = F.coalesce(s1 != s2, F.lit(False))
    return both.select(
        "read_id",
        F.when(chimera, "chimera").otherwise(F.coalesce(s1, s2)).alias("sample"),
        F.when(chimera, F.col("seq")).otherwise(_rest("seq", F.coalesce(skip1, skip2))).alias("clip1"),
        F.when(chimera, F.col("seq2")).otherwise(_rest("seq2", F.coalesce(skip2, skip1))).alias("clip2"),
    )


def fuzzy_start(reads: DataFrame, tags: DataFrame, most: int = 1) -> DataFrame:
    """Tags at the start with at most ``most`` substitutions, fewest first. Long sheets are met by a pigeonhole index."""
    if _many(tags):
        return seeded_starts(reads, tags, most)
    hit = placed(reads, tags, "first", most=most, anchored=True)
    return hit.select("read_id", "sample", F.col("off1").alias("mismatches"), _rest("seq", F.length("tag")).alias("clip1"))


def site_chimeras(reads: DataFrame, motif: str) -> DataFrame:
    """Whether a whole restriction site stands in a mate, which shows two fragments joined."""
    return reads.select("read_id", (F.rlike("seq", F.lit(motif)) | F.rlike("seq2", F.lit(motif))).alias("site_chimera"))


def route(reads: DataFrame, assigned: DataFrame, chimeras: DataFrame | None = None) -> DataFrame:
    """Where each read goes: its sample, ``unassigned`` or ``chimeras``."""
    out = reads.join(assigned.select("read_id", "sample"), "read_id", "left")
    to = F.coalesce("sample", F.lit("unassigned"))
    if chimeras is not None:
        out = out.join(chimeras, "read_id")
        to = F.when(F.col("site_chimera"), "chimeras").otherwise(to)
    return out.select("read_id", to.alias("destination"))


def stats_per_sample(assigned: DataFrame, tags: DataFrame) -> DataFrame:
    """Assigned reads of every sample of the sheet, also those without any."""
    per = assigned.groupBy("sample").agg(F.count("*").alias("n"))
    names = tags.groupBy("sample").agg(F.concat_ws("_", F.sort_array(F.collect_list("tag"))).alias("barcode"))
    return names.join(per, "sample", "left").select(F.col("sample").alias("ind"), "barcode", F.coalesce("n", F.lit(0)).alias("assigned"))


def summary(routed: DataFrame) -> DataFrame:
    """Counters and the assigned share, null without reads."""
    a = routed.agg(
        F.count("*").alias("reads"),
        F.count_if(F.col("destination") == "unassigned").alias("unassigned"),
        F.count_if(F.col("destination") == "chimeras").alias("chimeras"),
        F.count_if(~F.col("destination").isin("unassigned", "chimeras")).alias("assigned"),
    )
    return a.withColumn("percent_assigned", F.round(F.try_divide(100.0 * F.col("assigned"), F.col("reads")), 4))


def indistinct_tags(tags: DataFrame, most: int = 0) -> DataFrame:
    """Pairs of tags of different samples of which the shorter matches the longer one's start, by a pigeonhole index."""
    return indistinct_pairs(tags, most)


def safe_mismatches(tags: DataFrame, most: int) -> int:
    """The largest number of substitutions, up to ``most``, at which tags of different samples stay apart; -1 if none."""
    for k in range(most, -1, -1):
        if indistinct_tags(tags, k).isEmpty():
            return k
    return -1


def too_long(tags: DataFrame, window: int, motif_bases: int = 0) -> DataFrame:
    """Tags that, with what the enzyme leaves, do not fit in the window where they are looked for."""
    return tags.filter(F.length("tag") + motif_bases > window)
