"""Genotype tables in long form: (ind, snp, ...). Wide text formats are read and written by ``sources.genotype_files``."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from genolake.operators.blocks import cross_products
from genolake.operators.greedy import walk
from genolake.session import checkpoint, partitions


def call_probabilities(call: Column, a1: Column, a2: Column) -> dict[str, Column]:
    """Probabilities of the three genotypes; a call with other letters has none."""
    first = F.when(call == F.concat(a1, a1), 1)
    both = F.when((call == F.concat(a1, a2)) | (call == F.concat(a2, a1)), 1)
    second = F.when(call == F.concat(a2, a2), 1)
    return {"p_aa": F.coalesce(first, F.lit(0)), "p_ab": F.coalesce(both, F.lit(0)), "p_bb": F.coalesce(second, F.lit(0))}


def recode_calls(calls: DataFrame) -> DataFrame:
    return calls.select("rec", "ind", "snp", *[c.alias(k) for k, c in call_probabilities(F.col("call"), F.col("a1"), F.col("a2")).items()])


def dosage(probs: DataFrame) -> DataFrame:
    """Expected number of first alleles."""
    return probs.select("rec", "ind", "snp", (2.0 * F.col("p_aa") + F.col("p_ab")).alias("dosage"))


def hard_calls(probs: DataFrame) -> DataFrame:
    """2, 1 or 0 first alleles for certain genotypes, 9 for the others."""
    one = lambda c: (F.col(c) == 1)
    return probs.select("rec", "ind", "snp", F.when(one("p_aa"), 2).when(one("p_ab"), 1).when(one("p_bb"), 0).otherwise(9).alias("code"))


def chromosome_code(name: Column) -> Column:
    """Numbers of the sex, mitochondrial and pseudo-autosomal chromosomes; others as they are."""
    codes = {"X": 23, "Y": 24, "mtDNA": 90, "XY": 91, "YX": 91}
    out = F.regexp_replace(name, "^chr", "")
    expr = None
    for k, v in codes.items():
        expr = F.when(out == k, F.lit(str(v))) if expr is None else expr.when(out == k, F.lit(str(v)))
    return expr.otherwise(out)


def allele_sets(calls: DataFrame) -> DataFrame:
    """Alleles seen per marker without missing codes, and whether there are exactly two."""
    letters = calls.select("snp", F.explode(F.array(F.substring("call", 1, 1), F.substring("call", 2, 1))).alias("allele")).filter(~F.col("allele").isin("0", "N"))
    seen = letters.groupBy("snp").agg(F.array_join(F.sort_array(F.collect_set("allele")), "").alias("alleles"))
    return seen.withColumn("biallelic", F.length("alleles") == 2)


def frequencies(doses: DataFrame) -> DataFrame:
    f = doses.groupBy("snp").agg(F.count("g").alias("n"), (F.avg("g") / 2).alias("freq"))
    return f.withColumn("maf", F.least(F.col("freq"), 1 - F.col("freq")))


def common(doses: DataFrame, least: float = 0.01) -> DataFrame:
    """Genotypes of the markers whose minor allele is frequent enough."""
    return doses.join(frequencies(doses).filter(F.col("maf") >= least).select("snp"), "snp", "left_semi")


def linkage(doses: DataFrame) -> DataFrame:
    """r2 of each pair of markers of a block, over the individuals that have both."""
    a = doses.select("block", "ind", F.col("snp").alias("snp1"), F.col("g").alias("g1"))
    b = doses.select("block", "ind", F.col("snp").alias("snp2"), F.col("g").alias("g2"))
    pairs = a.join(b, ["block", "ind"]).filter("snp1 < snp2")
    # corr() of a constant is null, so nothing divides by zero
    return pairs.groupBy("snp1", "snp2").agg(F.count("*").alias("n"), F.pow(F.corr(F.col("g1").cast("double"), F.col("g2").cast("double")), 2).alias("r2")).filter("r2 is not null")


#: Cells of a block of markers, about, and individuals of a block that are a matrix at once.
CELLS_AT_ONCE, INDS_AT_ONCE = 1 << 20, 4096


def linkage_of_all(doses: DataFrame, markers_at_once: int = 256, inds_at_once: int = INDS_AT_ONCE) -> DataFrame:
    """r2 of every pair of markers, over the individuals that have both; ``doses`` may be those of one chromosome.

    Markers are dealt by hash into packed blocks of about ``markers_at_once``, which are kept once. Every pair of blocks meets in a task that reads both and
    multiplies them as dense matrices, ``inds_at_once`` individuals at a time; nothing is shuffled per pair. Repeated cells meet each of the other's.
    """
    kinds = [doses.schema[c].dataType.simpleString() for c in ("snp", "ind")]
    arrows = [to_arrow_type(doses.schema[c].dataType) for c in ("snp", "ind")]
    cells = doses.select("snp", "ind", F.col("g").cast("double").alias("g")).dropna()
    size = cells.groupBy("snp").agg(F.count("*").alias("n")).agg(F.count("*").alias("snps"), F.coalesce(F.sum("n"), F.lit(0)).alias("cells")).first()
    groups = max(1, -(-size["snps"] // markers_at_once), -(-size["cells"] // CELLS_AT_ONCE))

    def pack(table):
        import numpy as np
        import pyarrow as pa

        (snps, row), (inds, at) = (np.unique(table.column(c).to_numpy(), return_inverse=True) for c in ("snp", "ind"))
        raw = [x.tobytes() for x in (row.astype(np.int32), at.astype(np.int32), table.column("g").to_numpy())]
        lists = [pa.array([x], pa.list_(kind)) for x, kind in zip((snps, inds), arrows, strict=True)]
        return pa.table([table.column("block")[:1].combine_chunks(), *lists, *[pa.array([x], pa.binary()) for x in raw]], names=["block", "snps", "inds", "row", "at", "g"])

    def met(same, one, two):
        import numpy as np
        import pyarrow as pa

        common = np.intersect1d(one[1], two[1])

        def matrices(side, start):
            """Counts, sums and sums of squares of a block's cells, by marker and common individual, from ``start`` on."""
            snps, inds, row, at, g = side
            width = min(inds_at_once, len(common) - start)
            place = np.searchsorted(common, inds)
            there = common[np.minimum(place, len(common) - 1)] == inds
            col = np.where(there, place - start, -1)[at]
            use = (col >= 0) & (col < width)
            cell, v = row[use] * width + col[use], g[use]
            return [np.bincount(cell, w, len(snps) * width).reshape(len(snps), width).astype(float) for w in (None, v, v * v)]

        n, a, b, q1, q2, cross = (np.zeros((len(one[0]), len(two[0]))) for _ in range(6))
        for start in range(0, len(common), inds_at_once):
            (n1, s1, x1), (n2, s2, x2) = matrices(one, start), matrices(two, start)
            for total, (x, y) in zip((n, a, b, q1, q2, cross), ((n1, n2), (s1, n2), (n1, s2), (x1, n2), (n1, x2), (s1, s2)), strict=True):
                total += x @ y.T
        aa, bb = n * q1, n * q2
        v1, v2, cov = aa - a * a, bb - b * b, n * cross - a * b
        ok = (v1 > 1e-12 * aa) & (v2 > 1e-12 * bb)  # a constant has no correlation
        if same:
            ok &= np.arange(len(one[0]))[:, None] < np.arange(len(two[0]))[None, :]
        x, y = np.nonzero(ok)
        first, second = one[0][x], two[0][y]
        swap = first > second
        first, second = np.where(swap, second, first), np.where(swap, first, second)
        r2 = np.minimum(1.0, cov[x, y] ** 2 / (v1[x, y] * v2[x, y]))
        return pa.RecordBatch.from_arrays([pa.array(first, arrows[0]), pa.array(second, arrows[0]), pa.array(n[x, y].astype(np.int64)), pa.array(r2)], names=["snp1", "snp2", "n", "r2"])

    def meet(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for s in ("1", "2"):
                    lists = [batch.column(c + s)[k].values.to_numpy(zero_copy_only=False) for c in ("snps", "inds")]
                    sides.append([*lists, *[np.frombuffer(batch.column(c + s)[k].as_buffer(), kind) for c, kind in (("row", np.int32), ("at", np.int32), ("g", float))]])
                yield met(batch.column("block1")[k].as_py() == batch.column("block2")[k].as_py(), *sides)

    # Each task meets two of these partitions, so their number's square, a few for each shuffle partition, is that of the tasks.
    parts = min(groups, math.isqrt(4 * partitions(doses.sparkSession)) + 1)
    dealt = cells.withColumn("block", F.pmod(F.xxhash64("snp"), F.lit(groups)).cast("int")).repartition(parts, "block")
    blocks = checkpoint(dealt.groupBy("block").applyInArrow(pack, f"block int, snps array<{kinds[0]}>, inds array<{kinds[1]}>, row binary, at binary, g binary"))
    blocks = blocks.coalesce(parts)  # also where the session deals keys more finely
    one, two = (blocks.toDF(*[f"{c}{s}" for c in blocks.columns]) for s in ("1", "2"))
    pairs = one.crossJoin(two.hint("shuffle_replicate_nl")).filter("block1 <= block2")
    return pairs.mapInArrow(meet, f"snp1 {kinds[0]}, snp2 {kinds[0]}, n long, r2 double")


def relationships(doses: DataFrame, centred: bool = True, method: str = "vanraden") -> DataFrame:
    """Genomic relationships of pairs of individuals, over the markers that both have.

    vanraden: cross-products over the summed heterozygosity (``centred`` or not); centred: cross-products of centred
    doses over the number of markers; standardised: those of doses scaled by each marker's own deviation (markers
    without variation are left out); astle-balding: half of the standardised ones, as kinships; yang: the standardised ones, with the unbiased
    estimate of an individual's own relationship, 1 + mean((g^2 - (1 + 2f) g + 2f^2) / (2f (1 - f))).
    """
    if method == "astle-balding":
        return relationships(doses, method="standardised").withColumn("relationship", F.col("relationship") / 2)
    if method == "yang":
        freq = frequencies(doses).select("snp", F.col("freq").alias("f")).filter("f > 0 and f < 1")
        own = doses.join(freq, "snp").groupBy(F.col("ind").alias("ind1")).agg((1 + F.sum(F.expr("(g * g - (1 + 2 * f) * g + 2 * f * f) / (2 * f * (1 - f))")) / F.count("*")).alias("own"))
        pairs = relationships(doses, method="standardised").join(own, "ind1")
        return pairs.select("ind1", "ind2", F.when(F.col("ind1") == F.col("ind2"), F.col("own")).otherwise(F.col("relationship")).alias("relationship"))
    freq = frequencies(doses).select("snp", "freq")
    het = 2 * F.col("freq") * (1 - F.col("freq"))
    z = F.col("g") - (2 * F.col("freq") if centred else 0)
    if method == "standardised":
        freq, z = freq.filter("freq > 0 and freq < 1"), z / F.sqrt(het)
    elif method not in ("vanraden", "centred"):
        raise ValueError("method is vanraden, centred, standardised, astle-balding or yang")
    scale = freq.agg((F.sum(het) if method == "vanraden" else F.count("*").cast("double")).alias("scale"))
    g = doses.join(freq, "snp").select("ind", "snp", z.alias("z"))
    sums = cross_products(g, "ind", "snp", "z").select(F.col("row1").alias("ind1"), F.col("row2").alias("ind2"), "cross")
    return sums.crossJoin(F.broadcast(scale)).select("ind1", "ind2", F.try_divide("cross", "scale").alias("relationship"))


def inbreeding(relationship: DataFrame) -> DataFrame:
    """Inbreeding of individuals and coancestry of pairs from their relationships."""
    same = F.col("ind1") == F.col("ind2")
    return relationship.select("ind1", "ind2", F.when(same, F.col("relationship") - 1).alias("inbreeding"), F.when(~same, F.col("relationship") / 2).alias("coancestry"))


def ascertained(doses: DataFrame, panel: DataFrame, least: float = 0.1, most: int | None = None) -> DataFrame:
    """Markers that are common enough in a panel of individuals; ``most`` of them, in the order of a hash."""
    found = frequencies(doses.join(panel, "ind", "left_semi")).filter(F.col("maf") >= least).select("snp", "maf")
    return found.orderBy(F.md5(F.col("snp").cast("string")), "snp").limit(most) if most else found


def trait_values(doses: DataFrame, effects: DataFrame, mean: float, noise: float = 0.0) -> DataFrame:
    """Simulated trait: mean, summed marker effects and noise that a hash of the individual draws."""
    value = doses.join(effects, "snp").groupBy("ind").agg(F.sum(F.col("g") * F.col("beta")).alias("genetic"))
    u = (F.pmod(F.xxhash64("ind"), F.lit(1_000_003)) + 0.5) / 1_000_003
    return value.select("ind", "genetic", (mean + F.col("genetic") + noise * (2 * u - 1)).alias("trait"))


def gaps(snps: DataFrame) -> DataFrame:
    """Distance to the next marker of the chromosome."""
    w = Window.partitionBy("chrom").orderBy("pos", "snp")
    return snps.select("snp", "chrom", "pos", (F.lead("pos").over(w) - F.col("pos")).alias("gap"))


def pair_distances(pairs: DataFrame, snps: DataFrame) -> DataFrame:
    s1 = snps.select(F.col("snp").alias("snp1"), F.col("chrom").alias("chrom1"), F.col("pos").alias("pos1"))
    s2 = snps.select(F.col("snp").alias("snp2"), F.col("chrom").alias("chrom2"), F.col("pos").alias("pos2"))
    both = pairs.join(s1, "snp1").join(s2, "snp2")
    return both.select("snp1", "snp2", F.when(F.col("chrom1") == F.col("chrom2"), F.abs(F.col("pos2") - F.col("pos1"))).alias("distance"))


def chunks(snps: DataFrame, length: int = 5_000_000, parts: int | None = None) -> DataFrame:
    """Greedy chunks: a new one starts at the first position beyond the last start plus ``length``."""
    return walk(snps, length + 1, parts).groupBy("chrom", F.col("start").alias("chunk_start")).agg(F.sum("n").alias("n_snps"), F.max("pos").alias("last_pos"))


def thin(snps: DataFrame, apart: int = 100_000, parts: int | None = None) -> DataFrame:
    """Markers that are at least so far from the last one kept; of markers in one place the first."""
    return walk(snps, apart, parts).filter("pos = start").select("snp", "chrom", "pos")


def cross_doses(parents: DataFrame, crosses: DataFrame, crossovers: DataFrame) -> DataFrame:
    """Allele doses of children: each parent passes on the haplotype chosen by the parity of crossovers before the marker.

    parents: (ind, hap, snp, allele); crosses: (child, mother, father); crossovers: (child, side, at).
    """
    sides = crosses.select("child", F.explode(F.array(F.struct(F.lit("m").alias("side"), F.col("mother").alias("ind")), F.struct(F.lit("f").alias("side"), F.col("father").alias("ind")))).alias("x")).select("child", "x.side", "x.ind")
    cuts = crossovers.groupBy("child", "side").agg(F.collect_list("at").alias("cuts"))
    gametes = sides.join(cuts, ["child", "side"], "left").join(parents, "ind")
    before = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda c: c < F.col("snp")))
    return gametes.filter(F.col("hap") == before % 2).groupBy("child", "snp").agg(F.sum("allele").alias("dose"))


def autosomes(markers: DataFrame, last: int = 22) -> DataFrame:
    """Markers of the numbered chromosomes up to ``last``."""
    code = F.expr("try_cast(regexp_replace(chrom, '^chr', '') AS INT)")
    return markers.filter((code >= 1) & (code <= last))


def of_chromosome(cells: DataFrame, chrom) -> DataFrame:
    return cells.filter(F.col("chrom") == F.lit(chrom))


def of_population(cells: DataFrame, individuals: DataFrame) -> DataFrame:
    return cells.join(individuals.select("ind"), "ind", "left_semi")


def normal_id(name):
    """Names as R makes them: dots for hyphens."""
    return F.translate(name, "-", ".")
