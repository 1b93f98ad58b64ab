"""DNA expressions: ambiguity codes, motifs, mismatch counts, reverse complements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC nucleotide codes.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
CUT_MARKS = "^_"


def motif_pattern(motif: str) -> str:
    """Regular expression of a restriction motif; the cut marks are left out.

    >>> motif_pattern("G^CWG_C")
    'GC[AT]GC'
    """
    classes = [IUPAC[c] for c in motif.upper() if c not in CUT_MARKS]
    return "".join(c if len(c) == 1 else f"[{c}]" for c in classes)


def remaining_motif(motif: str) -> str:
    """What stays on the fragment after the cut at ``^``.

    >>> motif_pattern(remaining_motif("G^CWG_C"))
    'C[AT]GC'
    """
    return motif.partition("^")[2].replace("_", "")


def motif_length(pattern: str) -> int:
    """Bases that a pattern spans; a class counts once.

    >>> motif_length("AAAC[AT]G[AT]C")
    8
    """
    import re

    return len(re.sub(r"\[[^]]*\]", "N", pattern))


def expand(pattern: str) -> list[str]:
    """Every concrete sequence of a pattern, in the order of its classes.

    >>> expand("AAAC[AT]GC")
    ['AAACAGC', 'AAACTGC']
    """
    import itertools
    import re

    parts = [m[1:-1] if m.startswith("[") else m for m in re.findall(r"\[[^]]*\]|.", pattern)]
    return ["".join(x) for x in itertools.product(*parts)]


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def mismatches_at(seq: Column, start: Column, pattern: Column) -> Column:
    """Substitutions between ``pattern`` and the bases of ``seq`` from ``start`` (1-based); short reads count as mismatches."""
    n = F.length(pattern)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when(F.substr(seq, start + i - 1, F.lit(1)) == F.substr(pattern, i, F.lit(1)), 0).otherwise(1),
    )


def find_fuzzy(seq: Column, pattern: Column, most: int, window: int | None = None) -> Column:
    """1-based start of the leftmost match with at most ``most`` substitutions, null if there is none."""
    room = F.least(F.length(seq), F.lit(window)) if window else F.length(seq)
    last = room - F.length(pattern) + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.try_element_at(F.filter(starts, lambda o: mismatches_at(seq, o, pattern) <= most), F.lit(1))


def insert_motif(seq: Column, at: Column, motif: Column) -> Column:
    """Overwrite bases from ``at`` (1-based) with a motif."""
    return F.overlay(seq, motif, at)
