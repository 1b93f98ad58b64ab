"""Quality rules: a threshold table compiled into one Spark projection.

Words are maximal runs of characters other than space, \\t, \\n, \\x0b, \\f and \\r. Every rule is a row of
``RULES``: a ratio of two measured counts is compared with a bound, without division, so that the verdict
is a pure integer expression. All measures are built-in expressions; no user function runs.

Defined results: a null text counts as empty (0 words; it fails the length rule). Empty tables give empty
results. Repeated rows and tied ids are judged row by row, each on its own. Very long texts take
n log n steps. Columns of the input whose names clash with the measures are ignored by the report
(``measure`` reads the two named columns only) and kept as they are by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that was on with as at by be for are an it or this from "
    "die der und das zu von ist nicht mit den ein eine auf im dem des auch "
    "de la le les et un une du est en que pour par pas dans au "
    "el los las y una con del se su es lo por"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when 100 * ``count`` is above (or below) ``percent`` * ``of``."""

    name: str
    count: str
    side: str  # "above" or "below"
    percent: int
    of: str

    def fails(self, c: dict[str, Column]) -> Column:
        left, right = 100 * c[self.count], self.percent * c[self.of]
        return left > right if self.side == "above" else left < right


#: The two base rules, then the method's own ratios.
BASE_RULES = (
    Rule("too_short", "n_words", "below", 1000, "one"),
    Rule("repeated_windows", "n_repeat_words", "above", 20, "n_words"),
)
RULES = (
    Rule("mean_word_short", "word_chars", "below", 200, "n_words"),
    Rule("mean_word_long", "word_chars", "above", 1200, "n_words"),
    Rule("symbol_ratio", "n_symbols", "above", 10, "n_words"),
    Rule("stop_word_ratio", "n_stop_words", "below", 5, "n_words"),
    Rule("duplicate_line_ratio", "n_dup_lines", "above", 40, "n_lines"),
)


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _covered(starts: Column, width: int) -> Column:
    """How many positions the windows at these ascending starts cover."""
    gaps = F.transform(starts, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - x, F.lit(width))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)


def _repeat_words(words: Column, hashes: Column, width: int = 5) -> Column:
    """Words inside windows whose word sequence occurs twice or more in the text.

    Equal windows have equal hashes, so a text without equal hashes has none; the others are sorted
    by their real words.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - width),
        lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, width)).alias("w"), i.alias("i")),
    )
    twice = lambda s: F.filter(
        s,
        lambda x, k: F.coalesce(x["w"] == F.get(s, k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, k + 1)["w"], F.lit(False)),
    )
    starts = lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"]))
    slow = let(F.sort_array(windows), lambda s: let(starts(s), lambda p: _covered(p, width)))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), slow).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the id (and ``keep`` columns in a struct ``_row``), counts and verdicts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = [F.col(id_col), text.alias("_text"), F.array_remove(F.split(text, SPACE), "").alias("_words")]
    if keep:
        first.append(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"))
    carried = ["_row"] if keep else []
    d = docs.select(*first)
    hashed = F.transform(
        F.col("_words"), lambda w, i: F.xxhash64(w, *[F.get(F.col("_words"), i + j) for j in range(1, 5)])
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(NOT_SPACE))
    d = d.select(id_col, *carried, "_text", "_words", F.slice(hashed, F.lit(1), F.greatest(F.size("_words") - 4, F.lit(0))).alias("_hashes"), lines.alias("_lines"))
    d = d.select(
        id_col,
        *carried,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words"), F.col("_hashes")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    c = {k: F.col(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")} | {"one": F.lit(1)}
    any_of = lambda rules: F.greatest(*[r.fails(c).cast("int") for r in rules]) > 0
    base = any_of(BASE_RULES)
    reasons = F.array_compact(F.array(*[F.when(r.fails(c), r.name) for r in BASE_RULES + RULES]))
    return d.select("*", base.alias("base_failed"), (~base & ~any_of(RULES)).alias("kept"), reasons.alias("failed_rules"))


def report(docs: DataFrame) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"]
    return measure(docs).select(cols)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass every rule, with the columns of the input.

    The row number keeps the optimiser from copying the measures into the filter, where they would be
    computed over and over (a filter is not moved below a projection that is not deterministic).
    """
    measured = measure(docs, keep=docs.columns).select("_row", "kept", F.monotonically_increasing_id().alias("_n"))
    return measured.filter("kept and _n >= 0").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


#: DuckDB. Windows are compared by their words; a position counts when any of the 5 windows over it repeats.
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, [x FOR x IN string_split_regex(t, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS words,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines
  FROM d
), win AS (
  SELECT rid, i, array_to_string(words[i:i+4], ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n >= 2
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len([x FOR x IN words IF list_contains([{", ".join(f"'{s}'" for s in STOP_WORDS)}], lower(x))]) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN cov USING (rid)
), v AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * word_chars < 200 * n_words OR 100 * word_chars > 1200 * n_words
         OR 100 * n_symbols > 10 * n_words OR 100 * n_stop_words < 5 * n_words OR 100 * n_dup_lines > 40 * n_lines) AS kept,
       n_lines, n_stop_words
FROM v
"""
