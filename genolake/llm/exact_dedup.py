"""Exact dedup: tree-merge of sorted digest runs, in DataFrame operations only.

Every row is dealt to one of ``runs`` base runs (a power of two, as many as the cluster has shuffle partitions or more), in turn, whatever its
id. A run is the list of the distinct digests in it, sorted; each entry holds the best row so far (longest original text,
then smallest id) and the number of rows it stands for. The runs form a binomial tree: in round k run i takes over
the entries of run i + 2**k, for every i divisible by 2**(k+1). A round is one exchange, in which both runs' entries go to the slices of the
run that stays (parts by the digest, as many as the cluster has partitions, ``SLICES`` at least, so that late rounds are spread as well), are sorted there and merged in order: entries of equal
keys meet, the best row is retained and the counts add up. After log2(runs) rounds run 0 holds one entry per digest.

The decisions go back to the base runs in one join, as a digest has at most one entry per run, and from there to the rows, which
join by run and digest: a digest that holds a third of all rows is spread over all runs.

A key is the SHA-256 of the normalised text with its length and a second, independent hash of it, so an
entry is merged only when all three agree.

Defined results: null text counts as empty, so all null and blank texts are one group. Repeated rows count
one each; rows that tie in length and id (the same row twice) share their keep_id, and each of them counts as
kept. A null id is ordered after all others, so it is kept only in a group without other ids of that length.
Empty tables give empty results. A long text is hashed whole. Clashing extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genolake.session import checkpoint, partitions

KEY = ["sha", "n_chars_norm", "second_hash"]
#: Parts of a run that are merged apart, at least.
SLICES = 64
SPACES = r"[\x20\x09-\x0D]+"


def digest_runs(docs: DataFrame, runs: int) -> DataFrame:
    """Rows with their keys and runs. A row's run depends on its place in the table, so the result is kept in the checkpoint folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = docs.select("doc_id", F.length(text).alias("len"), F.regexp_replace(text, SPACES, "").alias("norm"))
    return norm.select(
        "doc_id",
        "len",
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.length("norm").alias("n_chars_norm"),
        F.xxhash64("norm").alias("second_hash"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(runs)).cast("int").alias("run"),
    )


def _merged(entries: DataFrame) -> DataFrame:
    """Equal keys of a run's slice merge; the best row (smallest rank) and the total stay."""
    return entries.groupBy("run", "slice", *KEY).agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))


def exchange(entries: DataFrame, k: int, n: int) -> DataFrame:
    """Round k: run i + 2**k goes to run i, and what meets in a slice is merged in the order of its keys."""
    step = F.shiftleft(F.lit(1), k)
    to = F.when(F.col("run").bitwiseAND(step) > 0, F.col("run") - step).otherwise(F.col("run"))
    dealt = entries.withColumn("run", to).repartition(n, "run", "slice")
    return _merged(dealt.sortWithinPartitions("run", "slice", *KEY))


def resolve(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """doc_id, len, keep_id, group_size, kept, text_sha256 for each row of ``docs``."""
    n = partitions(docs.sparkSession)
    rounds = max(1, (max(64, n) if runs is None else runs) - 1).bit_length()
    runs = 1 << rounds
    base = checkpoint(digest_runs(docs, runs))
    # The smallest struct wins: longest text, then ids before null, then the smallest id.
    best = F.struct((-F.col("len")).alias("neg_len"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    slices = F.pmod(F.col("second_hash"), F.lit(max(SLICES, n))).cast("int").alias("slice")
    level = held = _merged(base.select("run", slices, *KEY, best.alias("best"), F.lit(1).cast("long").alias("rows")))
    for k in range(rounds):
        level = exchange(level, k, n)
    decided = held.select("run", *KEY).join(level.select(*KEY, "best", "rows").hint("merge"), KEY)
    rows = base.join(decided, ["run", *KEY])
    return rows.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("len") == -F.col("best.neg_len"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "len",
    )


def report(docs: DataFrame) -> DataFrame:
    return resolve(docs).drop("len")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with the columns of the input.

    Of rows that are equal in id and text one stays.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_name")
    winners = resolve(docs).filter("kept").select(name, F.col("text_sha256").alias("_sha")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select(name, F.sha2(F.regexp_replace(text, SPACES, ""), 256).alias("_sha"), F.length(text).alias("_len"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    won = marked.join(winners.hint("merge"), ["_name", "_sha"], "left_semi")
    # Only rows that share id and digest meet here: the same row twice, or one id with two spellings.
    w = Window.partitionBy("_name", "_sha").orderBy(F.desc("_len"), F.xxhash64("_row"))
    return won.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST) AS keep_id,
         max(len) OVER (PARTITION BY text_sha256) AS top,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size,
       (doc_id IS NOT DISTINCT FROM keep_id AND len = top) AS kept, text_sha256 FROM k
"""
