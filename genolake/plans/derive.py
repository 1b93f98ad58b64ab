"""Genomic views of the driver's tables: each as a DataFrame and as a SQL common table expression.

Every row of the source table gives a row of the view, so the work of a query grows with its input. The two
forms of a view use expressions that Spark and the checking engine share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genolake.session import table

DNA = "translate(md5({0}), '0123456789abcdef', 'ACGTACGTACGTACGT')"

#: name: (source tables, SQL of the view). ``CAST(... AS STRING)`` is understood by both engines.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "reads": (
        ("orders",),
        f"""SELECT o_orderkey AS read_id, {DNA.format("CAST(o_orderkey AS STRING)")} AS seq,
        {DNA.format("concat('r2-', CAST(o_orderkey AS STRING))")} AS seq2 FROM orders""",
    ),
    "tags": (
        ("nation",),
        """SELECT n_name AS sample, n_nationkey AS tag_rank, concat(substr('ACGT', CAST(floor(n_nationkey / 16) AS INT) % 4 + 1, 1),
        substr('ACGT', CAST(floor(n_nationkey / 4) AS INT) % 4 + 1, 1), substr('ACGT', n_nationkey % 4 + 1, 1)) AS tag FROM nation""",
    ),
    "plate_tags": (("supplier",), f"""SELECT s_name AS sample, s_suppkey AS tag_rank, substr({DNA.format("concat('plate', CAST(s_suppkey AS STRING))")}, 1, CAST(5 + s_suppkey % 3 AS INT)) AS tag FROM supplier"""),
    # As many tags as reads, of 10 or 11 bases.
    "well_tags": (("orders",), f"""SELECT concat('w', CAST(o_orderkey AS STRING)) AS sample, o_orderkey AS tag_rank, substr({DNA.format("concat('well', CAST(o_orderkey AS STRING))")}, 1, CAST(10 + o_orderkey % 2 AS INT)) AS tag FROM orders"""),
    "long_tags": (
        ("nation",),
        f"""SELECT n_name AS sample, n_nationkey AS tag_rank, substr({DNA.format("concat('tag', CAST(n_nationkey AS STRING))")}, 1, 5) AS tag FROM nation""",
    ),
    "adapters": (("region",), f"""SELECT r_name AS adapter, substr({DNA.format("concat('adp', CAST(r_regionkey AS STRING))")}, 1, 4) AS adp_seq, r_regionkey AS adp_rank FROM region"""),
    "exons": (
        ("lineitem",),
        """SELECT l_partkey AS gene, l_returnflag AS sample, l_orderkey * 10 + l_linenumber AS exon_start,
        l_orderkey * 10 + l_linenumber + 100 + l_partkey % 50 AS exon_end, CAST(l_quantity AS BIGINT) AS n FROM lineitem""",
    ),
    "alignments": (
        ("lineitem",),
        """SELECT concat('q', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber % 2 AS STRING)) AS qname,
        CAST(CASE WHEN l_orderkey % 11 = 0 THEN 4 WHEN l_linenumber % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN l_suppkey % 7 = 0 THEN 256 ELSE 0 END AS INT) AS flag,
        concat('chr', CAST(l_suppkey % 22 + 1 AS STRING)) AS rname, l_orderkey * 7 + l_linenumber AS pos, CAST(l_quantity AS INT) AS mapq,
        CASE WHEN l_partkey % 5 = 0 THEN 'R' ELSE 'U' END AS xt, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(1 + l_partkey % 2 AS INT) END AS x0,
        CAST(l_suppkey % 2 AS INT) AS x1, CAST(l_quantity AS INT) % 6 AS nm, CAST(floor(l_extendedprice) AS BIGINT) % 700 - 350 AS tlen,
        30 + l_orderkey % 70 AS seq_len, l_shipmode_lane AS lane FROM (SELECT *, l_linestatus AS l_shipmode_lane FROM lineitem)""",
    ),
    # Each order is a marker of a line (customer) and a block of 50 markers.
    "genotypes": (
        ("orders",),
        """SELECT o_custkey % 60 AS ind, o_custkey % 10 + 1 AS chrom, CAST(floor(o_orderkey / 60) AS BIGINT) AS snp,
        CAST(ascii(substr(md5(CAST(o_orderkey AS STRING)), 1, 1)) % 3 AS INT) AS g, o_orderkey AS rec FROM orders""",
    ),
    "doses": (
        ("orders",),
        """SELECT o_orderkey % 60 AS ind, CAST(floor(o_orderkey / 60) AS BIGINT) AS snp, CAST(floor(o_orderkey / 1800) AS BIGINT) AS block,
        CAST(ascii(substr(md5(CAST(o_orderkey AS STRING)), 1, 1)) % 3 AS INT) AS g FROM orders""",
    ),
    "calls": (
        ("orders",),
        """SELECT o_orderkey AS rec, o_custkey AS ind, CAST(floor(o_orderkey / 60) AS BIGINT) AS snp, 'A' AS a1, 'G' AS a2,
        CASE o_custkey % 5 WHEN 0 THEN 'AA' WHEN 1 THEN 'AG' WHEN 2 THEN 'GA' WHEN 3 THEN 'GG' ELSE 'NN' END AS call FROM orders""",
    ),
    "snps": (
        ("part",),
        """SELECT p_partkey AS snp, concat('chr', CAST(p_partkey % 22 + 1 AS STRING)) AS chrom, CAST(p_partkey * 1000 + p_size * 37 AS BIGINT) AS pos FROM part""",
    ),
    "genes": (
        ("supplier",),
        """SELECT s_suppkey AS gene, concat('chr', CAST(s_suppkey % 22 + 1 AS STRING)) AS chrom, CAST(s_suppkey * 20000 AS BIGINT) AS tss FROM supplier""",
    ),
    "tests": (
        ("orders",),
        """SELECT o_custkey AS gene, o_orderkey AS snp, (o_totalprice - (SELECT min(o_totalprice) FROM orders)) /
        ((SELECT max(o_totalprice) FROM orders) - (SELECT min(o_totalprice) FROM orders)) AS p FROM orders""",
    ),
    "phenotypes": (
        ("events",),
        """SELECT event_id AS rec, user_id AS ind, CAST(2010 + event_id % 10 AS INT) AS year, event_type AS plot, event_type = 'error' AS pathogen,
        value AS trait1, value * 0.5 + event_id % 17 AS trait2, CAST(user_id % 3 = 0 AS INT) AS trait3 FROM events""",
    ),
    "expression": (
        ("lineitem",),
        """SELECT l_partkey AS gene, l_suppkey % 10 AS ind, l_returnflag AS subgroup, avg(l_extendedprice) AS v FROM lineitem GROUP BY l_partkey, l_suppkey % 10, l_returnflag""",
    ),
    "sites": (
        ("lineitem",),
        """SELECT l_orderkey AS site, l_linenumber AS ind, CAST(l_quantity AS INT) AS dp, CAST(floor(l_extendedprice) AS BIGINT) % 100 AS gq,
        l_discount * 30 AS qd, CAST(l_partkey % 80 AS DOUBLE) AS fs, CAST(20 + l_suppkey % 40 AS DOUBLE) AS mq,
        CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_partkey % 30 - 20 AS DOUBLE) END AS mqranksum, CAST(l_suppkey % 20 - 12 AS DOUBLE) AS readposranksum,
        CAST(l_partkey % 16 AS DOUBLE) AS haplotypescore, l_tax * 70 AS sor, CAST(l_partkey % 4 AS INT) AS gt FROM lineitem""",
    ),
    "qc_quality": (("events",), """SELECT event_type AS dataset, CAST(event_id % 50 + 1 AS INT) AS quality, CAST(user_id AS BIGINT) AS n FROM events"""),
    "ledger": (("events",), """SELECT concat('breeder', CAST(user_id % 12 AS STRING)) AS breeder, event_type AS task, CAST(1 + event_id % 7 AS BIGINT) AS quantity FROM events"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    return spark.sql("SELECT * FROM (" + sql.replace("FROM " + tables[0], "FROM {" + tables[0] + "}") + ")", **{t: table(spark, sf_dir, t) for t in tables})


def cte(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in names) + "\n"
