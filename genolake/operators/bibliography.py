"""Web pages and bibliographic entries: extraction and rewriting of text fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def links(pages: DataFrame) -> DataFrame:
    """Targets of links, in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def inputs(pages: DataFrame, value: str = "fulltable") -> DataFrame:
    """Targets of the buttons whose value names the full table."""
    tag = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<input[^>]*>"), F.lit(0)))
    found = pages.select("page_id", tag.alias("tag")).filter(F.contains(F.lower(F.regexp_replace("tag", r"\s+", "")), F.lit(value)))
    return found.select("page_id", F.regexp_extract("tag", r"""(?i)window\.open\('([^']*)'""", 1).alias("target")).filter("target <> ''")


#: A link to an accession page and the table cell that follows it: accession and description are the two groups.
ACCESSION_ROW = r'<a href="[^"]*acc\.cgi\?acc=(GSM[0-9]+)"[^>]*>[^<]*</a></td>\s*<td[^>]*>([^<]*)</td>'


def accessions(pages: DataFrame, pattern: str = ACCESSION_ROW) -> DataFrame:
    """(accession, description) by the two groups of a pattern, in order of appearance."""
    both = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(pattern), F.lit(k)).alias(c) for k, c in ((1, "accession"), (2, "description"))])
    return pages.select("page_id", F.explode(both).alias("x")).select("page_id", "x.accession", "x.description")


def numeric_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Two-column rows of preformatted blocks whose second column is a number."""
    block = F.explode(F.regexp_extract_all(html, F.lit(r"(?s)<pre>(.*?)</pre>"), F.lit(1)))
    rows = pages.select("page_id", block.alias("block")).select("page_id", F.explode(F.split("block", "\n")).alias("line")).select("page_id", F.split("line", "\t").alias("f"))
    return rows.filter(F.size("f") == 2).select("page_id", F.col("f")[0].alias("name"), F.expr("try_cast(f[1] AS DOUBLE)").alias("value")).filter("value is not null")


def note_html(note: Column) -> Column:
    """Headings, lists and links of a plain note as HTML; the longer heading mark goes first."""
    out = F.regexp_replace(note, r"===([^=]+)===", "<h2>$1</h2>")
    out = F.regexp_replace(out, r"==([^=]+)==", "<h1>$1</h1>")
    out = F.regexp_replace(out, r"(?m)^\* (.*)$", "<li>$1</li>")
    return F.regexp_replace(out, r"(https?://[^\s<]+)", '<a href="$1">$1</a>')


def first_key(entries: DataFrame, known: DataFrame) -> DataFrame:
    """For each entry the first of its keys that the other file holds."""
    keys = entries.select("entry", F.posexplode("keys").alias("pos", "key"))
    hit = keys.join(known.select("key").distinct(), "key", "left_semi")
    return hit.groupBy("entry").agg(F.min_by("key", "pos").alias("key"))


def pdf_first(entries: DataFrame) -> DataFrame:
    """File names of an entry, PDFs before others, each kind in its order."""
    pdf = lambda x: F.lower(x).endswith(".pdf")
    return entries.select("entry", F.concat(F.filter("files", pdf), F.filter("files", lambda x: ~pdf(x))).alias("files"))


def ris_fields(records: DataFrame) -> DataFrame:
    """(entry, tag, pos, value) of records in RIS text, one line a field."""
    line = records.select("entry", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.rlike("line", F.lit("^[A-Z][A-Z0-9]  - ")))
    return line.select("entry", F.substring("line", 1, 2).alias("tag"), "pos", F.trim(F.substr("line", F.lit(7), F.length("line"))).alias("value")).filter("tag <> 'ER'")


def ris_records(fields: DataFrame) -> DataFrame:
    """(entry, id, fields): tag to values, files (L1 to L3) under ``files``; the id must be there and be unique."""
    from genolake.operators.relational import assert_unique

    named = fields.withColumn("tag", F.when(F.col("tag").isin("L1", "L2", "L3"), "files").otherwise(F.col("tag")))
    per = named.groupBy("entry", "tag").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("x"))
    rows = per.groupBy("entry").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.transform("x", lambda y: y["value"])))).alias("fields"))
    own = F.get(F.col("fields")["ID"], F.lit(0))
    rows = rows.withColumn("id", F.when(own.isNotNull(), own).otherwise(F.raise_error(F.concat(F.lit("record without id: "), F.col("entry").cast("string"))).cast("string")))
    return assert_unique(rows.select("entry", "id", "fields"), ["id"])


def ris_lines(fields: DataFrame) -> DataFrame:
    """(id, pos, line): records by lower-case id, their fields in order, several values on lines of their own.

    A record's first id reaches its fields by a window: the table of ids is as long as that of records, and a join with it may be planned as a broadcast.
    """
    first = F.min(F.when(F.col("tag") == "ID", F.struct("pos", "value"))).over(Window.partitionBy("entry"))
    lines = fields.filter("entry is not null").withColumn("_id", first).filter("_id is not null").select("_id.value", "pos", F.concat("tag", F.lit("  - "), "value").alias("line")).toDF("id", "pos", "line")
    return lines.orderBy(F.lower("id"), "id", "pos")


def ris_text(fields: DataFrame) -> DataFrame:
    """Records as RIS text, fields in their order."""
    parts = fields.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("pos", F.concat("tag", F.lit("  - "), "value").alias("line")))).alias("x"))
    return parts.select("entry", F.concat(F.array_join(F.transform("x", lambda y: y["line"]), "\n"), F.lit("\nER  - ")).alias("text"))


def bibtex_entries(texts: DataFrame) -> DataFrame:
    """(type, key, body) of the entries in BibTeX text, one entry per blank-line separated block."""
    block = texts.select(F.explode(F.split("text", r"\n(?=@)")).alias("block"))
    head = r"^@(\w+)\{([^,]+),"
    return block.filter(F.rlike("block", F.lit(head))).select(F.regexp_extract("block", head, 1).alias("type"), F.regexp_extract("block", head, 2).alias("key"), F.regexp_replace("block", head, "").alias("body"))


def bibtex_fields(texts: DataFrame) -> DataFrame:
    """(type, key, field, value) of BibTeX entries: a field a line, braces or quotes around its value; backslashes go."""
    entries = bibtex_entries(texts)
    line = entries.select("type", "key", F.explode(F.split("body", "\n")).alias("line"))
    pattern = r"""^\s*(\w+)\s*=\s*[{"]?(.*?)[}"]?\s*,?\s*}?\s*$"""
    got = line.filter(F.rlike("line", F.lit(r"^\s*\w+\s*="))).select("type", "key", F.lower(F.regexp_extract("line", pattern, 1)).alias("field"), F.regexp_extract("line", pattern, 2).alias("value"))
    return got.withColumn("value", F.replace("value", F.lit("\\"), F.lit("")))


def bibtex_text(fields: DataFrame) -> DataFrame:
    """(key, text): entries with their fields in alphabetical order, by lower-case key."""
    part = F.concat(F.lit("  "), "field", F.lit(" = {"), "value", F.lit("}"))
    per = fields.groupBy("type", "key").agg(F.sort_array(F.collect_list(F.struct("field", part.alias("line")))).alias("x"))
    text = F.concat(F.lit("@"), "type", F.lit("{"), "key", F.lit(",\n"), F.array_join(F.transform("x", lambda y: y["line"]), ",\n"), F.lit("\n}"))
    return per.select("key", text.alias("text")).orderBy(F.lower("key"), "key")


JSON_ENTRY = "article_id string, citation_keys array<string>, userfiles array<struct<name: string, sha1: string>>"


def read_json_entries(spark, path: str, schema: str = JSON_ENTRY) -> DataFrame:
    """Entries of a JSON array, or of one JSON object a line."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def entry_files(entries: DataFrame) -> DataFrame:
    """(article_id, key, files): the first citation key and the names of the files, PDFs before others."""
    pdf = lambda x: F.lower(x).endswith(".pdf")
    names = F.transform(F.coalesce("userfiles", F.array().cast("array<struct<name:string,sha1:string>>")), lambda f: f["name"])
    return entries.select("article_id", F.get("citation_keys", F.lit(0)).alias("key"), F.concat(F.filter(names, pdf), F.filter(names, lambda x: ~pdf(x))).alias("files"))
