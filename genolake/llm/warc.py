"""WARC: converter of legacy ARC archives.

An ARC file begins with a ``filedesc`` record whose body names the version: 1 has header lines of 5 fields, 2 of
10 fields. Records follow one another by the length that their header line declares; nothing is searched for
in the contents. Each becomes a WARC record: a response, or a revisit where the same payload of ``least`` bytes
or more is kept by another record (the one with the largest page id), or a resource if it is not HTTP.
Identifiers are name-based UUIDs of archive and offset, dates come from the 14 digits, digests are SHA-1.

Archives are read as gzip of one member or of a member per record, or plain; contents are bytes and may be anything. One ARC
file becomes one WARC file, so an archive is never sent record by record. Archives written here hold about ``ARCHIVE_BYTES`` each, in the
folder shared by the cluster, and are named by partition and number: the same archives give the same record ids again.
Which record keeps a payload is decided on digests alone, summed up per archive before they meet: a digest has at most one row
per archive, however many records hold it, and a record's target is looked up in the same way when archives are read back.

Defined results: null html is an empty payload; a null url becomes ``urn:page:<id>``. White space in urls is
percent-encoded, as the header line is cut at spaces. Repeated page ids are all written; equal payloads under the
largest page id are all responses. A null page id ranks below all others; where no record of a payload has an id, as in
archives made elsewhere, the last one by archive and offset is the response. Empty tables give empty
results. A payload longer than ``ARCHIVE_BYTES`` has an archive of its own. Header lines may end in CRLF or in LF. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolake.session import checkpoint, drop, scratch

ARCHIVE_BYTES = 4 << 20
LEAST_REVISIT = 1000
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
# The field lines of the two versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


# --- ARC ---------------------------------------------------------------------------------------------------


def arc_header(version: int, url: str, ip: str, date: str, mime: str, status: int, offset: int, name: str, length: int) -> str:
    middle = f" {status} - - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{middle} {length}\n"


def arc_file(version: int, name: str, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """The whole file, without its last line feed: (url, ip, date, block) each."""
    body = f"{version} 0 genolake\n{ARC_FIELDS[version]}\n"
    date = records[0][2] if records else "19700101000000"
    out = [(arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", 200, 0, name, len(body)) + body).encode()]
    size = len(out[0]) + 1
    for url, ip, date, block in records:
        out.append(arc_header(version, url, ip, date, "text/html", 200, size, name, len(block)).encode() + block)
        size += len(out[-1]) + 1
    return b"\n".join(out)


def parse_arc_line(line: bytes, version: int) -> dict:
    """Fields of a header line. Lengths stand last; what a content type holds in spaces stays in it."""
    f = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    tail = 1 if version == 1 else 6
    if len(f) < 4 + tail:
        raise ValueError(f"not an ARC version {version} header line: {line[:80]!r}")
    out = {"url": f[0], "ip": f[1], "date": f[2], "mime": " ".join(f[3:-tail]), "length": int(f[-1]), "status": None}
    if version == 2:
        out["status"] = int(f[-6]) if f[-6].isdigit() else None
    return out


def parse_arc(data: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, fields, block) of each record, the file description first; an empty file has none."""
    if not data:
        return
    end = data.index(b"\n")
    first = parse_arc_line(data[: end + 1], 2 if len(data[:end].split(b" ")) >= 10 else 1)
    block = data[end + 1 : end + 1 + first["length"]]
    version = int(block.split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version}")
    yield 0, first, block
    at = end + 1 + first["length"]
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        fields = parse_arc_line(data[at : end + 1], version)
        block = data[end + 1 : end + 1 + fields["length"]]
        if len(block) < fields["length"]:
            raise ValueError(f"record at {at} declares {fields['length']} bytes, {len(block)} follow")
        yield at, fields, block
        at = end + 1 + fields["length"]


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """Header with its blank line, and payload; None if it is not an HTTP message. Lines may end in CRLF or, as old servers sent them, in LF."""
    if not block.startswith(b"HTTP/"):
        return None
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def http_field(head: bytes, name: bytes) -> str | None:
    for line in re.split(rb"\r?\n", head)[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower():
            return value.strip().decode("utf-8", "replace")
    return None


# --- WARC --------------------------------------------------------------------------------------------------


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive}#{offset}')}>"


def warc_date(digits: str) -> str:
    d = (digits + "00000101000000"[len(digits) :]) if len(digits) < 14 else digits[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, rid: str, date: str, uri: str, ip: str, mime: str, block: bytes, extra: list[tuple[str, str]] = ()) -> bytes:
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", rid),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-IP-Address", ip),
        *extra,
        ("WARC-Block-Digest", base32_sha1(block)),
        ("Content-Type", mime),
        ("Content-Length", str(len(block))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


# --- Spark -------------------------------------------------------------------------------------------------


def _write(files: DataFrame, path: str) -> None:
    """One gzip file per row; the text sink writes the bytes of a string as they are, and a line feed."""
    texts = files.select(F.col("value").cast("string").alias("value"))
    texts.write.option("compression", "gzip").option("maxRecordsPerFile", 1).option("zlib.compress.level", "BEST_SPEED").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,arc,warc}").load(path).select("path", "content")


def inflate(content: bytes) -> bytes:
    """A file's bytes: every member of a gzip file, or the file itself."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(content) + member.flush())
        if not member.eof:
            raise ValueError("gzip member is cut off")
        content = member.unused_data.lstrip(b"\0")
    return b"".join(out) if out else content


def _rows(rows: list, schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def page_record(page: int | None, url: str | None, html: str | None) -> tuple[str, str, str, bytes]:
    """(url, ip, date, block) of a page as a server might have sent it."""
    payload = (html or "").encode("utf-8")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(payload)}\r\n\r\n"
    url = url if url is not None else f"urn:page:{page}"
    url = "".join(c if not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or "urn:page:none"
    second = (page or 0) % 86400
    return url, "0.0.0.0", f"19960923{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}", head.encode() + payload


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Pages as legacy archives of both versions."""

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, number, size = TaskContext.get().partitionId(), 0, 0
        held: list = []

        def file():
            return _rows([(arc_file(1 + number % 2, f"pages-{part:06d}-{number:06d}.arc", held),)], "value binary")

        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append(page_record(page, url, html))
                size += 150 + len(held[-1][3])
                if size >= archive_bytes:
                    yield file()
                    held, number, size = [], number + 1, 0
        if held:
            yield file()

    _write(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "value binary"), path)


ARC_SCHEMA = "path string, archive string, offset long, url string, ip string, date string, mime string, page_id long, head_bytes int, payload_bytes long, digest string"


def _records(path: str, content: bytes) -> Iterator[tuple[tuple, bytes]]:
    """(a row of ARC_SCHEMA, the block) of each record of an archive but its description, which names it."""
    archive = path.rsplit("/", 1)[-1]
    for offset, f, block in parse_arc(inflate(content)):
        if f["url"].startswith("filedesc:"):
            archive = f["url"].removeprefix("filedesc:").lstrip("/") or archive
            continue
        http = split_http(block)
        head, payload = http or (b"", block)
        page = http_field(head, b"X-Page-Id")
        facts = (int(page) if page and page.isdigit() else None, len(head) if http else None, len(payload), hashlib.sha1(payload).hexdigest())
        yield (path, archive, offset, f["url"], f["ip"], f["date"], f["mime"], *facts), block


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, without its content."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = [row for row, _ in _records(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())]
                for k in range(0, len(rows), 5000):
                    yield _rows(rows[k : k + 5000], ARC_SCHEMA)

    return _files(spark, path).mapInArrow(run, ARC_SCHEMA)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_REVISIT) -> None:
    """ARC archives in one folder to WARC archives in another."""
    facts = read_arc(spark, arc_path).filter(F.col("head_bytes").isNotNull() & (F.col("payload_bytes") >= least))
    payload = ["digest", "payload_bytes"]
    held = facts.groupBy("path", "archive", *payload).agg(F.max(F.struct("page_id", "offset")).alias("top"), F.collect_list(F.struct("page_id", "offset")).alias("members"))
    held = checkpoint(held)
    keeper = F.max(F.struct(F.col("top.page_id").alias("page_id"), "archive", F.col("top.offset").alias("offset"))).alias("keeper")
    keepers = held.groupBy(*payload).agg(keeper, F.sum(F.size("members")).alias("n")).filter("n > 1").drop("n")
    itself = lambda m: F.col("keeper.page_id").isNull() & (F.col("held.archive") == F.col("keeper.archive")) & (m["offset"] == F.col("keeper.offset"))
    others = F.filter("members", lambda m: ~(m["page_id"].eqNullSafe(F.col("keeper.page_id")) & (m["page_id"].isNotNull() | itself(m))))
    revisits = held.alias("held").join(keepers, payload).select("path", F.transform(others, lambda m: m["offset"]).alias("offsets"), F.col("keeper.archive").alias("archive"), F.col("keeper.offset").alias("offset"))
    marks = revisits.filter(F.size("offsets") > 0).groupBy("path").agg(F.collect_list(F.struct("offsets", "archive", "offset")).alias("marks"))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content, marks = (batch.column(k)[i].as_py() for k in range(3))
                target = {at: (m["archive"], m["offset"]) for m in marks or () for at in m["offsets"]}
                yield _rows([(warc_file(path, content, target),)], "value binary")

    _write(_files(spark, arc_path).join(marks.hint("merge"), "path", "left").select("path", "content", "marks").mapInArrow(run, "value binary"), warc_path)


def warc_file(path: str, content: bytes, target: dict[int, tuple[str, int]]) -> bytes:
    """The WARC form of an ARC file, without its last line feed; records at the offsets of ``target`` revisit (archive, offset)."""
    out: list[bytes] = []
    for (_, archive, offset, url, ip, date, mime, _, head_bytes, _, digest), block in _records(path, content):
        if not out:
            note = f"software: genolake\r\nformat: WARC File Format 1.1\r\ndescription: converted from {archive}\r\n".encode()
            out.append(warc_record("warcinfo", record_id(archive, 0), warc_date("19960923"), "", "", "application/warc-fields", note))
        rid, date = record_id(archive, offset), warc_date(date)
        if head_bytes is None:
            out.append(warc_record("resource", rid, date, url, ip, mime, block))
            continue
        extra = [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
        kind = "response"
        if offset in target:
            kind, block = "revisit", block[:head_bytes]
            extra += [("WARC-Refers-To", record_id(*target[offset])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        out.append(warc_record(kind, rid, date, url, ip, "application/http;msgtype=response", block, extra))
    return b"".join(out)[:-1]


WARC_SCHEMA = "path string, record_id string, refers_to_id string, record_type string, page_id long, payload_bytes long, payload_digest string, block_ok boolean"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record, from the archives alone."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows = batch.column(0)[i].as_py(), []
                for f, block in parse_warc(inflate(batch.column(1)[i].as_py())):
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block) or (b"", block)
                    page, declared = http_field(head, b"X-Page-Id"), http_field(head, b"Content-Length")
                    digest = base64.b32decode(f["warc-payload-digest"].partition(":")[2]).hex()
                    whole = f["warc-type"] == "response"
                    if whole and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {f['warc-record-id']} does not have its digest")
                    size = len(payload) if whole else int(declared or 0)
                    rows.append((name, f["warc-record-id"], f.get("warc-refers-to"), f["warc-type"], int(page) if page else None, size, digest, base32_sha1(block) == f["warc-block-digest"]))
                for k in range(0, len(rows), 5000):
                    yield _rows(rows[k : k + 5000], WARC_SCHEMA)

    return _files(spark, path).mapInArrow(run, WARC_SCHEMA)


def report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and back from WARC: one row per page."""
    folder = scratch(spark, "archives")
    write_arc(pages, f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    records = checkpoint(read_warc(spark, f"{folder}/warc"))
    drop(spark, folder)
    own = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses = records.filter("record_type = 'response'")
    revisits = records.filter("record_type = 'revisit'").groupBy("path", "refers_to_id").agg(F.collect_list(F.struct(*own)).alias("members"))
    targets = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    found = revisits.join(targets, "refers_to_id", "left").select(F.explode("members").alias("m"), "refers_to").select("m.*", "refers_to")
    return responses.select(*own, F.lit(None).cast("long").alias("refers_to")).union(found)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM k
"""
