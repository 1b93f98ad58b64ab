"""FASTQ and FASTA as Python data sources: byte ranges of files, read side by side, without a shuffle.

Plain files are cut into ranges of about ``rangeBytes``; a task finds the first record that starts in its range and reads on to the end
of the last one that does, even beyond the range. Compressed files (``.gz``) are one range. Nothing is lost in
silence: each record is checked, and a task also checks that the range behind its own begins where its own last record ends. A fault
is an error that names file and byte.

Both sources return ``file``, ``range_start`` (the range's first byte), ``no`` (the record's number in the range, from 0) and ``offset`` (its
first byte, of the unpacked file). Files are found through Arrow's file systems, so a path may be a local one or a URI, a file, a folder (read
with its subfolders, without names that begin with ``_`` or ``.``) or a pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
ROWS_AT_ONCE = 4096
PLACE = "file string, range_start long, no long, offset long"


class FaultyRecord(ValueError):
    """A record that is not whole or not well formed, with the file and the byte where it begins."""

    def __init__(self, what: str, file: str, offset: int) -> None:
        super().__init__(f"{what} in {file} at byte {offset}")


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int  # -1: the whole file


def file_system(path: str):
    """(Arrow file system, path in it)."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", path):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def find_files(path: str) -> list[tuple[str, int]]:
    """(file, size) of the files of a path, in order."""
    from pyarrow import fs

    system, inner = file_system(path)
    inner = inner.rstrip("/")
    parts = inner.split("/")
    fixed = next((k for k, p in enumerate(parts) if re.search(r"[*?\[]", p)), len(parts))
    base = "/".join(parts[:fixed]) or "/"
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
    glob = {"*": "[^/]*", "?": "[^/]"}
    pattern = re.compile("/".join("".join(x if len(x) > 1 else glob.get(x, re.escape(x)) for x in re.findall(r"\[[^]]+\]|.", p, re.S)) for p in parts) + "(/.*)?")
    shown = [f for f in found if f.type == fs.FileType.File and pattern.fullmatch(f.path) and not any(p[:1] in ("_", ".") for p in f.path[len(base) :].split("/"))]
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in shown)


class _Lines:
    """Lines of an input stream with the byte where each begins."""

    def __init__(self, stream, at: int) -> None:
        self.stream, self.at = stream, at

    def next(self) -> tuple[int, bytes | None]:
        at, line = self.at, self.stream.readline()
        self.at += len(line)
        return at, line.rstrip(b"\r\n") if line else None


def _opened(file: str, at: int = 0) -> _Lines:
    import gzip
    import io

    system, inner = file_system(file)
    raw = system.open_input_stream(inner, compression=None) if not at else system.open_input_file(inner)
    if at:
        raw.seek(at)
    if file.endswith(".gz"):
        raw = gzip.GzipFile(fileobj=raw)
    return _Lines(io.BufferedReader(raw, 1 << 20), at)


def _after_break(file: str, at: int) -> _Lines:
    """Lines from the first one that begins at or behind byte ``at``."""
    if not at:
        return _opened(file)
    lines = _opened(file, at - 1)
    lines.next()
    return lines


def fastq_start(file: str, at: int) -> int:
    """Where the first record at or behind byte ``at`` begins, or the end of the file.

    A head begins with ``@`` and the second line behind it with ``+``; a quality line may begin with ``@`` too, but the second line behind it
    is a sequence. One of four lines in a row is a head.
    """
    lines = _after_break(file, at)
    held = [lines.next() for _ in range(6)]
    for k in range(4):
        offset, line = held[k]
        if line is None:
            return offset
        if line.startswith(b"@") and (held[k + 2][1] or b"").startswith(b"+"):
            return offset
    if not any(line for _, line in held):
        return held[0][0]  # blank lines: the reader tells whether they end the file
    raise FaultyRecord("no record begins within four lines", file, held[0][0])


def fasta_start(file: str, at: int) -> int:
    lines = _after_break(file, at)
    while True:
        offset, line = lines.next()
        if line is None or line.startswith(b">"):
            return offset


def fastq_records(part: ByteRange) -> Iterator[tuple]:
    """(offset, read_id, seq, qual)."""
    file = part.file
    first = 0 if part.end < 0 else fastq_start(file, part.start)
    if 0 <= part.end <= first:
        return
    lines = _opened(file, first)
    while True:
        at, head = lines.next()
        if 0 <= part.end <= at:
            break
        if not head:
            while head == b"":  # blank lines may end a file
                _, head = lines.next()
            if head is not None:
                raise FaultyRecord("a blank line between records", file, at)
            return
        (_, seq), (_, plus), (_, qual) = (lines.next() for _ in range(3))
        if qual is None:
            raise FaultyRecord("the file ends inside a record", file, at)
        if not head.startswith(b"@"):
            raise FaultyRecord("a record that does not begin with @", file, at)
        if not plus.startswith(b"+") or plus[1:] not in (b"", head[1:]):
            raise FaultyRecord("a record without its + line", file, at)
        if len(seq) != len(qual):
            raise FaultyRecord("sequence and quality of unequal length", file, at)
        yield at, head[1:], seq, qual
    if (head is not None) and fastq_start(file, part.end) != at:
        raise FaultyRecord("what follows is no record", file, at)


def fasta_records(part: ByteRange) -> Iterator[tuple]:
    """(offset, name, seq); white space inside sequences is dropped."""
    file = part.file
    first = 0 if part.start == 0 else fasta_start(file, part.start)
    if 0 <= part.end <= first:
        return
    lines = _opened(file, first)
    name, begin, parts = None, first, []
    while True:
        at, line = lines.next()
        if line is None or line.startswith(b">"):
            if name is not None:
                yield begin, name, b"".join(parts)
            if line is None or 0 <= part.end <= at:
                return
            name, begin, parts = line[1:].strip(), at, []
        elif name is None:
            if line.strip():
                raise FaultyRecord("a sequence before the first name", file, at)
        else:
            parts.append(b"".join(line.split()))


class _RecordReader(DataSourceReader):
    def __init__(self, options, records, columns: list[str]) -> None:
        self.path, self.range_bytes = options.get("path"), int(options.get("rangeBytes") or RANGE_BYTES)
        self.records, self.columns = records, columns

    def partitions(self):
        out = []
        for file, size in find_files(self.path):
            if file.endswith(".gz") or size <= self.range_bytes:
                out.append(ByteRange(file, 0, -1))
            else:
                out.extend(ByteRange(file, k, min(size, k + self.range_bytes)) for k in range(0, size, self.range_bytes))
        return out or [ByteRange("", 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        if not partition.file:
            return
        names = ["file", "range_start", "no", "offset", *self.columns]

        def batch(rows, done):
            n = len(rows)
            offset, *texts = zip(*rows, strict=True)
            place = [pa.array([partition.file] * n), pa.array([partition.start] * n, pa.int64()), pa.array(range(done, done + n), pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays([*place, *(pa.array([x.decode("utf-8", "replace") for x in t], pa.string()) for t in texts)], names=names)

        rows, size, done = [], 0, 0
        for record in self.records(partition):
            rows.append(record)
            size += sum(map(len, record[1:]))
            if len(rows) == ROWS_AT_ONCE or size > 8 << 20:
                yield batch(rows, done)
                rows, size, done = [], 0, done + len(rows)
        if rows:
            yield batch(rows, done)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "genolake_fastq"

    def schema(self) -> str:
        return f"{PLACE}, read_id string, seq string, qual string"

    def reader(self, schema):
        return _RecordReader(self.options, fastq_records, ["read_id", "seq", "qual"])


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "genolake_fasta"

    def schema(self) -> str:
        return f"{PLACE}, name string, seq string"

    def reader(self, schema):
        return _RecordReader(self.options, fasta_records, ["name", "seq"])


def load(spark: SparkSession, source: type[DataSource], path: str, range_bytes: int | None = None) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name())
    if range_bytes:
        reader = reader.option("rangeBytes", str(range_bytes))
    return reader.load(path)
