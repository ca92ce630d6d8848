"""FASTQ files as a Spark data source: plain text, gzip (several members) and block gzip, on any file system that Arrow reads.

Plain and block-gzip files are read in ranges of bytes; nothing but the first bytes of a file is read to plan them. A range owns the
records that begin after a line end inside it. Where its first record begins it finds by itself: a line of @ alone
doesn't tell, as @ is a quality too, so a record begins where line 1 starts with @, line 3 with + and lines 2 and 4
are equally long. When a range is done it looks where the next one will begin, and fails if lines between would be left out.
Ranges and whole files go through the same reader. Ordinary gzip can't be split: one partition per file.

    register(spark)
    spark.read.format("fastq").load("/reads/*.fastq.gz")

Columns: path, record (place within the partition's part of the file), part, name, seq, strand, qual. ``ordinals`` numbers the
records of a file from 0 by counting the parts first.
"""

from __future__ import annotations

import fnmatch
import os
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, part int, record long, name string, seq string, strand string, qual string"
RANGE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Fixed value: the empty block that ends a block-gzip file.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class FormatError(ValueError):
    """The file isn't the FASTQ it should be."""


def check(lines: list[str], where: str) -> tuple[str, str, str, str]:
    """One record of four lines, or an error that says what is wrong."""
    name, seq, strand, qual = lines
    if not name.startswith("@"):
        raise FormatError(f"{where}: a name must start with @, found {name[:40]!r}")
    if not strand.startswith("+"):
        raise FormatError(f"{where}: the third line must start with +, found {strand[:40]!r}")
    if len(seq) != len(qual):
        raise FormatError(f"{where}: {len(seq)} bases but {len(qual)} qualities in {name[:60]!r}")
    if any(not "!" <= c <= "~" for c in qual):
        raise FormatError(f"{where}: a quality outside 33 to 126 in {name[:60]!r}")
    return name, seq, strand, qual


def on(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme, the local one."""
    if "://" in path and not path.startswith("file://"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file://"))


def matching(pattern: str) -> list[str]:
    """Paths of the files that a pattern names, with * ? [ ] in their last part."""
    system, path = on(pattern)
    head, _, last = path.rpartition("/")
    if not any(c in last for c in "*?["):
        return [pattern] if system.get_file_info(path).type == fs.FileType.File else []
    prefix = pattern[: len(pattern) - len(last)]
    return sorted(prefix + f.base_name for f in system.get_file_info(fs.FileSelector(head or "/", allow_not_found=True)) if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, last))


Line = tuple[int, bytes]


def _lines(chunks: Iterator[bytes], place: int, end: bytes) -> Iterator[Line]:
    """Lines with the place each begins at, without their ends. The last one may lack its end."""
    rest = b""
    for more in chunks:
        pieces = (rest + more).split(end)
        rest = pieces.pop()
        for p in pieces:
            yield place, p.rstrip(b"\r")
            place += len(p) + 1
    if rest:
        yield place, rest.rstrip(b"\r")


def _record_at(window: list[Line]) -> bool:
    """Whether four lines (three where the file ends with an empty read that lacks its last line) are a record."""
    a, b, c, d = ([x for _, x in window] + [b""])[:4]
    return a.startswith(b"@") and c.startswith(b"+") and len(b) == len(d)


def _first(lines: Iterator[Line], where: str) -> list[Line]:
    """The lines of the first record, or none. Lines before it are left out: they are the end of a record that another range owns."""
    window: deque[Line] = deque()
    passed = 0
    for line in lines:
        window.append(line)
        if len(window) == 4:
            if _record_at([*window]):
                return [*window]
            passed += bool(window.popleft()[1])
            if passed > 64:
                raise FormatError(f"{where}: no record near byte {line[0]}")
    return [*window] if len(window) == 3 and _record_at([*window]) else []


def owned(lines: Iterator[Line], at_start: bool, own, where: str):
    """Records that begin no later than ``own()``. Blank lines before, between and after records are skipped."""
    after: list[Line] = []  # lines that begin behind the range
    ready: deque[Line] = deque()
    if not at_start:
        next(lines, None)  # the line that the range begins in
        ready.extend(_first(lines, where))
        if not ready or ready[0][0] > own():
            return

    def take() -> Line | None:
        if ready:
            return ready.popleft()
        return next(lines, None)

    while True:
        line = take()
        while line is not None and not line[1]:
            if line[0] > own():
                after.append(line)
            line = take()
        if line is None:
            return
        if line[0] > own():
            break
        record = [line]
        while len(record) < 4 and (line := take()) is not None:
            record.append(line)
        if len(record) < 4 and not (len(record) == 3 and not record[1][1]):
            raise FormatError(f"{where}: the last record is cut off after {len(record)} lines")
        after += [x for x in record if x[0] > own()]
        yield check(([x.decode("latin-1") for _, x in record] + [""])[:4], where)

    def rest():
        yield from after
        yield line
        yield from lines

    begins = _first(rest(), where)
    if not begins or begins[0][0] != line[0]:  # the next range would leave out what stands here
        raise FormatError(f"{where}: no record at byte {line[0]}: {line[1][:40]!r}")


@dataclass
class Part(InputPartition):
    path: str
    kind: str
    begin: int
    end: int
    number: int
    line_end: bytes = b"\n"


def plan(path: str, size: int = RANGE_BYTES) -> list[Part]:
    """The parts of a file that can be read on their own. Lines end as the file's first line does."""
    system, name = on(path)
    with system.open_input_file(name) as f:
        total, head = f.size(), f.read(18)
        kind = "plain" if head[:2] != b"\x1f\x8b" else "bgzf" if _is_block(head) else "gzip"
        whole = Part(path, kind, 0, total, 0)
        end = _line_end({"plain": _chunks, "bgzf": _block_texts, "gzip": _gzip_texts}[kind](f, whole))
    if kind == "gzip":
        return [Part(path, kind, 0, -1, 0, end)]
    return [Part(path, kind, a, min(a + size, total), i, end) for i, a in enumerate(range(0, max(total, 1), size))]


def _line_end(chunks: Iterator[bytes]) -> bytes:
    """A bare \\r where one ends the first line that isn't blank, else \\n."""
    head = b""
    for more in chunks:
        head += more
        text = head.lstrip(b"\r\n")
        at = text.find(b"\r")
        if 0 <= text.find(b"\n") < at or (at < 0 and b"\n" in text):
            return b"\n"
        if 0 <= at < len(text) - 1:
            return b"\n" if text[at + 1 : at + 2] == b"\n" else b"\r"
    return b"\n" if b"\n" in head or b"\r" not in head else b"\r"


def _chunks(f, part: Part) -> Iterator[bytes]:
    f.seek(part.begin)
    while more := f.read(CHUNK):
        yield more


def _plain(part: Part):
    system, name = on(part.path)
    with system.open_input_file(name) as f:
        yield from owned(_lines(_chunks(f, part), part.begin, part.line_end), part.begin == 0, lambda: part.end, part.path)


def _is_block(head: bytes) -> bool:
    return len(head) >= 18 and head[:4] == b"\x1f\x8b\x08\x04" and head[12:16] == b"BC\x02\x00"


def _block_size(head: bytes) -> int:
    return struct.unpack("<H", head[16:18])[0] + 1


def _head(f, at: int) -> bytes:
    f.seek(at)
    return f.read(18)


def _next_block(f, at: int, end: int, total: int) -> int:
    """Where the first block begins at or after ``at`` and before ``end``, or ``end``: its header is followed by another block's, or ends the file."""
    f.seek(at)
    data = f.read(min(end + 18, total) - at)
    place = data.find(b"\x1f\x8b\x08\x04")
    while 0 <= place < end - at:
        head = data[place : place + 18]
        if _is_block(head):
            after = at + place + _block_size(head)
            if after == total or after < total and _is_block(_head(f, after)):
                return at + place
        place = data.find(b"\x1f\x8b\x08\x04", place + 1)
    return end


def _block_texts(f, part: Part, own: list | None = None) -> Iterator[bytes]:
    """Texts of the blocks from the first one in the part to the end of the file; own[0] becomes the length of those that begin in the part."""
    at, length, total = part.begin, 0, f.size()
    if at:
        at = _next_block(f, at, part.end, total)
        if at >= part.end:
            return
    while at < total:
        if own and at >= part.end:
            own[0] = min(own[0], length)
        head = _head(f, at)
        if not _is_block(head):
            raise FormatError(f"{part.path}: no block at byte {at}")
        f.seek(at)
        try:
            text = zlib.decompress(f.read(_block_size(head)), 31)
        except zlib.error as e:
            raise FormatError(f"{part.path}: broken gzip data: {e}") from e
        at += _block_size(head)
        length += len(text)
        yield text


def _bgzf(part: Part):
    """Records that begin in the blocks that begin in the part; the last one may end in later blocks."""
    system, name = on(part.path)
    own = [float("inf")]
    with system.open_input_file(name) as f:
        yield from owned(_lines(_block_texts(f, part, own), 0, part.line_end), part.begin == 0, lambda: own[0], part.path)


def _gzip_texts(f, part: Part) -> Iterator[bytes]:
    f.seek(0)
    ready, data = None, b""
    while True:
        data = data or f.read(CHUNK)
        if not data:
            if ready is not None:
                raise FormatError(f"{part.path}: broken gzip data: it ends too soon")
            return
        if ready is None:  # several members follow each other; zeros may stand between
            data = data.lstrip(b"\0")
            if not data:
                continue
            ready = zlib.decompressobj(31)
        try:
            text = ready.decompress(data)
        except zlib.error as e:
            raise FormatError(f"{part.path}: broken gzip data: {e}") from e
        data, ready = (ready.unused_data, None) if ready.eof else (b"", ready)
        yield text


def _gzip(part: Part):
    system, name = on(part.path)
    with system.open_input_file(name) as f:
        yield from owned(_lines(_gzip_texts(f, part), 0, part.line_end), True, lambda: float("inf"), part.path)


def read_part(part: Part):
    for n, r in enumerate({"plain": _plain, "bgzf": _bgzf, "gzip": _gzip}[part.kind](part)):
        yield (part.path, part.number, n, *r)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        paths = sorted(p for x in self.options["path"].split(",") for p in matching(x))
        if not paths:
            raise FileNotFoundError(self.options["path"])
        size = int(self.options.get("rangeBytes", RANGE_BYTES))
        return [part for p in paths for part in plan(p, size)]

    def read(self, partition):
        yield from read_part(partition)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceWriter):
    """One file per task: part-00000.fastq or .fastq.gz (block gzip). Files get their final names when all tasks are done."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level = int(options.get("level", 4))
        self.gz = options.get("compression", "none") in ("gzip", "bgzf")

    def write(self, iterator):
        from pyspark import TaskContext

        system, folder = on(self.path)
        system.create_dir(folder, recursive=True)
        ctx = TaskContext.get()
        name = f"{folder}/.part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}.fastq" + (".gz" if self.gz else "")
        rows = 0
        with system.open_output_stream(name, compression=None) as f:
            held = bytearray()
            for r in iterator:
                held += f"{r.name}\n{r.seq}\n{r.strand}\n{r.qual}\n".encode("latin-1", "replace")
                rows += 1
                while len(held) >= 60_000:
                    f.write(bgzf_block(bytes(held[:60_000]), self.level) if self.gz else bytes(held[:60_000]))
                    del held[:60_000]
            if held:
                f.write(bgzf_block(bytes(held), self.level) if self.gz else bytes(held))
            if self.gz:
                f.write(BGZF_END)
        return _Written(name, rows)

    def commit(self, messages):
        system, folder = on(self.path)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if old.base_name.startswith("part-"):
                    system.delete_file(old.path)
        for m in messages:
            if m:
                stem = os.path.basename(m.path)[1:]
                head, _, rest = stem.rpartition("-")
                system.move(m.path, f"{folder}/{head}{rest[rest.index('.') :]}")

    def abort(self, messages):
        system, _ = on(self.path)
        for m in messages:
            if m and system.get_file_info(m.path).type == fs.FileType.File:
                system.delete_file(m.path)


def bgzf_block(data: bytes, level: int = 4) -> bytes:
    """One block of a block-gzip file."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = len(body) + 25
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", size) + body + struct.pack("<II", zlib.crc32(data), len(data))


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def ordinals(df: DataFrame) -> DataFrame:
    """Reads with read_id: their place in the file. The parts are counted first; there is one row per part on the driver."""
    sizes = df.groupBy("path", "part").agg(F.count(F.lit(1)).alias("n")).orderBy("path", "part").collect()
    rows, path, total = [], None, 0
    for r in sizes:
        if r["path"] != path:
            path, total = r["path"], 0
        rows.append((r["path"], r["part"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(rows, "path string, part int, before long")
    return df.join(F.broadcast(offsets), ["path", "part"]).select((F.col("before") + F.col("record")).alias("read_id"), "path", "name", "seq", "strand", "qual")
