"""Mail files as Spark data sources: tasks open and read them, the driver only lists names and sizes.

``mail_files`` has one row for each file, with what its first bytes tell.  ``mbox`` has one row for each
message: a task gets ranges of bytes and reads the messages that start in them, to their ends, so a large file is
read by many tasks and no message has to be put together afterwards.  What can't be read is a row with an error.
Unlike Spark's own sources these see names with a leading underscore.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from postlark.storage import materialize

#: Bytes of a task's ranges, what opening a file counts as, and files whose heads one task looks at.
RANGE_BYTES, OPEN_BYTES, HEADS = 128 << 20, 1 << 18, 500
#: Bytes in which line ends are looked for, and of a message's beginning that an index keeps.
HEAD, HEADER_BYTES = 65_536, 262_144
STEP = 4 << 20
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20

FILES = "path string, rel_path string, size_bytes long, kind string, eol string, error string"
MESSAGES = "file_path string, rel_path string, block long, mid long, offset long, size long, sep_line string, raw binary, error string"

_TIME = re.compile(rb"From .*[0-9]:[0-9][0-9]", re.DOTALL)
_TOKEN = re.compile(rb"[\x21-\x39\x3b-\x7e]*")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there."""
    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub("^/+", "/", uri.removeprefix("file:"))
    return fs.FileSystem.from_uri(uri)


def listed(root: str) -> list[tuple[str, int]]:
    """(path below the root, bytes) of all files; hidden ones (a leading dot) and marks of Spark's writers are left out."""
    system, base = opened(root)
    found = system.get_file_info(base)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if found.is_file:
        return [("", found.size)]
    prefix = base.rstrip("/") + "/"
    files = [(f.path.removeprefix(prefix), f.size) for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file]
    shown = lambda parts: not any(p.startswith(".") or p in ("_SUCCESS", "_temporary") for p in parts)
    return sorted((rel, size) for rel, size in files if shown(rel.split("/")))


def _read(file, at: int, size: int) -> bytes:
    data = file.read_at(size, at)
    if len(data) < size:
        raise EOFError("file is shorter than listed")
    return data


def line_end(head: bytes) -> bytes:
    """Line feeds if there is one, else carriage returns if there is one."""
    return b"\r" if b"\r" in head and b"\n" not in head else b"\n"


class _Ahead:
    """The bytes of a file from some place on, as far as they were needed."""

    def __init__(self, file, at: int, size: int):
        self.file, self.base, self.size, self.data = file, at, size, bytearray()

    def more(self) -> bool:
        at = self.base + len(self.data)
        step = min(max(STEP, len(self.data)), self.size - at)
        if step > 0:
            self.data += _read(self.file, at, step)
        return step > 0

    def drop(self, at: int) -> None:
        del self.data[:at - self.base]
        self.base = at


def _is_start(a: _Ahead, s: int, eol: bytes) -> bool:
    """Whether the 'From ' line at ``s`` starts a message: it has a time, and a header field follows, or nothing at all."""
    e = a.data.find(eol, s)
    while e < 0:
        known = len(a.data)
        e = a.data.find(eol, known) if a.more() else known
    if not _TIME.match(a.data, s, e):
        return False
    while len(a.data) <= e + 1:
        if not a.more():
            return True
    while True:
        stop = _TOKEN.match(a.data, e + 1).end()
        if stop < len(a.data) or not a.more():
            return stop > e + 1 and a.data[stop:stop + 1] == b":"


def _next_start(a: _Ahead, at: int, eol: bytes, limit: int | None = None) -> int | None:
    """The first start of a message at or behind ``at``, before ``limit``."""
    i = at - a.base
    while len(a.data) < 5 and a.more():
        pass
    if at == 0 and a.data[:5] == b"From " and _is_start(a, 0, eol):
        return 0
    while True:
        j = a.data.find(eol + b"From ", max(i - 1, 0))
        if j >= 0:
            if limit is not None and a.base + j + 1 >= limit:
                return None
            if _is_start(a, j + 1, eol):
                return a.base + j + 1
            i = j + 2
            continue
        i = max(i, len(a.data) - 4)
        if limit is not None:
            if a.base + i >= limit:
                return None
            gone = max(i - 1, 0)
            a.drop(a.base + gone)
            i -= gone
        if not a.more():
            return None


def messages_of(file, size: int, low: int, high: int) -> Iterator[tuple[int, int, int, str, bytes]]:
    """(place of the 'From ' line, place and number of the message's bytes, 'From ' line, bytes) of messages that start in a range.

    The line break before the next separator belongs to that; messages without bytes are left out.
    """
    head = _read(file, 0, min(size, HEAD))
    if head[:5] != b"From ":
        return
    eol = line_end(head)
    a = _Ahead(file, max(low - 1, 0), size)
    at = _next_start(a, low, eol, high)
    while at is not None and at < high:
        a.drop(at)
        after = _next_start(a, at + 1, eol)
        end = len(a.data) if after is None else after - at
        line = a.data.find(eol)
        body = line + 1 if line >= 0 else end
        if end > body and a.data[end - 1:end] == eol:
            end -= 1
        if eol == b"\n" and end > body and a.data[end - 1:end] == b"\r":
            end -= 1
        if end > body:
            yield at, at + body, end - body, bytes(a.data[:line]).removesuffix(b"\r").decode("latin-1"), bytes(memoryview(a.data)[body:end])
        at = after


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges  # path below the root, bytes, first and last byte of the range


def _dealt(files: list[tuple[str, int]], range_bytes: int) -> list[Ranges]:
    """Large files cut into ranges, small ones together."""
    out, own, held = [], [], 0
    for rel, size in files:
        for low in range(0, max(size, 1), range_bytes):
            high = min(low + range_bytes, size)
            if own and held + high - low + OPEN_BYTES > range_bytes:
                out.append(Ranges(own))
                own, held = [], 0
            own.append((rel, size, low, high))
            held += high - low + OPEN_BYTES
    return [*out, Ranges(own)] if own else out


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names = [c.split() for c in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.payload = options.get("payload", "true") == "true"

    def path(self, rel: str) -> str:
        return f"{self.root}/{rel}" if rel else self.root

    def rel(self, rel: str) -> str:
        return rel or self.root.rsplit("/", 1)[-1]


class MboxReader(_Reader):
    def partitions(self) -> list[Ranges]:
        return _dealt(listed(self.root), self.range_bytes)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for rel, size, low, high in partition.ranges:
            path, shown = self.path(rel), self.rel(rel)
            try:
                if not size:
                    continue
                system, place = opened(path)
                with system.open_input_file(place) as file:
                    for mid, offset, length, line, raw in messages_of(file, size, low, high):
                        rows.append((path, shown, low, mid, offset, length, line, raw if self.payload else raw[:HEADER_BYTES], None))
                        held += len(rows[-1][7])
                        if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                            yield _batch(rows, MESSAGES)
                            rows, held = [], 0
            except (OSError, EOFError) as broken:
                rows.append((path, shown, low, None, None, None, None, None, f"file cannot be read: {str(broken).splitlines()[0]}"))
        if rows:
            yield _batch(rows, MESSAGES)


class FilesReader(_Reader):
    def partitions(self) -> list[Ranges]:
        files = [(rel, size, 0, size) for rel, size in listed(self.root)]
        return [Ranges(files[k:k + HEADS]) for k in range(0, len(files), HEADS)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows = []
        for rel, size, _, _ in partition.ranges:
            path, shown, error, head = self.path(rel), self.rel(rel), None, b""
            try:
                if size:
                    system, place = opened(path)
                    with system.open_input_file(place) as file:
                        head = _read(file, 0, min(size, HEAD))
            except (OSError, EOFError) as broken:
                error = f"file cannot be read: {str(broken).splitlines()[0]}"
            name = shown.rsplit("/", 1)[-1]
            extension = name.rpartition(".")[2].lower() if "." in name else ""
            kind = "unreadable" if error else "pst" if head[:4] == b"!BDN" else "mbox" if head[:5] == b"From " else "empty" if not size and extension in ("", "mbox", "mbx") else "other"
            rows.append((path, shown, size, kind, line_end(head).decode(), error))
        if rows:
            yield _batch(rows, FILES)


class Mbox(DataSource):
    """``format("mbox")``: options ``path``, ``payload`` (false: only the first 256 KB of each message) and ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema) -> MboxReader:
        return MboxReader(self.options)


class MailFiles(DataSource):
    """``format("mail_files")``: kind (mbox, empty, pst, other, unreadable) and line ends of each file."""

    @classmethod
    def name(cls) -> str:
        return "mail_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


def load(spark: SparkSession, source: type[DataSource], root: str, **options: str) -> DataFrame:
    """Read a path with one of the sources above; paths without a scheme are those of the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(whole)


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, rel_path, size) of all files below a folder, as :func:`listed` shows them, level by level.

    Tasks list the directories, one each at a time; the driver sees no names.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    ddl = "rel_path string, size long"  # a directory has no size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(whole)
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{base}/{rel}".rstrip("/")))
                rows = [(f.path.removeprefix(base + "/"), f.size if f.is_file else None) for f in found if not f.base_name.startswith(".") and f.base_name not in ("_SUCCESS", "_temporary")]
                for k in range(0, len(rows), BATCH_ROWS):
                    yield _batch(rows[k:k + BATCH_ROWS], ddl)

    directories, levels = spark.createDataFrame([("",)], "rel_path string"), []
    while not levels or not directories.isEmpty():
        levels.append(materialize(directories.mapInArrow(run, ddl)))
        directories = levels[-1].where("size is null").select("rel_path").repartition(spark.sparkContext.defaultParallelism * 4, "rel_path")
    files = reduce(DataFrame.union, levels).where("size is not null")
    return files.select(F.concat(F.lit(whole + "/"), "rel_path").alias("file_path"), "rel_path", "size")


def whole_files(files: DataFrame, out: str = "raw") -> DataFrame:
    """Add the bytes of files (file_path, size), read by tasks of about RANGE_BYTES, opening counted."""
    total = files.agg(F.coalesce(F.sum(F.col("size") + OPEN_BYTES), F.lit(0))).first()[0]
    dealt = files.repartition(max(1, -(-total // RANGE_BYTES)), "file_path").withColumn("offset", F.lit(0).cast("long"))
    return with_bytes(dealt, out=out).drop("offset")


class Extents:
    """Reads extents of files in a task and keeps up to 64 files open."""

    def __init__(self):
        self.files: dict[str, pa.NativeFile] = {}

    def read(self, path: str | None, at: int | None, length: int | None) -> bytes | None:
        """The bytes; None if there is no extent."""
        if path is None or at is None or length is None:
            return None
        if path not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            system, place = opened(path)
            self.files[path] = system.open_input_file(place)
        return _read(self.files[path], at, length)


def with_bytes(rows: DataFrame, file: str = "file_path", offset: str = "offset", size: str = "size", out: str = "raw") -> DataFrame:
    """Add the bytes of each row's extent (file, offset, size), read by the task that has the row; a null extent has none.

    Only these bytes are read.  A file that has become shorter fails the task.
    """
    names = [c for c in rows.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extents = Extents()
        for batch in batches:
            found, held, first = [], 0, 0
            for k, place in enumerate(zip(*(batch.column(c).to_pylist() for c in (file, offset, size)), strict=True)):
                found.append(extents.read(*place))
                held += len(found[-1] or b"")
                if held >= BATCH_BYTES:
                    part = batch.slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*names, out])
                    found, held, first = [], 0, k + 1
            part = batch.slice(first)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*names, out])

    own = rows.select(*names)
    return own.mapInArrow(run, T.StructType([*own.schema, T.StructField(out, T.BinaryType())]))
