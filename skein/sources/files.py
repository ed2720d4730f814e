"""Files as rows. Two readers of ``path, content``:

* ``hadoop_files``: Spark's own file source, for every store that Hadoop knows. It leaves out
  empty files and names that start with ``_`` or ``.``.
* ``all_files``: a Python data source for mounted (``file:``) folders that lists everything.

Paths are given as ``file:///x`` by both.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse
from uuid import uuid4

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, content binary"


def local_path(url: str) -> str | None:
    """The mounted path of a ``file:`` URL or plain path, else None."""
    if url.startswith("file:"):
        return unquote(urlparse(url).path)
    return url if "://" not in url and not url.startswith(("hdfs:", "s3a:", "viewfs:")) else None


def to_url(path: str) -> str:
    """``/x`` and ``file:/x`` as ``file:///x``; other URLs as they are."""
    local = local_path(path)
    return path if local is None else "file://" + os.path.abspath(local)


def list_files(path: str, recursive: bool = False) -> list[str]:
    """Every file at or below ``path`` by name, hidden and empty ones too; literal names."""
    if os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    found = []
    for entry in sorted(os.scandir(path), key=lambda e: e.name):
        if entry.is_file():
            found.append(entry.path)
        elif recursive and entry.is_dir():
            found += list_files(entry.path, True)
    return found


class _FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.recursive = options["path"], options.get("recursive", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        return [_FilePart(p) for p in list_files(self.path, self.recursive)] or [_FilePart("")]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, bytes]]:
        if partition.path:
            with open(partition.path, "rb") as f:
                yield "file://" + partition.path, f.read()


class FilesSource(DataSource):
    """Reads ``path, content``, one partition per file."""

    @classmethod
    def name(cls) -> str:
        return "skein_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FilesReader(self.options)


class _BlockPart(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


#: bytes of a file that one task reads as lines
LINE_BLOCK = 1 << 26
#: bytes that are split into lines at once, and lines that leave a task at once
LINE_BYTES, LINE_ROWS = 1 << 22, 1 << 16


def _split(data: bytes):
    """Lines as an Arrow array of bytes; the last one may lack its newline."""
    import numpy as np
    import pyarrow as pa

    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    if data and not data.endswith(b"\n"):
        ends = np.append(ends, len(data))
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends - np.arange(len(ends))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data.replace(b"\n", b""))])


class _LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.recursive, self.block = options["path"], options.get("recursive", "false") == "true", int(options.get("block", LINE_BLOCK))

    def partitions(self) -> list[InputPartition]:
        parts = []
        for p in list_files(self.path, self.recursive):
            size = os.path.getsize(p)
            parts += [_BlockPart(p, at, min(size, at + self.block)) for at in range(0, size, self.block)]
        return parts or [_BlockPart("", 0, 0)]

    def read(self, part: InputPartition) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if not part.path:
            return
        with open(part.path, "rb") as f:
            left, row = part.end - part.start, 0
            if part.start:  # a line belongs to the block in which it begins
                f.seek(part.start - 1)
                left -= len(f.readline()) - 1
            while left > 0 and (data := f.read(min(left, LINE_BYTES))):
                data += b"" if data.endswith(b"\n") else f.readline()
                left -= len(data)
                lines = _split(data)
                for k in range(0, len(lines), LINE_ROWS):
                    some = lines.slice(k, LINE_ROWS)
                    path, at, rows = pa.repeat(pa.scalar("file://" + part.path), len(some)), pa.repeat(pa.scalar(part.start), len(some)), pa.array(np.arange(row, row + len(some)))
                    yield pa.record_batch([path, at, rows, some], names=["path", "at", "row", "line"])
                    row += len(some)


class LineBlocksSource(DataSource):
    """Reads ``path, at, row, line``: every line's bytes, its block and its place there, large files by blocks."""

    @classmethod
    def name(cls) -> str:
        return "skein_line_blocks"

    def schema(self) -> str:
        return "path string, at bigint, row bigint, line binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LinesReader(self.options)


class _Part(WriterCommitMessage):
    def __init__(self, partition: int, attempt: str):
        self.partition, self.attempt = partition, attempt


class _LinesWriter(DataSourceArrowWriter):
    """Tasks write into a staging folder of this write alone; the commit publishes just what they reported."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.encoding, self.extension = options["path"].rstrip("/"), options.get("encoding", "utf-8"), options.get("extension", "txt")
        self.in_order = options.get("in_order", "false") == "true"
        pickled = options.get("compressor", "")
        self.compressor = cloudpickle.loads(base64.b64decode(pickled)) if pickled else None
        if not overwrite and os.path.exists(self.path):
            raise FileExistsError(self.path)
        self.staging = f"{self.path}.__staging-{uuid4().hex}"

    @staticmethod
    def _joined(batches: Iterator) -> Iterator[bytes]:
        """The partition's text in UTF-8, batch by batch."""
        import pyarrow as pa
        import pyarrow.compute as pc

        between = b""
        for b in batches:
            if b.num_rows:
                values = pc.fill_null(b.column(0).cast(pa.large_string()), "")
                text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values), pa.scalar("\n", pa.large_string()))
                yield between + text[0].as_buffer().to_pybytes()
                between = b"\n"

    def write(self, batches: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.staging, exist_ok=True)
        attempt = os.path.join(self.staging, f".attempt-{context.partitionId()}-{context.taskAttemptId()}")
        utf8 = codecs.lookup(self.encoding).name == "utf-8"
        with open(attempt, "wb") as f:
            if utf8 and not self.compressor:
                f.writelines(self._joined(batches))
            else:  # both need the whole partition
                data = b"".join(self._joined(batches))
                data = data if utf8 else data.decode().encode(self.encoding)
                f.write(self.compressor(data) if self.compressor else data)
        return _Part(context.partitionId(), attempt)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        import shutil

        ready, old = f"{self.staging}-ready", f"{self.staging}-old"
        os.makedirs(ready)
        parts = [m for m in messages if m is not None]
        digits = len(str(max((m.partition for m in parts), default=0))) if self.in_order else 1
        for m in parts:
            os.replace(m.attempt, os.path.join(ready, f"part-{m.partition:0{digits}}.{self.extension}"))
        if os.path.exists(self.path):
            os.replace(self.path, old)
        os.replace(ready, self.path)
        for leftover in (old, self.staging):
            shutil.rmtree(leftover, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        import shutil

        shutil.rmtree(self.staging, ignore_errors=True)


class LinesSource(DataSource):
    """Writes one ``part-<id>.<ext>`` per partition: rows joined by newline, none at the end."""

    @classmethod
    def name(cls) -> str:
        return "skein_lines"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _LinesWriter(self.options, overwrite)


def all_files(spark: SparkSession, url: str, recursive: bool = False) -> DataFrame:
    spark.dataSource.register(FilesSource)
    return spark.read.format("skein_files").option("recursive", str(recursive).lower()).load(local_path(url))


def ordered_lines(spark: SparkSession, url: str, recursive: bool = False, encoding: str = "utf-8", block: int = LINE_BLOCK) -> DataFrame:
    """``value, place``: lines, and what they are ordered by; a large file is read by many tasks.

    A place is the file's path, where its block begins, and a row number without gaps inside the block.
    Mounted folders: every file, split at newlines only. Other stores: Spark's text reader, which
    splits and decompresses by name; lines follow each other by file, block and row.
    """
    path = local_path(url)
    if path is not None:
        spark.dataSource.register(LineBlocksSource)
        found = spark.read.format("skein_line_blocks").option("recursive", str(recursive).lower()).option("block", str(block)).load(path)
        return found.select(F.decode("line", encoding).alias("value"), F.struct("path", "at", "row").alias("place"))
    read = spark.read.option("lineSep", "\n").option("encoding", encoding).option("recursiveFileLookup", str(recursive).lower()).text(url)
    return read.select("value", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")).alias("place"))


def hadoop_files(spark: SparkSession, url: str, recursive: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(url)
    return files.select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"), "content")


def decode(content: Column, encoding: str = "utf-8") -> Column:
    return F.decode(content, encoding)


def decompress(df: DataFrame, decompressor) -> DataFrame:
    """``decompressor(bytes, path)`` on every file's content (Python, in Arrow batches)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            content = [None if c is None else decompressor(c, p) for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True)]
            yield pa.record_batch([b["path"].cast(pa.string()), pa.array(content, pa.binary())], names=["path", "content"])

    return df.mapInArrow(run, SCHEMA)


def lines_of(texts: DataFrame, strip_cr: bool = False) -> DataFrame:
    """``path, line, value`` of ``path, text``: split at newlines only; one empty last line is dropped."""
    parts = F.split(F.col("text"), "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    out = texts.select("path", F.posexplode(kept).alias("line", "value"))
    return out.withColumn("value", F.regexp_replace("value", "\r$", "")) if strip_cr else out


def text_lines(spark: SparkSession, url: str, recursive: bool = False) -> DataFrame:
    """``value``: the lines of all files by Spark's text reader, splittable and decompressing by name."""
    return spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower()).text(url)


def save_text(df: DataFrame, url: str, overwrite: bool = True, compression: str | None = None, column: str = "value") -> None:
    """Spark's text writer, for any store."""
    writer = df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite" if overwrite else "errorifexists")
    (writer.option("compression", compression) if compression else writer).text(url)


def save_text_parts(df: DataFrame, url: str, overwrite: bool = True, extension: str = "txt", encoding: str = "utf-8", compressor=None, column: str = "value", in_order: bool = False) -> None:
    """Exact part names and bytes, with any ``compressor(bytes)``; a mounted folder is needed.

    ``in_order`` fills part numbers up with zeros, so that the files' order by name is that of the partitions.
    """
    path = local_path(url)
    if path is None:
        raise ValueError("exact part files need a mounted (file:) folder; use save_text")
    df.sparkSession.dataSource.register(LinesSource)
    writer = df.select(F.col(column).cast("string").alias("value")).write.format("skein_lines").mode("overwrite" if overwrite else "append")
    if compressor:
        writer = writer.option("compressor", base64.b64encode(cloudpickle.dumps(compressor)).decode())
    if not overwrite and os.path.exists(path):
        raise FileExistsError(path)
    writer.option("extension", extension).option("encoding", encoding).option("in_order", str(in_order).lower()).save(path)
