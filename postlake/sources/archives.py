"""Lines of text in zip archives, streamed where they lie.

Spark lists the archives and deals them to tasks by their size; a task opens each one, seeks to
its first entry and unpacks that in pieces, so no archive is ever held whole.
"""

from __future__ import annotations

import errno
import io
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_LINES_PER_BATCH = 20_000
_PIECE = 1 << 20
LINES = "feed_file string, line string, error string"
#: What a damaged, encrypted or unknown archive raises.
_UNREADABLE = (
    zipfile.BadZipFile,
    zlib.error,
    lzma.LZMAError,
    struct.error,
    EOFError,
    RuntimeError,
    NotImplementedError,
    UnicodeDecodeError,
)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
    if local:
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", path), safe=":/@"))


class _File(io.RawIOBase):
    """An Arrow file; a place before its start is an ``OSError``, as with other files."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        return self.file.read(None if size is None or size < 0 else size)

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        try:
            return self.file.seek(offset, whence)
        except pa.ArrowInvalid as e:
            raise OSError(errno.EINVAL, str(e)) from e

    def close(self) -> None:
        self.file.close()
        super().close()


def open_path(path: str) -> io.IOBase:
    """A seekable file, through Arrow's file systems."""
    system, place = _place(path)
    return _File(system.open_input_file(place))


def _records(text: io.TextIOWrapper, multi_line: bool) -> Iterator[str]:
    """Lines without their ends; with ``multi_line`` those of an open quote are one."""
    held: list[str] = []
    quotes = 0
    for line in text:
        if multi_line:
            held.append(line)
            quotes += line.count('"')
            if quotes % 2:
                continue
            line, held, quotes = "".join(held), [], 0
        yield line.rstrip("\r\n")
    if held:
        yield "".join(held).rstrip("\r\n")


def _archive(path: str, file: io.IOBase, encoding: str, header: bool, multi_line: bool) -> Iterator[pd.DataFrame]:
    def frame(rows: list[str | None], error: str | None = None) -> pd.DataFrame:
        return pd.DataFrame({"feed_file": path, "line": rows, "error": error}, dtype=object)

    try:
        archive = zipfile.ZipFile(file)
        entries = archive.infolist()
        if entries:
            with archive.open(entries[0]) as whole:  # to its end, where the checksum is compared
                while whole.read(_PIECE):
                    pass
    except _UNREADABLE as e:
        yield frame([None], f"unreadable archive: {e}")
        return
    except OSError as e:
        # bad bzip2 data has no error number, and in a cut archive places may lie before its
        # start; a failed read is tried again
        if e.errno not in (None, errno.EINVAL):
            raise
        yield frame([None], f"unreadable archive: {e}")
        return
    if not entries:
        yield frame([None], "archive has no entry")
        return
    with archive.open(entries[0]) as raw:
        text = io.TextIOWrapper(raw, encoding=encoding, errors="replace", newline="")
        rows: list[str | None] = []
        for number, line in enumerate(_records(text, multi_line)):
            if line and not (header and number == 0):
                rows.append(line)
            if len(rows) == _LINES_PER_BATCH:
                yield frame(rows)
                rows = []
        if rows:
            yield frame(rows)


def archive_lines(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "utf-8",
    header: bool = False,
    multi_line: bool = False,
    opener: Callable[[str], io.IOBase] = open_path,
) -> DataFrame:
    """``feed_file`` and ``line`` of the first entry of each archive, blank lines left out.

    An archive without an entry, or one that is damaged, encrypted or packed by an unknown
    method, gives one row with its ``error`` and no lines.  Archives may be of any size, but
    each is read by one task, twice: its checksum is compared before a line is passed on.
    With ``multi_line`` a line may hold line breaks inside quotes.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                with opener(name) as file:
                    yield from _archive(name, file, encoding, header, multi_line)

    # of the files only their paths are read
    listed = spark.read.format("binaryFile").load(path).select("path")
    return listed.mapInPandas(unpack, LINES)


_METHODS = {
    "stored": zipfile.ZIP_STORED,
    "deflate": zipfile.ZIP_DEFLATED,
    "bzip2": zipfile.ZIP_BZIP2,
    "lzma": zipfile.ZIP_LZMA,
}


def write_archives(lines: DataFrame, folder: str, method: str = "deflate", encoding: str = "utf-8") -> int:
    """Write the column ``line`` of each partition that has rows as one archive, in order, named
    by the partition's number; returns how many.  An archive appears under its name when it is
    complete, so a task may be tried again.  Null lines are left out."""
    packing = _METHODS[method]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}"
        system, place = _place(folder)
        system.create_dir(place)
        aside, written = f"{place}/_{name}-{task.taskAttemptId()}", 0
        with system.open_output_stream(aside) as out, zipfile.ZipFile(out, "w", packing) as archive:
            # times would make equal archives differ
            entry = zipfile.ZipInfo(f"{name}.csv")
            entry.compress_type = packing
            with archive.open(entry, "w", force_zip64=True) as text:
                for batch in batches:
                    some = [line for line in batch.column(0).to_pylist() if line is not None]
                    text.write("".join(line + "\n" for line in some).encode(encoding))
                    written += len(some)
        if written:
            system.move(aside, f"{place}/{name}.zip")
        else:
            system.delete_file(aside)
        yield pa.RecordBatch.from_pydict({"archives": [int(written > 0)]}, pa.schema([("archives", pa.int64())]))

    done = lines.select("line").mapInArrow(pack, "archives long")
    return done.groupBy().sum("archives").first()[0] or 0
