"""Text files read in byte ranges by many tasks: by line, or in pieces of bounded size, with their place in the file.

A range belongs to the task that it was dealt to, but lines and pieces begin and end where the bytes say so: a task skips
to the first end behind the start of its range, and reads on to the first one behind its end.  So each line and
piece is read once, whatever the ranges.  Files are read by the tasks themselves, through the file systems that
Arrow knows (local and shared folders, HDFS, object stores).
"""

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tracesift.operators.pieces import MARGIN, cut_after, last_character
from tracesift.sources.scratch import file_system

#: Bytes of a range, of what is read at a time, and of text in a batch that goes to Spark.
SPLIT_BYTES, READ_BYTES, BATCH_BYTES = 64 << 20, 1 << 20, 4 << 20

#: What opening a file costs, in bytes read meanwhile.
OPEN_BYTES = 64 << 10

LINES = "file string, offset bigint, text string"
PIECES = "file string, offset bigint, before string, text string, after string"


class Range(NamedTuple):
    """Bytes ``start`` to ``end`` of a file of ``size`` bytes."""

    file: str
    start: int
    end: int
    size: int


@dataclass
class Ranges(InputPartition):
    """What a task reads: a range of a large file, or several small files."""

    parts: list[Range]


class TextRanges(DataSource):
    """``path`` (a file or folder), ``split_bytes`` and ``tasks`` (bytes a task reads at most, and tasks that there should be),
    and ``piece_bytes`` for pieces rather than lines."""

    @classmethod
    def name(cls) -> str:
        return "text_ranges"

    def schema(self) -> str:
        return PIECES if "piece_bytes" in self.options else LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(dict(self.options))


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tasks = int(options.get("tasks", 1))
        self.piece = int(options["piece_bytes"]) if "piece_bytes" in options else None

    def partitions(self) -> list[Ranges]:
        """Ranges of the files' sizes, small ones together; hidden files are left out."""
        from pyarrow import fs

        system, place = file_system(self.path)
        root = system.get_file_info(place)
        if root.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [root] if root.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not _hidden(f.path[len(place) :]))
        total = sum(n + OPEN_BYTES for _, n in files)
        most = min(self.split, max(OPEN_BYTES, -(-total // self.tasks)))
        dealt, held = [], most
        for path, size in files:
            for start in range(0, size, most):
                part = Range(path, start, min(start + most, size), size)
                if held + part.end - part.start + OPEN_BYTES > most:
                    dealt.append(Ranges([]))
                    held = 0
                dealt[-1].parts.append(part)
                held += part.end - part.start + OPEN_BYTES
        return dealt or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        for part in partition.parts:
            with system.open_input_file(part.file) as file:
                yield from self._pieces(file, part) if self.piece else self._lines(file, part)

    def _lines(self, file, part: Range) -> Iterator[pa.RecordBatch]:
        at = 0 if part.start == 0 else _next(file, part.start - 1, part.size, _line_end)
        line_at, pieces = at, []  # of the line that goes on
        rows, held = [], 0
        while at < part.size and line_at < part.end:
            data = file.read_at(READ_BYTES, at)
            at += len(data)
            *ended, rest = data.split(b"\n")
            for piece in ended:
                whole = b"".join([*pieces, piece])
                pieces = []
                if line_at < part.end:
                    rows.append((line_at, _decoded(whole, part.file, line_at)))
                line_at += len(whole) + 1
                held += len(whole)
            pieces.append(rest)
            if held > BATCH_BYTES:
                yield _rows_batch(part.file, rows, ["offset", "text"])
                rows, held = [], 0
        last = b"".join(pieces)
        if last and line_at < part.end:  # a line without an end
            rows.append((line_at, _decoded(last, part.file, line_at)))
        if rows:
            yield _rows_batch(part.file, rows, ["offset", "text"])

    def _pieces(self, file, part: Range) -> Iterator[pa.RecordBatch]:
        at = 0 if part.start == 0 else _next(file, part.start, part.size, cut_after)
        rows, held = [], 0
        while at < part.end:
            # what is left of a buffer is cut at once
            data = file.read_at(max(READ_BYTES, 2 * self.piece + MARGIN), at)
            begin = 0
            while at + begin < part.end:
                wanted = min(begin + self.piece, part.end - at)
                last = at + len(data) == part.size
                end = cut_after(data, wanted) if wanted < len(data) else 0
                if end and end + MARGIN > len(data) and not last or not end and not last:
                    if begin:
                        break  # goes on in the next buffer
                    # an unbroken run that is longer than the buffer
                    end = _next(file, at + wanted, part.size, cut_after) - at
                    data = file.read_at(end + MARGIN, at)
                end = end or len(data)
                before = data[begin - 4 if begin > 4 else 0 : begin] if begin else file.read_at(min(4, at), max(0, at - 4))
                own = _decoded(data[begin:end], part.file, at + begin)
                rows.append((at + begin, last_character(before), own, data[end : end + MARGIN].decode(errors="ignore")))
                held += end - begin
                begin = end
                if held > BATCH_BYTES:
                    yield _rows_batch(part.file, rows, ["offset", "before", "text", "after"])
                    rows, held = [], 0
            at += begin
        if rows:
            yield _rows_batch(part.file, rows, ["offset", "before", "text", "after"])


def _rows_batch(file: str, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    offsets, *texts = zip(*rows, strict=True) if rows else [()] * len(names)
    columns = [pa.array([file] * len(rows), pa.string()), pa.array(offsets, pa.int64()), *(pa.array(t, pa.string()) for t in texts)]
    return pa.RecordBatch.from_arrays(columns, ["file", *names])


def _hidden(path: str) -> bool:
    return any(name[:1] in "_." for name in path.split("/") if name)


def _line_end(data: bytes, start: int) -> int:
    return data.find(b"\n", start) + 1


def _next(file, start: int, size: int, find) -> int:
    """The first place from ``start`` on behind which ``find`` allows an end; else the end of the file."""
    at, step = max(0, start - 1), 4096  # an end is near as a rule
    skip = start - at
    while True:
        data = file.read_at(step, at)
        if end := find(data, skip):
            return at + end
        if at + len(data) >= size:
            return size
        # the last byte is looked at again, with what follows it
        at, skip, step = at + len(data) - 1, 1, min(2 * step, READ_BYTES)


def _decoded(data: bytes, file: str, offset: int) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as error:
        raise ValueError(f"INVALID_UTF8: {file}, byte {offset + error.start}") from None


def read_ranges(spark: SparkSession, path: str, **options: int) -> DataFrame:
    spark.dataSource.register(TextRanges)
    options = {"tasks": spark.sparkContext.defaultParallelism, **options}
    return spark.read.format("text_ranges").options(**{k: str(v) for k, v in options.items()}).load(path)
