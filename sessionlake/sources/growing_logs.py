"""A streaming source over log files that grow: Spark's own file source takes every file once and never sees what is appended later."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FIELDS = "file_path string, place long, line string"
SPAN = 128 << 20
BLOCK = 4 << 20
#: Spans of a batch up to which each is a partition of its own; of more, small ones share partitions.
MOST_SPANS = 256


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _line_start(source: pa.NativeFile, at: int) -> int:
    """The first byte of the line that byte ``at`` belongs to."""
    while at > 0:
        before = max(0, at - BLOCK)
        source.seek(before)
        found = source.read(at - before).rfind(b"\n")
        if found >= 0:
            return before + found + 1
        at = before
    return 0


def _has_newline(source: pa.NativeFile, start: int, end: int) -> bool:
    source.seek(start)
    while start < end:
        block = source.read(min(BLOCK, end - start))
        if not block:
            return False
        if b"\n" in block:
            return True
        start += len(block)
    return False


def lines_ending_in(source: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the lines whose newline is one of the bytes from ``start`` to ``end``, however far before ``start`` they begin.

    So every line belongs to one range, that of its newline; a half line at the end waits for the range that completes it.
    """
    if not _has_newline(source, start, end):
        return
    place = at = _line_start(source, start)
    source.seek(at)
    pending: list[bytes] = []
    while at < end:
        block = source.read(min(BLOCK, end - at))
        if not block:
            return
        at += len(block)
        head, *others = block.split(b"\n")
        pending.append(head)
        for following in others:
            line = b"".join(pending)
            yield place, line
            place += len(line) + 1
            pending = [following]


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Spans(InputPartition):
    """Spans that one task reads: many small files are not as many tasks."""

    def __init__(self, spans: list[Span]):
        self.spans = spans


def packed(spans: list[Span]) -> list[Span | Spans]:
    """Spans in their order in about ``MOST_SPANS`` partitions by bytes, none with more than ``SPAN`` unless one span has; few spans stay as they are."""
    if len(spans) <= MOST_SPANS:
        return spans
    most = min(SPAN, max(1, sum(s.end - s.start for s in spans) // MOST_SPANS))
    packs, held = [[]], 0
    for span in spans:
        if packs[-1] and held + span.end - span.start > most:
            packs.append([])
            held = 0
        packs[-1].append(span)
        held += span.end - span.start
    return [Spans(p) for p in packs]


class GrowingLogsReader(DataSourceStreamReader):
    """Offsets are the sizes of all files by path; a batch reads what lies between two of them, in spans of ``SPAN`` bytes."""

    def __init__(self, path: str, suffix: str, schema: StructType):
        self.path, self.suffix, self.schema = path, suffix, schema

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = open_store(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        return {i.path: i.size for i in found if i.type == fs.FileType.File and i.path.endswith(self.suffix) and not i.base_name.startswith((".", "_"))}

    def partitions(self, start: dict, end: dict) -> list[Span | Spans]:
        spans = []
        for path, size in end.items():
            known = start.get(path, 0)
            known = known if known <= size else 0  # a file that has shrunk is another one under the same name
            spans += [Span(path, at, min(at + SPAN, size)) for at in range(known, size, SPAN)]
        return packed(spans)

    def read(self, partition: Span | Spans) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema]
        paths, places, lines, held = [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], names)

        store, _ = open_store(self.path)
        for span in partition.spans if isinstance(partition, Spans) else [partition]:
            with store.open_input_file(span.path) as source:
                for place, line in lines_ending_in(source, span.start, span.end):
                    paths.append(span.path)
                    places.append(place)
                    lines.append(line.decode("utf-8", "replace"))
                    held += len(line) + 1
                    if held > BLOCK:
                        yield batch()
                        paths, places, lines, held = [], [], [], 0
        if lines:
            yield batch()


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return FIELDS

    def streamReader(self, schema: StructType) -> GrowingLogsReader:
        return GrowingLogsReader(self.options["path"], self.options.get("suffix", ""), schema)


def stream_raw_lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """A stream of file_path, place (of the line's first byte), line and valid: every line below ``path`` that isn't blank, once its newline is there.

    What is appended to a file comes with the next batch. A file that has become shorter is read anew; one that vanishes before its batch is read fails that batch.
    An offset names all files with their sizes, a few dozen bytes each.
    """
    spark.dataSource.register(GrowingLogs)
    lines = spark.readStream.format("growing_logs").option("suffix", suffix).load(path)
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "\r$", ""))).where("line <> ''")
    return lines.withColumn("valid", F.try_parse_json("line").isNotNull())
