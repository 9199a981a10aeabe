"""Lines of gzipped files of several members, in many tasks per file.

A gzipped file is one task for Spark's own readers, however large it is. Files that are made
of many members, as crawlers and ``cat`` write them, can be cut: a task takes a range of bytes
and reads the members that begin in it, the last one past the end of the range. Where a member
begins is found by its first bytes, and proven by decompressing it up to its checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "gzip_lines"
RANGE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20

_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20


class Range(InputPartition):
    """The members of a file that begin from ``start`` to before ``stop``."""

    def __init__(self, path: str, start: int, stop: int, size: int) -> None:
        self.path, self.start, self.stop, self.size = path, start, stop, size


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file or of the gzipped files below a folder."""
    system, place = _open(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(place, recursive=True))
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((prefix + f.path, f.size) for f in found
                  if f.is_file and f.base_name.endswith(".gz"))


class Members:
    """Members of a file from a place on, decompressed piece by piece."""

    def __init__(self, file, start: int) -> None:
        self.file, self.at, self.rest = file, start, b""
        file.seek(start)

    def _more(self) -> bool:
        read = self.file.read(_READ)
        self.rest += read
        return bool(read)

    def seek_member(self, stop: int) -> bool:
        """Go on to the next place before ``stop`` that looks like the start of a member."""
        while True:
            found = self.rest.find(_MAGIC)
            if found >= 0:
                self.at, self.rest = self.at + found, self.rest[found:]
                return self.at < stop
            keep = min(len(self.rest), len(_MAGIC) - 1)
            self.at += len(self.rest) - keep
            self.rest = self.rest[len(self.rest) - keep:]
            if self.at >= stop or not self._more():
                return False

    def skip(self) -> None:
        """Leave a place that was no member."""
        self.at, self.rest = self.at + 1, self.rest[1:]

    def pieces(self) -> Iterator[bytes]:
        """The text of the member that begins here; fails if there is none."""
        unzip = zlib.decompressobj(wbits=31)
        while not unzip.eof:
            if not self.rest and not self._more():
                raise zlib.error("the file ends within a member")
            piece = unzip.decompress(self.rest)
            self.at += len(self.rest) - len(unzip.unused_data)
            self.rest = unzip.unused_data
            if piece:
                yield piece


def is_member(file, start: int) -> bool:
    """Whether a whole member, up to its checksum, begins at a place that looks like one."""
    try:
        for _ in Members(file, start).pieces():
            pass
    except zlib.error:
        return False
    return True


def range_lines(file, part: Range) -> Iterator[list[bytes]]:
    """Lines of the members of a range, in lists of bounded size."""
    members = Members(file, part.start)
    sure, lines, held, tail = part.start == 0, [], 0, b""
    while members.seek_member(part.stop):
        start = members.at
        if not sure:
            # The range may begin inside a member, with bytes that look like a new one.
            sure = is_member(file, start)
            members = Members(file, start)
            if not sure:
                members._more()
                members.skip()
                continue
        for piece in members.pieces():
            *whole, tail = (tail + piece).split(b"\n")
            lines += whole
            held += len(piece)
            if held >= BATCH_BYTES:
                yield lines
                lines, held = [], 0
        if tail and members.at < part.size:
            raise ValueError(f"{part.path}: a member ends within a line at byte {members.at}; "
                             "such a file cannot be cut")
    if tail:
        lines.append(tail)
    if lines:
        yield lines


class GzipLinesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.step = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [
            Range(path, start, min(start + self.step, size), size)
            for path, size in list_files(self.path) for start in range(0, size, self.step)
        ]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, place = _open(partition.path)
        with system.open_input_file(place) as file:
            for lines in range_lines(file, partition):
                # As text readers do, a carriage return before the end of a line is no text.
                lines = [x[:-1] if x.endswith(b"\r") else x for x in lines]
                values = pa.array([x.decode(errors="replace") for x in lines], pa.string())
                yield pa.RecordBatch.from_arrays([values], names=["value"])


class GzipLines(DataSource):
    """``spark.read.format("gzip_lines")``: one column ``value``, a row per line."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> GzipLinesReader:
        return GzipLinesReader(dict(self.options))


def read_gzip_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines (``value``) of gzipped files, about one task per ``range_bytes`` of a file.

    Every member holds whole lines; a member that ends within a line fails the job. A file of
    one member stays one task. Paths are those of the file systems that Arrow reads.
    """
    spark.dataSource.register(GzipLines)
    return spark.read.format(FORMAT).option("rangeBytes", range_bytes).load(path)


def write_gzip_members(lines: DataFrame, path: str, rows_per_member: int = 1000) -> list[str]:
    """Write the column ``value`` as gzipped files that can be cut, one per task.

    A task that runs again writes its file again; the names follow from the partitions.
    """

    def run(batches):
        import gzip

        from pyspark import TaskContext

        system, place = _open(path)
        system.create_dir(place)
        name = f"part-{TaskContext.get().partitionId():05d}.gz"
        with system.open_output_stream(f"{place}/{name}", compression=None) as out:
            for batch in batches:
                for low in range(0, batch.num_rows, rows_per_member):
                    part = batch.column("value").slice(low, rows_per_member).to_pylist()
                    out.write(gzip.compress("".join(f"{x}\n" for x in part).encode(), mtime=0))
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    # One name per task.
    written = lines.select("value").mapInArrow(run, "file string")
    return [f"{path}/{row.file}" for row in written.collect()]
