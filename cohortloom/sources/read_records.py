"""Four-line read records of files of any size: a Spark data source with one partition per byte range.

A range owns the records whose header begins in it and reads past its end to finish the last one. Records need no line
numbers to be found: a header is a line with ``@`` whose next but one line begins with ``+``, which no other line of
a record can be. A file is numbered from the record counts of its ranges. Compressed files are one range each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "read_records"
RANGE, PIECE, BROADCAST_RANGES = 128 << 20, 4 << 20, 200_000
_PACKED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
_HEADER = re.compile(rb"^@[^\n]*\n[^\n]*\n\+", re.MULTILINE)


class RangePartition(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        super().__init__((path, start))
        self.path, self.start, self.end = path, start, end


def _open_folder(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def _listed(root: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that ``root`` names: a file, a folder, or a pattern of either; hidden files are left out."""
    from pyarrow import fs

    fixed = re.split(r"[*?\[]", root, maxsplit=1)[0]
    plain = fixed == root
    system, base = _open_folder(root if plain else fixed[: fixed.rindex("/")])
    found = system.get_file_info(base)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if found.is_file:
        return [(found.path, found.size)]
    pattern = base if plain else base + root[fixed.rindex("/") :]
    files = [f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
    return sorted((f.path, f.size) for f in files if any(PurePosixPath(f.path).full_match(x) for x in (pattern, f"{pattern}/**")))


class Ragged(ValueError):
    """A file whose lines do not form whole records."""


def _checked(lines: list[bytes], path: str) -> list[bytes]:
    """Whole records in which the marks of the first and third line stand."""
    if not all(x.startswith(b"@") for x in lines[::4]) or not all(x.startswith(b"+") for x in lines[2::4]):
        raise Ragged(f"incomplete record in {path}: a header or separator line is out of place")
    return lines


def _whole(lines: list[bytes], path: str) -> list[bytes]:
    if len(lines) % 4:
        raise Ragged(f"incomplete record in {path}")
    return lines


def _range_lines(stream, part: RangePartition) -> Iterator[list[bytes]]:
    """Lines of the records of a plain range, whole records at a time."""
    # A later range starts at the first header that begins a line in it, so it looks at the byte before it too.
    opened = part.start == 0
    at = part.start if opened else part.start - 1
    held = b""
    stream.seek(at)
    while True:
        piece = stream.read(PIECE)
        held += piece
        if not opened:
            skipped = held.find(b"\n") + 1
            found = _HEADER.search(held, skipped) if skipped else None
            if found:
                at, held, opened = at + found.start(), held[found.start() :], True
            elif piece:
                continue
        if not opened or at >= part.end:
            return
        if not piece:
            yield _whole(held.removesuffix(b"\n").split(b"\n") if held else [], part.path)
            return
        lines = held.split(b"\n")
        kept = len(lines[:-1]) // 4 * 4
        size = sum(map(len, lines[:kept])) + kept
        if at + size > part.end:
            kept = size = 0
            while at + size < part.end and kept + 4 < len(lines):
                size += sum(map(len, lines[kept : kept + 4])) + 4
                kept += 4
        yield lines[:kept]
        at += size
        held = held[size:]
        if at >= part.end:
            return


def _packed_lines(stream, part: RangePartition) -> Iterator[list[bytes]]:
    held: list[bytes] = [b""]
    while piece := stream.read(PIECE):
        lines = (held.pop() + piece).split(b"\n")
        held += lines[:-1]
        take = len(held) // 4 * 4
        yield held[:take]
        held = [*held[take:], lines[-1]]
    yield _whole(held if held[-1] else held[:-1], part.path)


def ranges(root: str, size: int) -> list[list[RangePartition]]:
    """The ranges of every file."""
    out = []
    for path, length in _listed(root):
        packed = PurePosixPath(path).suffix in _PACKED
        out.append([RangePartition(path, 0, None)] if packed else [RangePartition(path, at, min(at + size, length)) for at in range(0, length, size)])
    return out


class RecordReader(DataSourceReader):
    """``what`` is ``records`` or ``counts`` (one row per range of the files that have several)."""

    def __init__(self, root: str, size: int, what: str):
        self.root, self.size, self.what = root, size, what

    def partitions(self) -> list[RangePartition]:
        return [part for parts in ranges(self.root, self.size) if self.what == "records" or len(parts) > 1 for part in parts]

    def _batches(self, part: RangePartition) -> Iterator[list[bytes]]:
        fixed = re.split(r"[*?\[]", self.root, maxsplit=1)[0]
        system, _ = _open_folder(fixed if fixed == self.root else fixed[: fixed.rindex("/")])
        if part.end is None:
            with system.open_input_stream(part.path, compression=_PACKED[PurePosixPath(part.path).suffix]) as stream:
                yield from _packed_lines(stream, part)
        else:
            with system.open_input_file(part.path) as stream:
                yield from _range_lines(stream, part)

    def read(self, partition: RangePartition) -> Iterator:
        import pyarrow as pa

        count = 0
        for lines in self._batches(partition):
            n = len(_checked(lines, partition.path)) // 4
            if self.what == "records" and n:
                texts = [pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines[i::4]], type=pa.string()) for i in (0, 1, 3)]
                columns = [pa.array([partition.path] * n), pa.array([partition.start] * n, type=pa.int64()), pa.array(range(count, count + n), type=pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *texts], ["file_path", "range_start", "ordinal", "header", "seq", "qual"])
            count += n
        if self.what == "counts":
            yield partition.path, partition.start, count


class ReadRecords(DataSource):
    """``spark.read.format("read_records").load(path)``; options ``range_bytes`` and ``what``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _what(self) -> str:
        return self.options.get("what", "records")

    def schema(self) -> str:
        place = "file_path string, range_start bigint"
        return f"{place}, records bigint" if self._what() == "counts" else f"{place}, ordinal bigint, header string, seq string, qual string"

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options["path"], int(self.options.get("range_bytes", RANGE)), self._what())


def numbered_records(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(file_path, position, header, seq, qual) with dense 0-based positions inside each file.

    Files of one range, compressed ones among them, are numbered by the reader. Otherwise a pass that builds no rows
    counts the records of each range, and the counts before a range are joined to its records: broadcast (records are
    not shuffled) where the files have at most ``BROADCAST_RANGES`` ranges, else a plain equi-join.
    """
    spark.dataSource.register(ReadRecords)

    def load(what: str) -> DataFrame:
        return spark.read.format(FORMAT).option("range_bytes", str(range_bytes)).option("what", what).load(path)

    rows = load("records")
    cut = sum(len(parts) for parts in ranges(path, range_bytes) if len(parts) > 1)
    if not cut:
        return rows.select("file_path", F.col("ordinal").alias("position"), "header", "seq", "qual")
    earlier = Window.partitionBy("file_path").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    before = load("counts").select("file_path", "range_start", F.sum("records").over(earlier).alias("_before"))
    joined = rows.join(F.broadcast(before) if cut <= BROADCAST_RANGES else before, ["file_path", "range_start"], "left")
    place = F.col("ordinal") + F.coalesce("_before", F.lit(0).cast("bigint"))
    return joined.select("file_path", place.alias("position"), "header", "seq", "qual")
