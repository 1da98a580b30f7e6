"""Sizes and digests of files of any size: a Spark data source with one partition per file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "file_digests"
PIECE = 8 << 20


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class DigestReader(DataSourceReader):
    """Lists the files when the read is planned; a task hashes its file piece by piece, so memory does not follow its size."""

    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix

    def partitions(self) -> list[FilePartition]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        listed = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in listed if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith((".", "_")))
        return [FilePartition(n) for n in names]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else fs.LocalFileSystem()
        md5, sha, size = hashlib.md5(), hashlib.sha256(), 0
        with system.open_input_stream(partition.path, compression=None) as stream:
            while piece := stream.read(PIECE):
                size += len(piece)
                md5.update(piece)
                sha.update(piece)
        yield partition.path.rsplit("/", 1)[-1], partition.path, size, md5.hexdigest(), sha.hexdigest()


class FileDigests(DataSource):
    """``spark.read.format("file_digests").option("suffix", ".gz").load(folder)``: hidden files are left out."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file_name string, path string, size_bytes bigint, md5 string, sha256 string"

    def reader(self, schema: StructType) -> DigestReader:
        return DigestReader(self.options["path"], self.options.get("suffix", ""))


def register(spark: SparkSession) -> None:
    """Make the format known to the session; registering again changes nothing."""
    spark.dataSource.register(FileDigests)
