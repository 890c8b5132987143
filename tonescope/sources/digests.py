"""Content hashes of files of any size: a data source with one partition per file, read block by block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 8 << 20


class File(InputPartition):
    def __init__(self, path: str, length: int) -> None:
        self.path, self.length = path, length


def opened(path: str):
    """The file system of a path or URI (local, HDFS, S3, GCS, ...) and the path on it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(
        path if path.startswith("file:") else "file://" + path)


class FileReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[File]:
        """Names and lengths only; nothing is read here."""
        from pyarrow import fs
        system, path = opened(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        return [File(f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File]

    def read(self, partition: File) -> Iterator[tuple[str, int, str]]:
        digest, system = hashlib.sha256(), opened(self.path)[0]
        with system.open_input_stream(partition.path, compression=None) as stream:
            while block := stream.read(BLOCK):
                digest.update(block)
        yield partition.path.rsplit("/", 1)[-1], partition.length, digest.hexdigest()


class FileDigests(DataSource):
    """`spark.read.format("file_digests").load(path)`: file, length and sha256 of all files at or below a path."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "file string, length long, sha256 string"

    def reader(self, schema) -> FileReader:
        return FileReader(self.options["path"])
