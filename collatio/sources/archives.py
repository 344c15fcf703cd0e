"""Entries of zip archives as rows, read entry by entry: the directory at an archive's end says where each lies."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Packed bytes of a partition, about.
PARTITION_BYTES = 16 << 20


def opened(path: str):
    """A file of a local or other store that Arrow knows, for reading at any place."""
    store, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return store.open_input_file(name)


@dataclass
class Entries(InputPartition):
    """Entries of an archive: name, place, packed size, size, method and checksum."""

    archive: str
    entries: list[tuple[str, int, int, int, int, int]]


class ArchiveReader(DataSourceReader):
    def __init__(self, archives: list[str], suffixes: tuple[str, ...], limit: int):
        self.archives, self.suffixes, self.limit = archives, suffixes, limit

    def partitions(self) -> list[Entries]:
        """Plans over the archives' directories alone."""
        out: list[Entries] = []
        for archive in self.archives:
            with opened(archive) as f, zipfile.ZipFile(f) as z:
                own, size = [], 0
                for e in z.infolist():
                    if e.is_dir() or not e.filename.lower().endswith(self.suffixes):
                        continue
                    if e.flag_bits & 1:
                        raise ValueError(f"{archive}: {e.filename} is encrypted")
                    if own and size + e.compress_size > self.limit:
                        out.append(Entries(archive, own))
                        own, size = [], 0
                    own.append((e.filename, e.header_offset, e.compress_size, e.file_size, e.compress_type, e.CRC))
                    size += e.compress_size
                if own:
                    out.append(Entries(archive, own))
        return out

    def read(self, partition: Entries) -> Iterator[tuple[str, str, bytes]]:
        with opened(partition.archive) as f:
            for name, place, packed, size, method, checksum in partition.entries:
                head = f.read_at(30, place)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError(f"{partition.archive}: no entry at {place}")
                names, extra = struct.unpack_from("<HH", head, 26)
                data = f.read_at(packed, place + 30 + names + extra)
                if method == zipfile.ZIP_DEFLATED:
                    data = zlib.decompressobj(-15).decompress(data, size + 1)  # more than it says it holds is damage
                elif method != zipfile.ZIP_STORED:
                    raise ValueError(f"{partition.archive}: {name} is packed by method {method}")
                if len(data) != size or zlib.crc32(data) != checksum:
                    raise ValueError(f"{partition.archive}: {name} is damaged")
                yield partition.archive, name, data


class ArchiveSource(DataSource):
    """`spark.read.format("zip_entries").option("suffixes", ".usfm,.sfm").load(path)`; `paths` for several, one a line."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return "archive string, path string, content binary"

    def reader(self, schema) -> ArchiveReader:
        paths = self.options.get("archives") or self.options.get("path") or ""
        return ArchiveReader([p for p in paths.split("\n") if p], tuple(self.options.get("suffixes", "").lower().split(",")), int(self.options.get("partitionbytes") or PARTITION_BYTES))


def read_entries(spark: SparkSession, paths: str | list[str], suffixes: tuple[str, ...] = ("",), partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """`archive`, `path` and `content` of the entries with one of the suffixes. A task holds one entry at a time, and an archive is as many tasks' as it has bytes for."""
    spark.dataSource.register(ArchiveSource)
    listed = "\n".join([paths] if isinstance(paths, str) else paths)
    return spark.read.format("zip_entries").option("archives", listed).option("suffixes", ",".join(suffixes)).option("partitionBytes", str(partition_bytes)).load()
