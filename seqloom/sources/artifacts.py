"""Inventory of files by their first bytes: a data source that reads no more of a file than tells its kind and counts."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: First bytes of a file, and what it then is.
MAGIC = [(b"PAR1", "parquet"), (b"ORC", "orc"), (b"Obj\x01", "avro"), (b"\x1f\x8b", "gzip"), (b"PK\x03\x04", "zip"), (b"RIFF", "riff"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"{", "json"), (b"[", "json")]
#: Bytes of a file's head that are read; files of one partition.
HEAD, FILES = 64, 256


class _Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]], root: str):
        self.paths, self.root = paths, root


def kind_of(head: bytes) -> str:
    return next((kind for magic, kind in MAGIC if head.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(magic)), "empty" if not head else "other")


def described(fs, path: str, size: int) -> tuple[str, str, int, int | None, str]:
    """path, kind, bytes, records (of a Parquet footer or a wave header, else null), and what is wrong with it."""
    with fs.open_input_file(path) as f:
        head = f.read(HEAD)
        kind, records, error = kind_of(head), None, ""
        if kind == "parquet":
            import pyarrow.parquet as pq

            try:
                records = pq.ParquetFile(f).metadata.num_rows  # reads the footer only
            except Exception as e:  # noqa: BLE001  a broken file is a row of the inventory, not its end
                error = type(e).__name__
        elif kind == "riff" and head[8:16] == b"WAVEfmt " and len(head) >= 36:
            block = struct.unpack_from("<H", head, 32)[0]
            at = head.find(b"data", 36)
            records = struct.unpack_from("<I", head, at + 4)[0] // max(1, block) if 0 <= at <= HEAD - 8 else None
    return path, kind, size, records, error


class _Reader(DataSourceReader):
    def __init__(self, path: str, ignored: bool):
        self.path, self.ignored = path, ignored

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        hidden = lambda p: any(x.startswith((".", "_")) for x in p[len(root) :].split("/") if x)
        files = sorted((i.path, i.size) for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and (self.ignored or not hidden(i.path)))
        return [_Files(files[k : k + FILES], self.path) for k in range(0, len(files), FILES)] or [_Files([], self.path)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(partition.root if "://" in partition.root or partition.root.startswith("file:") else f"file://{partition.root}")
        for path, size in partition.paths:
            yield described(store, path, size)


class Artifacts(DataSource):
    """path, kind, bytes, records, error of every file under a path that pyarrow's file systems reach."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return "path string, kind string, bytes long, records long, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], self.options.get("hidden", "false").lower() == "true")


def artifacts(spark: SparkSession, path: str, hidden: bool = False) -> DataFrame:
    """The inventory of a folder; names that start with a dot or an underscore are left out unless asked for."""
    spark.dataSource.register(Artifacts)
    return spark.read.format("artifacts").option("path", path).option("hidden", str(hidden).lower()).load()
