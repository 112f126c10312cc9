"""The data source ``tablemeta``: tables of metadata documents by path.

``spark.read.format("tablemeta").option("table", "snapshots").load(folder)``

Options: ``table`` (one of frames.TABLES, or ``errors``: file and error of each file
that is no document), ``dialect``, ``badfiles`` (``fail``, the default, or ``skip``).
Paths are local ones or URIs of a file system that Arrow knows (file, s3, gs, hdfs).
Files are packed into input partitions of about ``PACK_BYTES``; equality filters on
``table_uuid`` are applied while the files are read, before any row is handed to
Spark. Empty folders give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from tablelens.codec import CodecError, body_text, parse_table_metadata
from tablelens.operators.frames import TABLES, rows_of
from tablelens.shared import ship

ERRORS = "errors"
PACK_BYTES, PACK_FILES = 32_000_000, 10_000


class _Files(InputPartition):
    def __init__(self, paths: tuple[str, ...]):
        self.paths = paths


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table, self.dialect = options["path"], options.get("table", "tables"), options.get("dialect", "reference")
        self.skips = options.get("badfiles", "fail") == "skip" or self.table == ERRORS
        self.uuids: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("table_uuid",):
                self.uuids = {f.value} if self.uuids is None else self.uuids & {f.value}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = _open(self.path)
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda f: any(p.startswith((".", "_")) for p in f.path[len(root) :].split("/")) and f.path != root
        packs: list[list[str]] = [[]]
        size = 0
        for f in sorted((f for f in files if f.type == fs.FileType.File and not hidden(f)), key=lambda f: f.path):
            if packs[-1] and (size + f.size > PACK_BYTES or len(packs[-1]) >= PACK_FILES):
                packs.append([])
                size = 0
            packs[-1].append(f.path)
            size += f.size
        return [_Files(tuple(p)) for p in packs]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = _open(self.path)
        for path in partition.paths:
            try:
                with system.open_input_stream(path) as stream:
                    md = parse_table_metadata(body_text(stream.read().decode("utf-8")), self.dialect)
            except (CodecError, UnicodeDecodeError) as e:
                if not self.skips:
                    raise ValueError(f"{path}: {e}") from e
                if self.table == ERRORS:
                    yield path, str(e)
                continue
            if self.table != ERRORS and (self.uuids is None or md.table_uuid in self.uuids):
                yield from rows_of(md, self.table)


class TableMeta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tablemeta"

    def schema(self) -> str:
        table = self.options.get("table", "tables")
        if table == ERRORS:
            return "file string, error string"
        if table not in TABLES:
            raise ValueError(f"unknown table {table!r}; one of {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, filters included."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TableMeta)
