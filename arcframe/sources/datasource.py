"""spark.read.format("arcframe"): entry tables straight from files, by ranges, with filters on names pushed down."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..kernel.codecs import codec_table
from ..kernel.reader import Archive
from ..vocabulary import ZipFault, resolve_limits
from .ranges import open_range, sized_files

ENTRY = "archive_id string, ordinal int, name string, compression_method int, compressed_size long, uncompressed_size long, crc32 long, local_header_offset long, flags int, data binary, error_code string"


#: A partition is a run of files: a 64th of them, but at most so many and about so many bytes.
SHARE, MOST_FILES, MOST_BYTES = 64, 512, 64 << 20


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def runs(files: list[tuple[str, int]]) -> list[_Files]:
    """(path, size) files, in order, as partitions of bounded number and size; a large file is one of its own."""
    most = min(MOST_FILES, -(-len(files) // SHARE))
    out, held, size = [], [], 0
    for path, n in files:
        if held and (len(held) >= most or size + n > MOST_BYTES):
            out.append(_Files(held))
            held, size = [], 0
        held.append(path)
        size += n
    return [*out, _Files(held)]


class ArchiveReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], with_data: bool, schema: StructType):
        self.files, self.with_data, self.arrow, self.codecs = files, with_data, to_arrow_schema(schema), codec_table()
        self.names: list[tuple[str, object]] = []

    def __getstate__(self) -> dict:
        """What travels with every task: not the list of all files."""
        return {**vars(self), "files": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names and archives by equality, list and prefix; all filters are still applied above."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at in (("name",), ("archive_id",)) and isinstance(f, (EqualTo, In, StringStartsWith)):
                values = tuple(f.value) if isinstance(f, In) else f.value
                self.names.append((f"{at[0]}:{'prefix' if isinstance(f, StringStartsWith) else 'in'}", values if isinstance(values, tuple) else (values,)))
            yield f

    def _wanted(self, kind: str, value: str) -> bool:
        tests = [(k.split(":")[1], v) for k, v in self.names if k.startswith(kind + ":")]
        return all(value in v if how == "in" else value.startswith(v[0]) for how, v in tests)

    def partitions(self) -> list[_Files]:
        return runs([f for f in self.files if self._wanted("archive_id", f[0])])

    def read(self, partition: _Files):
        from ..operators._run import batches

        yield from batches((row for path in partition.paths for row in self._rows(path)), self.arrow)

    def _rows(self, path: str) -> Iterator[dict]:
        columns = [f.name for f in self.arrow]
        empty = dict.fromkeys(columns) | {"archive_id": path}
        source = open_range(path)
        try:
            yield from self._entries(source, empty)
        finally:
            source.close()

    def _entries(self, source: object, empty: dict) -> Iterator[dict]:
        columns = list(empty)
        try:
            archive = Archive(source, resolve_limits(), codecs=self.codecs)
            found = archive.entries
        except ZipFault as fault:
            yield empty | {"error_code": fault.code}
            return
        for e in found:
            if not self._wanted("name", e["name"]):
                continue
            row = empty | {k: e[k] for k in columns if k in e}
            if self.with_data:
                try:
                    row["data"] = archive.read(e)
                except ZipFault as fault:
                    row["error_code"] = fault.code
            yield row


class ArchiveSource(DataSource):
    """Options: path (files, folders, patterns, separated by commas), pattern (of files in folders, *.zip), data ("true" reads contents)."""

    @classmethod
    def name(cls) -> str:
        return "arcframe"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema: StructType) -> ArchiveReader:
        files = [f for p in self.options.get("path", "").split(",") if p for f in sized_files(p, self.options.get("pattern", "*.zip"))]
        return ArchiveReader(files, self.options.get("data", "false").lower() == "true", schema)


def register(spark: SparkSession) -> None:
    """The data source with pushed filters, and the table functions zip_layout, zip_entries and zip_forward."""
    from ..functions.tables import register_tables

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    register_tables(spark)
