"""Opening archives: layout, entries, local headers, diagnostics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dos_to_timestamp, is_directory, is_encrypted, uses_data_descriptor
from ..kernel.codecs import codec_table
from ..kernel.reader import Archive
from ..vocabulary import DIAGNOSTICS, ZipFault, resolve_limits
from ._run import per_archive

_TIMES = ", ".join(f"{k}_{t} long" for k in ("ut", "ntfs") for t in ("mtime", "atime", "ctime"))
RAW_ENTRY = (
    "ordinal int, name string, raw_name binary, name_encoding string, compression_method int, compressed_size long, uncompressed_size long, crc32 long, "
    "local_header_offset long, dos_date int, dos_time int, flags int, version_made_by int, version_needed int, internal_attributes int, external_attributes long, "
    f"comment binary, extra_fields array<struct<id: int, data: binary>>, uses_zip64 boolean, uid long, gid long, {_TIMES}, next_boundary long, shared_offset boolean"
)
LOCAL = "struct<version_needed: int, flags: int, method: int, dos_time: int, dos_date: int, crc32: long, compressed_size: long, uncompressed_size: long, name: binary, extra: binary, data_start: long>"


def opened(limits: dict | None, decoder: Callable | None = None) -> Callable[[object], Archive]:
    """What tasks use to open a source; the limits are checked here, before any job."""
    bounds, codecs = resolve_limits(limits), codec_table()
    return lambda source: Archive(source, bounds, decoder=decoder, codecs=codecs)


def with_derived(raw: DataFrame, dos_time_mode: str = "local") -> DataFrame:
    """The columns of an entry that follow from the stored ones."""
    dos = dos_to_timestamp(F.col("dos_date"), F.col("dos_time"))
    dos = F.convert_timezone(F.lit("UTC"), F.current_timezone(), dos).cast("timestamp") if dos_time_mode == "utc" else dos.cast("timestamp")
    return raw.withColumns({
        "is_directory": is_directory(), "is_encrypted": is_encrypted(), "uses_data_descriptor": uses_data_descriptor(),
        "last_modified": F.coalesce(F.timestamp_seconds("ut_mtime"), dos),
    })


def layout(archives: DataFrame, *, limits: dict | None = None) -> DataFrame:
    """One row an archive: where its directory lies, or error_code and error_message. Only the tail is looked at."""
    start = opened(limits)

    def kernel(source, row: dict) -> Iterator[dict]:
        try:
            x = start(source).layout
            yield {**vars(x), "file_length": source.size, "error_code": None, "error_message": None}
        except ZipFault as fault:
            yield {"file_length": source.size, "error_code": fault.code, "error_message": fault.message}

    return per_archive(archives, kernel, "total_entries long, cd_size long, cd_offset long, base long, is_zip64 boolean, comment binary, file_length long, error_code string, error_message string")


def entries(archives: DataFrame, *, limits: dict | None = None, name_decoder: Callable[[bytes], str] | None = None, dos_time_mode: str = "local", mode: str = "report") -> DataFrame:
    """One row a record of each central directory; an archive that doesn't open has none (``mode="raise"``: fails the job).

    ``name_decoder`` is tried for names that are no valid flagged UTF-8.
    """
    start = opened(limits, name_decoder)

    def kernel(source, row: dict) -> Iterator[dict]:
        try:
            yield from start(source).entries
        except ZipFault:
            if mode == "raise":
                raise

    return with_derived(per_archive(archives, kernel, RAW_ENTRY), dos_time_mode)


def local_headers(archives: DataFrame, *, limits: dict | None = None) -> DataFrame:
    """The local header of every directory entry, or why it can't be read."""
    start = opened(limits)

    def kernel(source, row: dict) -> Iterator[dict]:
        try:
            archive = start(source)
            found = archive.entries
        except ZipFault:
            return
        for e in found:
            try:
                yield {"ordinal": e["ordinal"], "local": archive.local(e), "error_code": None}
            except ZipFault as fault:
                yield {"ordinal": e["ordinal"], "local": None, "error_code": fault.code}

    return per_archive(archives, kernel, f"ordinal int, local {LOCAL}, error_code string").select("archive_id", "ordinal", "local.*", "error_code")


def diagnostics(archives: DataFrame, *, limits: dict | None = None, validate: str | None = None, strict: bool = False) -> DataFrame:
    """(archive_id, seq, code, severity, entry_name, message): what opening remarks, and the error that ends it as severity "error".

    ``validate="extent"`` also parses local headers and checks extents, ``"eager"`` cross-checks them too.
    ``strict`` turns the first remark into ZIP_STRICT_DIAGNOSTIC.
    """
    start = opened(limits)

    def kernel(source, row: dict) -> Iterator[dict]:
        archive, fault = None, None
        try:
            archive = start(source)
            names: dict[str, int] = {}
            for e in archive.entries:
                if e["name"] in names:
                    archive.diagnose("ZIP_DUPLICATE_NAME", e["name"])
                names[e["name"]] = e["ordinal"]
            for e in archive.entries if validate == "eager" else ():
                archive.checked(e)
            if validate == "extent":
                archive.check_extents()
        except ZipFault as found:
            fault = found
        seq = 0
        for code, name in archive.found if archive else ():
            yield {"seq": seq, "code": "ZIP_STRICT_DIAGNOSTIC" if strict else code, "severity": "error" if strict else DIAGNOSTICS[code], "entry_name": name}
            if strict:
                return
            seq += 1
        if fault:
            yield {"seq": seq, "code": fault.code, "severity": "error", "entry_name": fault.entry, "message": fault.message}

    return per_archive(archives, kernel, "seq int, code string, severity string, entry_name string, message string")


def point_lookup(table: DataFrame, name: str | Column) -> DataFrame:
    """The entry of that name in each archive of an entry table; of several the last."""
    last = Window.partitionBy("archive_id").orderBy(F.desc("ordinal"))
    return table.where(F.col("name") == name).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
