"""Reading archives front to back, and holding that view against the central directory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel.codecs import codec_table
from ..kernel.forward import walk
from ..kernel.reader import chunks
from ..vocabulary import ZipFault, resolve_limits
from ._run import per_archive
from .scan import entries

STREAM_ENTRY = (
    "ordinal int, name string, raw_name binary, name_encoding string, is_directory boolean, compression_method int, compressed_size long, uncompressed_size long, crc32 long, "
    "flags int, version_needed int, dos_date int, dos_time int, is_encrypted boolean, offset long, extra_fields array<struct<id: int, data: binary>>, ut_mtime long, data binary, error_code string"
)


def forward_rows(pieces, limits: dict, codecs: dict, **options) -> Iterator[dict]:
    """The rows of a forward walk; a fault that ends it is a last row without a name."""
    number = -1
    try:
        for row in walk(pieces, limits, codecs, **options):
            number = row["ordinal"]
            yield row
    except ZipFault as fault:
        yield {"ordinal": number + 1, "error_code": fault.code}


def forward_entries(archives: DataFrame, *, with_data: bool = False, decode: bool = True, limits: dict | None = None, name_decoder: Callable | None = None, chunk: int = 65_536) -> DataFrame:
    """One row an entry as a reader without the directory sees it; works on batch and streaming frames alike.

    ``decode=False`` steps over contents (where a descriptor hides their length they are decoded all the same).
    """
    bounds, codecs = resolve_limits(limits), codec_table()

    def kernel(source, row: dict) -> Iterator[dict]:
        pieces = chunks(source.data, chunk) if hasattr(source, "data") else (source.read(at, min(chunk, source.size - at)) for at in range(0, source.size, chunk))
        yield from forward_rows(pieces, bounds, codecs, decoder=name_decoder, with_data=with_data, decode=decode)

    return per_archive(archives, kernel, STREAM_ENTRY)


def trust_differences(archives: DataFrame, *, limits: dict | None = None) -> DataFrame:
    """Entries that one of the two readers sees otherwise: (archive_id, offset, in_directory, in_stream, directory_name, stream_name, differs)."""
    a = entries(archives, limits=limits).select("archive_id", F.col("local_header_offset").alias("offset"), F.struct("name", "compression_method", "uncompressed_size", "crc32").alias("a"))
    b = forward_entries(archives, limits=limits).where("name is not null").select("archive_id", "offset", F.struct("name", "compression_method", "uncompressed_size", "crc32").alias("b"))
    both = a.join(b, ["archive_id", "offset"], "full_outer")
    differs = F.concat_ws(",", *[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in ("name", "compression_method", "uncompressed_size", "crc32")])
    out = both.select("archive_id", "offset", F.col("a").isNotNull().alias("in_directory"), F.col("b").isNotNull().alias("in_stream"), F.col("a.name").alias("directory_name"), F.col("b.name").alias("stream_name"), differs.alias("differs"))
    return out.where("not in_directory or not in_stream or differs <> ''")
