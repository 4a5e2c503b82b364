"""The checks that relate a directory entry to its bounds, its neighbours and its local header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import DEFAULT_LIMITS, DESCRIPTOR


def limit_error(value: Column, bound: float) -> Column:
    """ZIP_LIMIT_EXCEEDED beyond the bound; null at it or below."""
    return F.when(value > F.lit(float(bound)), F.lit("ZIP_LIMIT_EXCEEDED"))


def ratio() -> Column:
    """Uncompressed over compressed size, where at least 1 KiB is compressed."""
    return F.when(F.col("compressed_size") >= 1024, F.col("uncompressed_size") / F.col("compressed_size"))


def declared_size_error(limits: dict | None = None) -> Column:
    limits = DEFAULT_LIMITS | (limits or {})
    return F.coalesce(limit_error(F.col("uncompressed_size"), limits["max_entry_uncompressed_size"]), limit_error(ratio(), limits["max_compression_ratio"]))


def extent_error() -> Column:
    """An entry must start before the directory, share its start with none, and end before the next starts."""
    local = F.col("local")
    end = local["data_start"] + F.col("compressed_size") + F.when(local["flags"].bitwiseAND(DESCRIPTOR) != 0, 12).otherwise(0)
    overlap = (F.col("local_header_offset") >= F.col("cd_offset")) | F.col("shared_offset") | (end > F.col("next_boundary"))
    return F.when(end > F.col("file_length"), "ZIP_RECORD_TRUNCATED").when(overlap, "ZIP_ENTRY_OVERLAP")


def cross_check_error() -> Column:
    """Method, CRC and sizes of the two headers; both local sizes may be Zip64 sentinels if the CRC agrees."""
    local, most = F.col("local"), F.lit(0xFFFFFFFF)
    same = lambda c, u: (local["crc32"] == F.col("crc32")) & (local["compressed_size"] == c) & (local["uncompressed_size"] == u)
    differ = (local["flags"].bitwiseAND(DESCRIPTOR) == 0) & ~same(F.col("compressed_size"), F.col("uncompressed_size")) & ~same(most, most)
    return F.when(local["method"] != F.col("compression_method"), "ZIP_CD_LFH_MISMATCH").when(differ, "ZIP_SIZE_MISMATCH")
