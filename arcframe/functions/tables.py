"""Table functions for SQL: SELECT ... FROM archives, LATERAL zip_entries(content)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..kernel.codecs import codec_table
from ..kernel.forward import walk
from ..kernel.reader import Archive, Bytes
from ..vocabulary import ZipFault, resolve_limits


def register_tables(spark: SparkSession) -> None:
    codecs = codec_table()

    @udtf(returnType="total_entries long, cd_size long, cd_offset long, base long, is_zip64 boolean, comment binary, error_code string")
    class ZipLayout:
        def eval(self, content: bytes):
            try:
                x = Archive(Bytes(bytes(content or b"")), resolve_limits()).layout
                yield x.total_entries, x.cd_size, x.cd_offset, x.base, x.is_zip64, x.comment, None
            except ZipFault as fault:
                yield None, None, None, None, None, None, fault.code

    @udtf(returnType="ordinal int, name string, compression_method int, compressed_size long, uncompressed_size long, crc32 long, error_code string")
    class ZipEntries:
        def eval(self, content: bytes):
            try:
                for e in Archive(Bytes(bytes(content or b"")), resolve_limits()).entries:
                    yield e["ordinal"], e["name"], e["compression_method"], e["compressed_size"], e["uncompressed_size"], e["crc32"], None
            except ZipFault as fault:
                yield None, None, None, None, None, None, fault.code

    @udtf(returnType="ordinal int, name string, uncompressed_size long, crc32 long, error_code string")
    class ZipForward:
        def eval(self, content: bytes):
            try:
                for e in walk([bytes(content or b"")], resolve_limits(), codecs):
                    yield e["ordinal"], e["name"], e["uncompressed_size"], e["crc32"], e["error_code"]
            except ZipFault as fault:
                yield None, None, None, None, fault.code

    for name, kind in (("zip_layout", ZipLayout), ("zip_entries", ZipEntries), ("zip_forward", ZipForward)):
        spark.udtf.register(name, kind)
