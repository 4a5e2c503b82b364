"""Attributes, owners, times and flags of entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import AES, DESCRIPTOR, ENCRYPTED, STRONG

_c = lambda c, name: F.col(name) if c is None else c


def unix_mode(made_by: Column | None = None, attributes: Column | None = None) -> Column:
    """The mode if a Unix host wrote the entry, else null."""
    return F.when(F.shiftright(_c(made_by, "version_made_by"), 8) == 3, F.shiftright(_c(attributes, "external_attributes"), 16).bitwiseAND(0xFFFF).cast("int"))


def is_symlink(attributes: Column | None = None) -> Column:
    return F.shiftright(_c(attributes, "external_attributes"), 16).bitwiseAND(0xF000) == 0xA000


def external_attributes(mode: Column, directory: Column) -> Column:
    """Attributes for a mode of 0 to 0xFFFF; a missing file type is filled in."""
    typed = F.when(mode.bitwiseAND(0xF000) == 0, mode.bitwiseOR(F.when(directory, 0x4000).otherwise(0x8000))).otherwise(mode)
    return F.shiftleft(typed.cast("long"), 16).bitwiseOR(F.when(directory, 0x10).otherwise(0).cast("long"))


def is_directory(name: Column | None = None, attributes: Column | None = None, size: Column | None = None) -> Column:
    return _c(name, "name").endswith("/") | ((_c(attributes, "external_attributes").bitwiseAND(0x10) != 0) & (_c(size, "uncompressed_size") == 0))


def is_encrypted(flags: Column | None = None) -> Column:
    return _c(flags, "flags").bitwiseAND(ENCRYPTED | STRONG) != 0


def uses_data_descriptor(flags: Column | None = None) -> Column:
    return _c(flags, "flags").bitwiseAND(DESCRIPTOR) != 0


def encryption_scheme(flags: Column | None = None, method: Column | None = None, extra: Column | None = None) -> Column:
    """aes, strong or zipcrypto; null if the entry isn't encrypted."""
    aes = (_c(method, "compression_method") == AES) | F.exists(_c(extra, "extra_fields"), lambda x: x["id"] == 0x9901)
    scheme = F.when(aes, "aes").when(_c(flags, "flags").bitwiseAND(STRONG) != 0, "strong").otherwise("zipcrypto")
    return F.when(is_encrypted(flags), scheme)


def extended_timestamps() -> Column:
    """struct(source, mtime, atime, ctime): the UT field if it has an mtime, else NTFS, else DOS."""
    part = lambda kind, t: F.timestamp_seconds(f"ut_{t}") if kind == "ut" else F.timestamp_millis(F.col(f"ntfs_{t}"))
    pick = lambda t, dos: F.when(F.col("ut_mtime").isNotNull(), part("ut", t)).when(F.col("ntfs_mtime").isNotNull(), part("ntfs", t)).otherwise(dos)
    none = F.lit(None).cast("timestamp")
    source = F.when(F.col("ut_mtime").isNotNull(), "ut").when(F.col("ntfs_mtime").isNotNull(), "ntfs").otherwise("dos")
    return F.struct(source.alias("source"), pick("mtime", F.col("last_modified")).alias("mtime"), pick("atime", none).alias("atime"), pick("ctime", none).alias("ctime"))


def unix_ids() -> Column:
    """struct(uid, gid), or null."""
    return F.when(F.col("uid").isNotNull(), F.struct("uid", "gid"))
