"""Reports over entry tables: inventory, determinism, assertions, format conformance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import is_symlink, ratio, sanitize_path, timestamp_to_dos
from ..vocabulary import CONCERNS, DEFLATE, EPOCH_DATE, EPOCH_TIME, MADE_BY, STORE, UTF8
from .content import audit
from .scan import diagnostics, layout


def inventory(table: DataFrame) -> DataFrame:
    """Counts, totals, methods, dates and the worst ratio of each archive of an entry table."""
    return table.groupBy("archive_id").agg(
        F.count("*").alias("entry_count"), F.count_if("is_directory").alias("directories"), F.sum("uncompressed_size").alias("uncompressed_size"), F.sum("compressed_size").alias("compressed_size"),
        F.count_if(F.col("compression_method") == STORE).alias("stored"), F.count_if(F.col("compression_method") == DEFLATE).alias("deflated"), F.count_if("is_encrypted").alias("encrypted"),
        F.count_if("uses_zip64").alias("zip64"), F.count_if("uses_data_descriptor").alias("descriptors"), F.min("last_modified").alias("earliest"), F.max("last_modified").alias("latest"), F.max(ratio()).alias("worst_ratio"),
    )


def _concerns(date: Column | None = None) -> list[Column]:
    """For each concern of the fixed list, whether an entry gives cause."""
    dos = None if date is None else timestamp_to_dos(date)
    pinned = (F.col("dos_date") == (EPOCH_DATE if dos is None else dos["date"])) & (F.col("dos_time") == (EPOCH_TIME if dos is None else dos["time"]))
    before = F.lag("raw_name").over(Window.partitionBy("archive_id").orderBy("ordinal"))
    ascii_only = ~F.hex("raw_name").rlike("^(..)*[89A-F]")
    return [
        ~pinned, F.coalesce(before > F.col("raw_name"), F.lit(False)), (F.col("flags").bitwiseAND(UTF8) == 0) & ~ascii_only,
        F.exists("extra_fields", lambda x: x["id"] != 0x0001), F.col("version_made_by") != MADE_BY, F.col("uses_data_descriptor"),
    ]


def determinism_offenders(table: DataFrame, *, date: Column | None = None) -> DataFrame:
    """(archive_id, ordinal, name, rank, concern), one row for each entry and concern."""
    marked = table.withColumns({f"_{k}": test for k, test in enumerate(_concerns(date))})
    found = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(c).alias("concern"), F.col(f"_{k}").alias("hit")) for k, c in enumerate(CONCERNS)])
    return marked.select("archive_id", "ordinal", "name", F.inline(found)).where("hit").drop("hit")


def determinism(table: DataFrame, *, date: Column | None = None) -> DataFrame:
    """The verdict on each archive of an entry table; descriptors are reported but don't count. ``date``: pinned wall clock."""
    marks = table.select("archive_id", *[(~test).alias(f"_{k}") for k, test in enumerate(_concerns(date))])
    names = ("epoch_timestamps", "canonical_order", "utf8_flags", "canonical_extras", "canonical_version_made_by", "no_data_descriptors")
    out = marks.groupBy("archive_id").agg(F.count("*").alias("entry_count"), *[F.bool_and(f"_{k}").alias(n) for k, n in enumerate(names)])
    return out.withColumn("deterministic", F.col(names[0]) & F.col(names[1]) & F.col(names[2]) & F.col(names[3]) & F.col(names[4]))


def assertions(archives: DataFrame, table: DataFrame, *, max_entries: int = 100_000, min_entries: int = 0, max_uncompressed: int = 8 << 30, max_ratio: float = 1024.0, has: str | None = None, method: int | None = None) -> DataFrame:
    """(archive_id, check, ok): the twenty named assertions on each archive."""
    verdict = determinism(table)
    opened = layout(archives).select("archive_id", F.coalesce("is_zip64", F.lit(False)).alias("zip64_trailer"))
    remarks = diagnostics(archives).groupBy("archive_id").agg(F.count("*").alias("remarks"))
    facts = table.groupBy("archive_id").agg(
        F.count("*").alias("n"), F.sum("uncompressed_size").alias("bytes"), F.bool_or("is_encrypted").alias("enc"), F.bool_or(is_symlink()).alias("links"), F.bool_or("uses_zip64").alias("z64"),
        F.bool_and(sanitize_path(F.col("name")).isNotNull()).alias("safe"), F.countDistinct("name").alias("names"), F.bool_and(F.col("compression_method") == STORE).alias("stored"),
        F.bool_and(F.col("compression_method") == DEFLATE).alias("deflated"), F.max(ratio()).alias("ratio"), F.bool_or(F.col("name") == F.lit(has)).alias("has"), F.bool_and(F.col("compression_method") == F.lit(method)).alias("of_method"),
    )
    one = facts.join(verdict, "archive_id").join(opened, "archive_id").join(remarks, "archive_id", "left")
    zip64 = F.col("z64") | F.col("zip64_trailer")
    checks = {
        "deterministic": F.col("deterministic"), "epoch-timestamps": F.col("epoch_timestamps"), "canonical-order": F.col("canonical_order"), "utf8-names": F.col("utf8_flags"),
        "no-data-descriptor": F.col("no_data_descriptors"), "no-zip64": ~zip64, "zip64": zip64, "no-encryption": ~F.col("enc"), "no-symlinks": ~F.col("links"), "safe-names": F.col("safe"),
        "no-duplicates": F.col("names") == F.col("n"), "no-diagnostics": F.coalesce("remarks", F.lit(0)) == 0, "store-only": F.col("stored"), "deflate-only": F.col("deflated"),
        "max-entries": F.col("n") <= max_entries, "min-entries": F.col("n") >= min_entries, "max-uncompressed": F.col("bytes") <= max_uncompressed, "max-ratio": F.coalesce(F.col("ratio") <= max_ratio, F.lit(True)),
        "has": F.lit(True) if has is None else F.col("has"), "method": F.lit(True) if method is None else F.col("of_method"),
    }
    return one.select("archive_id", F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks.items()])))


#: Flag bits that a document container may not set.
_FORBIDDEN = 0xF7F1


def iso_findings(archives: DataFrame) -> DataFrame:
    """(archive_id, ordinal, finding): departures from the document container profile and from well-formedness.

    Versions up to 4.5, store and deflate only, no encryption, no forbidden flags, UTF-8 flagged names beyond ASCII, a single
    volume, no signature or encryption records around the directory, and directory, local headers, data descriptors (of the
    width that the local header says) and extents that agree. Nothing is decoded.
    """
    facts, local = audit(archives, decode=False), F.col("local")
    ascii_only = ~F.hex("raw_name").rlike("^(..)*[89A-F]")
    tests = {
        "ISO-4.4.3": (F.col("version_needed") > 45) | (local["version_needed"] > 45),
        "ISO-4.4.5": ~F.col("compression_method").isin(STORE, DEFLATE),
        "ISO-4.3.8": F.col("is_encrypted"),
        "ISO-4.4.4": (F.col("flags").bitwiseAND(_FORBIDDEN) != 0) | (local["flags"].bitwiseAND(_FORBIDDEN) != 0) | (F.col("flags").bitwiseAND(UTF8) != local["flags"].bitwiseAND(UTF8)),
        "ISO-NOTE-1": ~ascii_only & (F.col("flags").bitwiseAND(UTF8) == 0),
        "WF/LFH-SIGNATURE": local.isNull(),
        "WF/LFH-METHOD-MISMATCH": local["method"] != F.col("compression_method"),
        "WF/LFH-NAME-MISMATCH": local["name"] != F.col("raw_name"),
        "WF/LFH-SIZE-MISMATCH": (local["flags"].bitwiseAND(8) == 0) & ((local["compressed_size"] != F.col("compressed_size")) | (local["uncompressed_size"] != F.col("uncompressed_size"))) & (local["compressed_size"] != 0xFFFFFFFF),
        "WF/LFH-CRC-MISMATCH": (local["flags"].bitwiseAND(8) == 0) & (local["crc32"] != F.col("crc32")),
        "WF/DESCRIPTOR-WIDTH": F.col("descriptor") == "width",
        "WF/DESCRIPTOR-MISMATCH": F.col("descriptor") == "none",
        "ISO-4.3.10": F.col("before_directory") == F.lit(b"PK\x06\x08"),
        "ISO-4.3.13": (F.col("behind_directory") == F.lit(b"PK\x05\x05")) & (F.col("ordinal") == 0),
        "WF/ENTRY-OVERLAP": F.col("shared_offset") | (local["data_start"] + F.col("compressed_size") > F.col("next_boundary")),
    }
    found = F.array(*[F.struct(F.lit(k).alias("finding"), F.coalesce(v, F.lit(False)).alias("hit")) for k, v in tests.items()])
    each = facts.select("archive_id", "ordinal", F.inline(found)).where("hit").drop("hit")
    codes = F.create_map(*[F.lit(x) for pair in {
        "ZIP_EOCD_NOT_FOUND": "WF/EOCD-NOT-FOUND", "ZIP_ZIP64_LOCATOR_MISSING": "WF/ZIP64-LOCATOR", "ZIP_ZIP64_EOCD_MISPLACED": "WF/ZIP64-EOCD", "ZIP_UNSUPPORTED_MULTI_DISK": "ISO-4.3.3",
        "ZIP_EOCD_INCONSISTENT": "WF/CD-OFFSET", "ZIP_CD_INCONSISTENT": "WF/CD-COUNT", "ZIP_RECORD_TRUNCATED": "WF/CD-SIZE", "ZIP_SIGNATURE_MISMATCH": "WF/CD-COUNT", "ZIP_ZIP64_CONTRADICTION": "WF/ZIP64-EOCD",
    }.items() for x in pair])
    whole = diagnostics(archives).where("severity = 'error'").select("archive_id", F.lit(None).cast("int").alias("ordinal"), F.when(F.col("message").contains("on this disk"), "ISO-4.4.1.5").otherwise(F.coalesce(F.try_element_at(codes, F.col("code")), "code")).alias("finding"))
    return each.unionByName(whole)
