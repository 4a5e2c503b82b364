"""The plan of written archives: names, defaults and order as columns, offsets as running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import external_attributes, name_error, timestamp_to_dos, written_name
from ..vocabulary import resolve_limits

#: Optional columns of an entry to be written, and what stands in for each.
OPTIONS: dict[str, tuple[str, object]] = {
    "seq": ("long", None), "is_directory": ("boolean", False), "date": ("timestamp_ntz", None), "mode": ("int", None), "comment": ("binary", None), "method": ("string", "deflate"), "level": ("int", 6),
    "layout": ("string", "buffered"), "extra": ("array<struct<id: int, data: binary>>", None),
}


def completed(rows: DataFrame) -> DataFrame:
    """All option columns, absent ones and nulls filled in."""
    out = rows
    for name, (kind, default) in OPTIONS.items():
        value = F.col(name) if name in rows.columns else F.lit(None)
        value = value.cast(kind)
        out = out.withColumn(name, value if default is None else F.coalesce(value, F.lit(default)))
    return out


def validated(rows: DataFrame, limits: dict | None = None) -> DataFrame:
    """Completed rows with raw_name, DOS date and time, attributes, and error_code (null if an entry may be written)."""
    bounds = resolve_limits(limits)
    rows = completed(rows).withColumn("name", written_name(F.col("name"), F.col("is_directory")))
    rows = rows.withColumns({"raw_name": F.encode("name", "UTF-8"), "_dos": timestamp_to_dos(F.col("date")), "_extra_bytes": F.aggregate(F.coalesce("extra", F.array().cast(OPTIONS["extra"][0])), F.lit(0), lambda a, x: a + 4 + F.octet_length(x["data"]))})
    over = lambda c, name: c > F.lit(float(bounds[name]))
    wrong = (
        F.when(~F.col("level").between(0, 9) | ~F.col("method").isin("store", "deflate") | ~F.col("layout").isin("buffered", "descriptor", "descriptor64") | ~F.coalesce(F.col("mode"), F.lit(0)).between(0, 0xFFFF) | (F.col("_extra_bytes") > 0xFFFF), "ZIP_INVALID_OPTION")
        .when(over(F.octet_length("raw_name"), "max_name_bytes") | over(F.octet_length("comment"), "max_comment_bytes") | over(F.col("_extra_bytes"), "max_extra_field_bytes"), "ZIP_LIMIT_EXCEEDED")
    )
    # names are counted by short keys, and what follows from long columns is known before, so that these needn't be sorted
    length = F.octet_length("raw_name")
    key = F.when(length > 64, F.unhex(F.sha2("raw_name", 256))).otherwise(F.col("raw_name"))
    rows = rows.withColumns({"_invalid": name_error(F.col("name")).isNotNull(), "_wrong": wrong, "_length": length, "_key": key})
    twice = F.count("*").over(Window.partitionBy("archive_id", "_length", "_key")) > 1
    error = F.when(F.col("_invalid"), "ZIP_INVALID_ENTRY_NAME").when(twice, "ZIP_DUPLICATE_ENTRY_NAME").otherwise(F.col("_wrong"))
    plain = F.when(F.col("is_directory"), F.lit((0o40755 << 16) | 0x10)).otherwise(F.lit(0o100644 << 16))
    attributes = F.coalesce(external_attributes(F.col("mode"), F.col("is_directory")), plain)
    return rows.withColumns({"dos_date": F.col("_dos.date"), "dos_time": F.col("_dos.time"), "clamped": F.col("_dos.clamped"), "external": attributes, "error_code": error}).drop("_dos", "_extra_bytes", "_invalid", "_wrong", "_length", "_key")


def order_key(canonical: bool) -> list[Column]:
    """Bytes of names, or the order of insertion."""
    return [F.col("raw_name")] if canonical else [F.col("seq"), F.col("raw_name")]


def planned(sized: DataFrame, *, canonical: bool = True, start: Column | None = None) -> DataFrame:
    """Rows with seg_length in the order they are written, with position and offset: what the earlier ones take, from ``start`` on."""
    earlier = Window.partitionBy("archive_id").orderBy(*order_key(canonical))
    offset = F.coalesce(F.sum("seg_length").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = offset if start is None else offset + start
    return sized.withColumns({"position": F.row_number().over(earlier) - 1, "offset": offset})
