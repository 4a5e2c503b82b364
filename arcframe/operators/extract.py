"""Safe extraction: which entries come out, under which path, or why none do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import is_symlink, sanitize_path
from ..vocabulary import resolve_limits
from .content import read_entries
from .scan import entries


def extraction_plan(table: DataFrame, *, where: Column | None = None, reject_symlinks: bool = True, on_unsafe: str = "error", on_duplicate: str = "error", limits: dict | None = None) -> DataFrame:
    """(archive_id, ordinal, path, position, error_code) from an entry table.

    In directory order: directories and what ``where`` refuses are passed over; then symbolic links, unsafe paths, the
    running total of declared sizes (duplicates count, whichever is kept) and repeated paths are checked. An
    archive with an error has one row, its first error. ``on_unsafe="skip"`` leaves unsafe entries out;
    ``on_duplicate`` is "error", "first" or "last" (at the place of the first).
    """
    bound = resolve_limits(limits)["max_total_uncompressed_size"]
    rows = table.where(~F.col("is_directory"))
    rows = rows if where is None else rows.where(where)
    rows = rows.withColumn("path", sanitize_path(F.col("name")))
    link = is_symlink() if reject_symlinks else F.lit(False)
    if on_unsafe == "skip":
        rows = rows.where(F.col("path").isNotNull() | link)
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as given, not joined to larger ones: rows are short, a task sorts them twice
    rows = rows.withColumn("_link", link).repartition(parts, "archive_id")
    running = Window.partitionBy("archive_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("archive_id", "path").orderBy("ordinal")
    # two sorts: by ordinal, and by path and ordinal, which serves all that regards repeats and the whole archive
    rows = rows.withColumn("_total", F.sum("uncompressed_size").over(running))
    rows = rows.withColumns({"_nth": F.row_number().over(same), "_last": F.lead(F.lit(1)).over(same).isNull(), "position": F.min("ordinal").over(same.rowsBetween(Window.unboundedPreceding, 0))})
    error = F.when(F.col("_link"), "ZIP_SYMLINK_REJECTED").when(F.col("path").isNull(), "ZIP_PATH_TRAVERSAL").when(F.col("_total") > F.lit(float(bound)), "ZIP_LIMIT_EXCEEDED")
    if on_duplicate == "error":
        error = error.when(F.col("_nth") > 1, "ZIP_EXTRACT_DUPLICATE_PATH")
    rows = rows.withColumn("error_code", error)
    whole = Window.partitionBy("archive_id")
    rows = rows.withColumn("_stop", F.min(F.when(F.col("error_code").isNotNull(), F.col("ordinal"))).over(whole))
    kept = F.col("_last") if on_duplicate == "last" else F.col("_nth") == 1
    return rows.where(F.col("_stop").isNull() & kept | (F.col("ordinal") == F.col("_stop"))).select("archive_id", "ordinal", "path", "position", "error_code")


def extract(archives: DataFrame, *, chunk: int | None = None, limits: dict | None = None, **options) -> DataFrame:
    """(archive_id, ordinal, path, position, [chunk_no,] data, error_code); nothing is written anywhere.

    Only entries that the plan lets out are decoded.
    """
    plan = extraction_plan(entries(archives, limits=limits), limits=limits, **options)
    read = read_entries(archives, ordinals=plan.where("error_code is null"), limits=limits).drop("name").withColumnRenamed("error_code", "read_error")
    out = plan.join(read, ["archive_id", "ordinal"], "left").withColumn("error_code", F.coalesce("error_code", "read_error")).drop("read_error")
    if chunk is None:
        return out
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length("data") - 1) / chunk).cast("int"))), lambda k: F.substring(F.col("data"), k * chunk + 1, F.lit(chunk)))
    return out.select("archive_id", "ordinal", "path", "position", F.posexplode_outer(pieces).alias("chunk_no", "data"), "error_code")
