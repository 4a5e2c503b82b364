"""Helpers that every operator of this subpackage shares: stored intermediates and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import in_arrow, shared_folder

#: White space that separates words, as a Java/RE2/Python character class and as characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, level: int = 3) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``level``: of zstd; 1 takes a third less time for texts and an eighth more space. Shuffle files of the step go as soon as it is written; its own files when the driver's JVM ends.
    """
    spark = df.sparkSession
    at = shared_folder(spark)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(at)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(at)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as make it differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def unit_hash(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the first 13 hex digits of an MD5; the same in any SQL engine."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def by_bytes(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices whose sizes sum to about ``most`` at most; one large item is a slice of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with per-task state: ``make()`` runs once in each task and returns the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None and out.num_rows:
                yield out
        del each

    return in_arrow(df, run, schema)
