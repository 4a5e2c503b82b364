"""Running a kernel over archive rows, one archive at a time, in bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..kernel.reader import Bytes
from ..session import in_arrow
from ..sources.ranges import open_range

#: Rows and payload bytes after which an output batch is handed on.
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20


def batches(rows: Iterator[dict], schema: pa.Schema, payload: str = "data") -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get(payload) or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield from pa.Table.from_pylist(held, schema).to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_pylist(held, schema).to_batches()


def per_archive(archives: DataFrame, kernel: Callable[[object, dict], Iterator[dict]], schema: str, *carry: str) -> DataFrame:
    """``kernel(source, row)`` -> rows without archive_id; ``carry``: further columns that it wants in ``row``."""
    held = "content" if "content" in archives.columns else "path"
    key = archives.schema["archive_id"].dataType
    full = StructType().add("archive_id", key)
    for f in StructType.fromDDL(schema):
        full.add(f)
    arrow = to_arrow_schema(full)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in stream:
                for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                    source = row.pop(held)
                    source = Bytes(b"" if source is None else bytes(source)) if held == "content" else open_range(source)
                    try:
                        for out in kernel(source, row):
                            yield {"archive_id": row["archive_id"], **out}
                    finally:
                        if held == "path":
                            source.close()

        yield from batches(rows(), arrow)

    return in_arrow(archives.select("archive_id", held, *[F.col(c) for c in carry]), run, full)
