"""Proportional stratified interleaving: every shard has the mixture of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, unused


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows``, stored, with their place (from 0) in ``order``, over all of them.

    Rows are dealt by ranges of ``order``, so no value of a column, however frequent, falls into one task; a row's place is
    its number within its range plus the sizes of the ranges before, of which there are as many as tasks.
    """
    at, part, n, before = unused(rows, "_at", "_part", "_n", "_before")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = materialize(placed).withColumn(part, F.shiftright(at, 33))  # the upper bits are the partition
    sizes = placed.groupBy(part).agg(F.count("*").alias(n))
    first = F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(part, first.alias(before))
    number = F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(before)
    return placed.join(F.broadcast(sizes), part).withColumn(name, number).drop(at, part, before)


def assign_shards(rows: DataFrame, *, shards: int = 24, stratum: str = "source", order: list[str], seed: str = "shard") -> DataFrame:
    """``rows`` with shard (0..shards-1) and slot (gapless from 0): row counts of shards differ by one at most.

    Within each stratum rows are ranked by a seeded hash of ``order[0]`` (then ``order``), the strata are interleaved by
    (rank - 1/2) / rows of the stratum, and that order is cut into equal parts. Both orders are laid by ranges, so a stratum
    with a third of all rows, or any number of strata of one row, is dealt over all tasks. Null is a stratum of its own; a
    null or repeated id is ordered by the further columns (rows equal in all of them are interchangeable); texts are not
    read; an empty table gives an empty result. Columns pass through (shard and slot are replaced), so project before if
    they are wide.
    """
    rows = rows.drop("shard", "slot")
    key, none, label, rank, size, first, frac, place = unused(rows, "_key", "_none", "_name", "_rank", "_size", "_first", "_frac", "_place")
    seeded = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(order[0]).cast("string"), F.lit(""))))
    keyed = rows.withColumns({key: seeded, none: F.col(stratum).isNull(), label: F.coalesce(F.col(stratum).cast("string"), F.lit(""))})
    total = rows.count()
    inner = ranked(keyed, [none, label, key, *order], rank)
    strata = materialize(inner.groupBy(none, label).agg(F.count("*").alias(size), F.min(rank).alias(first)))
    inner = inner.join(strata, [none, label])
    inner = inner.withColumn(frac, (F.col(rank) - F.col(first) + F.lit(0.5)) / F.col(size)).drop(rank, size, first)
    placed = ranked(inner, [frac, none, label, key, *order], place)
    each, more = divmod(total, shards)  # the first `more` shards have one row more
    head = more * (each + 1)
    div = lambda a, b: F.floor(a / F.lit(max(1, b)))
    shard = F.when(F.col(place) < head, div(F.col(place), each + 1)).otherwise(more + div(F.col(place) - head, each)).cast("int")
    start = F.col("shard") * each + F.least(F.col("shard"), F.lit(more))
    return placed.withColumn("shard", shard).withColumn("slot", F.col(place) - start).drop(none, label, key, frac, place)


def write_shards(rows: DataFrame, path: str, **options) -> None:
    """Write all rows as one Parquet folder a shard (shard=0, 1, ...), each ordered by slot."""
    placed = assign_shards(rows, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
