"""DOS dates and times, both ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import EPOCH_DATE, EPOCH_TIME


def dos_to_timestamp(date: Column, time: Column) -> Column:
    """The wall clock, without zone. Month or day 0 counts as 1; other overflow rolls over."""
    bits = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(mask)
    month, day = F.greatest(F.lit(1), bits(date, 5, 15)), F.greatest(F.lit(1), date.bitwiseAND(31))
    first = F.add_months(F.make_date(1980 + bits(date, 9, 127), F.lit(1), F.lit(1)), month - 1)
    clock = F.make_dt_interval(F.lit(0), bits(time, 11, 31), bits(time, 5, 63), (time.bitwiseAND(31) * 2).cast("decimal(18,6)"))
    return F.date_add(first, day - 1).cast("timestamp_ntz") + clock


def timestamp_to_dos(ts: Column) -> Column:
    """struct(date, time, clamped): whole pairs of seconds; null is the epoch, and what DOS can't say is clamped."""
    year = F.year(ts)
    date = ((year - 1980) * 512 + F.month(ts) * 32 + F.dayofmonth(ts)).cast("int")
    time = (F.hour(ts) * 2048 + F.minute(ts) * 32 + F.floor(F.second(ts) / 2)).cast("int")
    early, late = F.coalesce(year < 1980, F.lit(True)), year > 2107
    return F.struct(
        F.when(early, EPOCH_DATE).when(late, 0xFF9F).otherwise(date).cast("int").alias("date"),
        F.when(early, EPOCH_TIME).when(late, 0xBF7D).otherwise(time).cast("int").alias("time"),
        F.when(year < 1980, "before-1980").when(late, "after-2107").alias("clamped"),
    )
