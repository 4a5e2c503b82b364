"""Mixing sources to target weights, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD_PATTERN, materialize, unit_hash

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A table of sources with more rows is joined by a shuffle, not broadcast.
BROADCAST_ROWS = 10_000


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, ceiling: int = 3) -> DataFrame:
    """(source, source_size, target) for each source; one row a source is all that meets in one task.

    The targets share the sum of all sizes by weight; none exceeds ``ceiling`` times its source's size, and what is cut
    off goes to the others by weight until none is above. That is the level at which sum(min(level * weight,
    ceiling * size)) is the whole: in order of ceiling * size / weight, a source is capped as long as its cap is below
    its share of what the earlier ones leave.
    """
    names = Window.orderBy(F.col(source).isNull(), source)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int"))
    each = sizes.groupBy(source).agg(F.sum(size).alias("source_size")).withColumn("w", pick).withColumn("cap", F.col("source_size") * float(ceiling))
    line = Window.orderBy(F.col("cap") / F.col("w"), F.col(source).isNull(), source).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    earlier = lambda c: F.coalesce(F.sum(c).over(line), F.lit(0.0))
    left = each.withColumns({"left": F.sum("source_size").over(every) - earlier("cap"), "w_left": F.sum("w").over(every) - earlier("w")})
    capped = left.withColumn("capped", F.col("cap") * F.col("w_left") < F.col("w") * F.col("left"))
    level = F.max(F.when(~F.col("capped"), F.col("left") / F.col("w_left"))).over(every)
    return capped.select(source, "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", level * F.col("w"))).alias("target"))


def plan_mixture(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", source: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, ceiling: int = 3, carry: Column | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies) for every document.

    The rate of a source is target / size of the source. A document is taken floor(rate) times, and once more if its
    seeded hash in [0, 1) is below the fraction; never more than ``ceiling`` times. Null text has size 0, a null source is a
    source of its own, documents of a source without words are not taken. The draw follows from the id, so reruns agree
    and repeated rows are drawn alike; an empty table gives an empty result. Targets are laid over one row a source in one
    task. Needed columns only are read; ``carry`` is passed through as _row.
    """
    sized = docs.select(id_col, F.col(source), n_words(F.col(text)).alias("size"), *([] if carry is None else [carry.alias("_row")]))
    sized = materialize(sized) if carry is None else sized  # with wide rows, counting again is cheaper than storing them
    targets = materialize(source_targets(sized, source=source, weights=weights, ceiling=ceiling))
    few = targets.select(F.col(source).alias("_source"), "source_size", "target")
    if few.count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(ceiling)))).otherwise(0.0)
    whole = F.floor(rate)
    copies = (whole + F.when(unit_hash(F.lit(seed), F.col(id_col)) < rate - whole, 1).otherwise(0)).cast("int")
    return sized.join(few, F.col(source).eqNullSafe(F.col("_source"))).drop("_source").withColumn("copies", copies)


def emit_mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as many times as the plan says, all columns kept."""
    planned = plan_mixture(docs, carry=F.struct(*[F.col(f"`{c}`") for c in docs.columns]), **options)
    return planned.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")
