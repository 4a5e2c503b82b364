"""Quality rules with cross-document line frequency, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD_SPACE, materialize

_SYMBOLS = "#*$%&|<>"


def normal_line(line: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends; empty if the line has no word."""
    return F.trim(F.regexp_replace(F.lower(F.translate(line, WORD_SPACE, " " * len(WORD_SPACE))), " +", " "))


def word_runs(hashes: Column, width: int) -> Column:
    """A hash of each run of ``width`` consecutive words, in order, given an array of word hashes."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(hashes, i, width)))
    return F.when(n >= width, runs).otherwise(F.array().cast("array<bigint>"))


def repeated_words(runs: Column, width: int) -> Column:
    """How many words lie in runs that occur at least twice.

    Equal runs are neighbours once (hash, place) is sorted; their places, sorted, cover ``width`` words each, up to the next place.
    """
    ordered = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(p: Column) -> Column:
        last = F.size(p) - 1
        same = lambda x, k: F.get(p, k)["h"] == x["h"]
        twice = F.filter(p, lambda x, k: ((k > 0) & same(x, k - 1)) | ((k < last) & same(x, k + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def spans(q: Column) -> Column:
        last = F.size(q) - 1
        each = F.transform(q, lambda x, k: F.when(k == last, width).otherwise(F.least(F.lit(width), F.get(q, k + 1) - x)))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    # A one-element array binds a value to a name, so that it is computed once.
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return bound(ordered, lambda p: bound(places(p), spans))


def quality_table(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", host: str = "source", max_docs: int = 20, min_kept: float = 0.5, min_words: int = 20, repeat_width: int = 8) -> DataFrame:
    """Counts and the verdict for every document; one row for each row of ``docs``.

    A line (split at line feeds, normalised) is boilerplate of its host if more than ``max_docs`` documents of that host
    hold it; rows of one id are one document there, rows of null id documents of their own. Such lines go; a document that keeps less than ``min_kept`` of its words is depleted and not kept.
    ``base_failed``: under ``min_words`` words, or over 30 % of them in repeated runs. Null or empty text has no words and
    fails; null is a host of its own. A text's words and lines are arrays of one row (some 20 bytes a word), so a task needs room for
    its longest text. All lines of all documents are counted;
    a line or host that a third of all rows share is counted before it is shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.col("_t"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.length(F.translate(x, WORD_SPACE, "")) > 0)
    step = docs.select(F.col(id_col), F.col(host).alias("_host"), t.alias("_t"))
    step = step.select(
        id_col, "_host",
        F.length(F.translate("_t", WORD_SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("_words"), lines.alias("_lines"),
    )
    step = step.select(
        id_col, "_host", "word_chars", "n_symbols", F.size("_words").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        word_runs(F.col("_words"), repeat_width).alias("_runs"), F.transform("_lines", normal_line).alias("_lines"),
    )
    n_repeat = F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), repeated_words(F.col("_runs"), repeat_width)).otherwise(0)
    blanks = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")
    base = materialize(step.select(
        id_col, "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", n_repeat.cast("long").alias("n_repeat_words"),
        F.transform("_lines", lambda x: F.struct(F.xxhash64(x).alias("h"), blanks(x))).alias("_lines"),
        F.monotonically_increasing_id().alias("_row"),  # fixed from here on, as the table is stored
    ))
    lone = F.when(F.col(id_col).isNull(), F.col("_row")).alias("_lone")
    lines = base.select("_row", F.col(id_col).alias("_id"), lone, "_host", F.explode("_lines").alias("x")).select("_row", "_id", "_lone", "_host", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    each = lines.repartition("_host", "h", "_id", "_lone").groupBy("_host", "h", "_id", "_lone", "_row").agg(F.sum("n").alias("words"), F.count("*").alias("lines"))
    common = each.groupBy("_host", "h", "_id", "_lone").agg(F.lit(1).alias("one")).groupBy("_host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs)
    common = common.select(F.col("_host").alias("_h"), F.col("h").alias("_l"))
    hit = each.join(common, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("h") == F.col("_l")), "left_semi")
    gone = hit.groupBy("_row").agg(F.sum("words").alias("gone_words"), F.sum("lines").alias("gone_lines"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    removed = F.coalesce("gone_words", F.lit(0)).cast("long")
    return base.drop("_lines").join(gone, "_row", "left").select(
        id_col, F.col("_host").alias(host), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("n_words") - removed >= F.col("n_words") * min_kept)).alias("kept"),
        F.coalesce("gone_lines", F.lit(0)).cast("long").alias("n_removed_lines"), removed.alias("n_removed_words"),
    )
