"""Best-fit packing with Martello-Toth dominance reduction, on the histogram of lengths."""

from __future__ import annotations

import bisect
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import by_bytes, map_arrow, materialize, texts_of, unused
from ._pieces import WORD_LEVEL, PieceTokens, load_tokenizer, pieces_of


@functools.lru_cache(1)
def piece_ids(tokenizer_path: str) -> PieceTokens:
    """Pieces as little-endian unsigned 32-bit ids; a Python worker keeps the tokenizer and the table from one task to the next."""
    return PieceTokens(load_tokenizer(tokenizer_path), np.ndarray.tobytes, limit=1 << 18)


def encode_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, text: str = "text", id_col: str = "doc_id", with_ids: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """Token ids of every whole text, cut into pieces of at most ``capacity``.

    (id, piece int, start long, length long, ids_crc32 long[, ids binary]): ids are little-endian unsigned 32-bit,
    each text's end with ``end_id``; only texts longer than ``capacity`` have more than one piece, and only their last
    piece may be shorter. Null and empty texts give the one id ``end_id``. Repeated rows each give their pieces.
    """
    end = int(end_id).to_bytes(4, "little")

    def make():
        known = piece_ids(tokenizer_path)
        step = 4 * capacity

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, "text")
            rows, piece, start, cut = [], [], [], []
            for a, b in by_bytes([len(x) for x in texts], batch_bytes):
                split = [pieces_of(x, WORD_LEVEL, known.special) for x in texts[a:b]]
                if b - a > 1:
                    known.learn(set().union(*split))
                for row, pieces in enumerate(split, a):
                    ids = []
                    for i in range(0, len(pieces), 1 << 18):
                        if b - a == 1:
                            known.learn(pieces[i : i + (1 << 18)])
                        ids += map(known.__getitem__, pieces[i : i + (1 << 18)])
                    ids.append(end)
                    whole = b"".join(ids)
                    for k in range(0, len(whole), step):
                        rows.append(row)
                        piece.append(k // step)
                        start.append(k // 4)
                        cut.append(whole[k : k + step])
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in cut], pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
            return pa.RecordBatch.from_arrays(out + [pa.array(cut, pa.binary())] * with_ids, ["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), make, schema).withColumnRenamed("id", id_col)


def _fixed_set(lengths: list[int], counts: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """A set with the largest item that provably dominates every other set with it, or None.

    ``lengths``: ascending lengths with items left. The tests are Martello and Toth's for sets of up to three items.
    """
    j = lengths[-1]
    left = capacity - j

    def smallest(n: int) -> int | None:
        """Sum of the n smallest items beside one j, None if there are fewer."""
        total = 0
        for x in lengths:
            here = min(n, counts[x] - (x == j))
            total, n = total + here * x, n - here
            if not n:
                return total
        return None

    def largest(room: int, taken: tuple[int, ...]) -> int | None:
        k = bisect.bisect_right(lengths, room) - 1
        while k >= 0 and counts[lengths[k]] <= taken.count(lengths[k]):
            k -= 1
        return lengths[k] if k >= 0 else None

    one = largest(left, (j,))
    if one is None:
        return (j,)
    two = smallest(2)
    if one == left or two is None or two > left:
        return (j, one)  # one item fills the bin, or no bin with j holds a further pair
    three = smallest(3)
    if three is not None and three <= left:
        return None
    pair = largest(left - one, (j, one))  # beside j and its largest partner
    over, sums = 0, []  # the two smallest items above that partner: do they fit beside j?
    for x in lengths[bisect.bisect_right(lengths, -1 if pair is None else pair) :]:
        sums += [x] * min(2 - len(sums), counts[x] - (x == j))
        if len(sums) == 2:
            over = sum(sums)
            break
    if len(sums) == 2 and over <= left:
        return None  # a pair whose smaller item is above: neither set maps into the other
    return (j, one) if pair is None else (j, one, pair)


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[str, int]]:
    """Bins for a histogram {length: count}: [(lengths of a bin, how many such bins)], and figures.

    First dominance reduction from the largest length down: while some set with the largest item dominates, it is fixed
    as often as its items last (taking items away never breaks a rule's premise) and leaves the instance. What no rule settles is packed best fit, longest first, a
    whole run of equal bins and equal items at a time. Time and memory follow the number of different lengths, not of items.
    """
    counts = {n: c for n, c in histogram.items() if c}
    if any(n < 0 or n > capacity for n in counts):
        raise ValueError(f"a length is outside 0..{capacity}")
    lengths, bins, rest = sorted(counts), [], {}
    fixed = 0
    while lengths:
        j = lengths[-1]
        found = _fixed_set(lengths, counts, capacity)
        if found is None:  # no rule holds for j now: leave all of this length to best fit
            rest[j] = counts.pop(j)
            lengths.pop()
            continue
        need = {x: found.count(x) for x in found}
        times = min(counts[x] // n for x, n in need.items())
        bins.append((found, times))
        fixed += times
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                lengths.remove(x)
    open_bins: list[tuple[int, tuple[int, ...], int]] = []  # (room left, lengths, how many), by room
    for j in sorted(rest, reverse=True):
        left = rest[j]
        while left:
            k = bisect.bisect_left(open_bins, (j,))
            if k == len(open_bins):
                each = capacity // j if j else left
                for per in (each, left % each) if left >= each else (left,):
                    if per:
                        n = left // per if per == each else 1
                        bisect.insort(open_bins, (capacity - j * per, (j,) * per, n))
                        left -= n * per
                break
            room, held, n = open_bins.pop(k)
            used = min(n, left)
            bisect.insort(open_bins, (room - j, (*held, j), used))
            if n > used:
                bisect.insort(open_bins, (room, held, n - used))
            left -= used
    bins += [(held, n) for _, held, n in open_bins]
    total = sum(n for _, n in bins)
    return bins, {"bins": total, "fixed": fixed, "lower_bound": -(-sum(n * c for n, c in histogram.items()) // capacity)}


def pack(items: DataFrame, *, length: str = "length", order: list[str], capacity: int = 2048, buckets: int | None = None) -> DataFrame:
    """``items`` with sequence_id and offset: its place in one of as few sequences of ``capacity`` as the plan finds.

    Lengths must be 0..capacity and not null. Only the histogram of lengths (at most capacity + 1 rows) reaches the driver; what
    each task gets of the plan is bounded by the number of different lengths too. Items are numbered within
    their length by ``order`` (ties: any order, the lengths are equal), in hashed buckets so that a length that holds a third of all
    items is dealt over many tasks. Extra columns pass through (sequence_id and offset are replaced); an empty table gives an
    empty result.
    """
    items = materialize(items.drop("sequence_id", "offset"))
    in_bucket, n_before, n_here, rank_name = unused(items, "_bucket", "_before", "_n", "_rank")
    histogram = {r[0]: r[1] for r in items.groupBy(length).count().collect()}
    bins, _ = plan_bins(histogram, capacity)
    total = sum(histogram.values())
    buckets = buckets or int(min(1 << 16, max(64, total // 200_000)))
    # For each length: consecutive runs of ranks, each one place in equal bins: (first rank, first bin, offset).
    runs: dict[int, list[tuple[int, int, int]]] = {}
    first, used = 0, dict.fromkeys(histogram, 0)
    for held, n in bins:
        at = 0
        for x in held:
            runs.setdefault(x, []).append((used[x], first, at))
            used[x] += n
            at += x
        first += n
    table = {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}
    dealt = items.withColumn(in_bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(length, in_bucket).agg(F.count("*").alias(n_here))
    before = F.sum(n_here).over(Window.partitionBy(length).orderBy(in_bucket).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(length, in_bucket, F.coalesce(before, F.lit(0)).alias(n_before))
    rank = F.row_number().over(Window.partitionBy(length, in_bucket).orderBy(*order))
    ranked = dealt.withColumn(rank_name, rank).join(sizes, [length, in_bucket]).withColumn(rank_name, F.col(rank_name) + F.col(n_before) - 1)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            sizes, ranks = get(length), get(rank_name)
            seq, off = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for x in np.unique(sizes):
                here = np.flatnonzero(sizes == x)
                start, bin_, at = table[int(x)]
                k = np.searchsorted(start, ranks[here], "right") - 1
                seq[here], off[here] = bin_[k] + ranks[here] - start[k], at[k]
            keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != rank_name]
            return pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], [*[n for n in batch.schema.names if n != rank_name], "sequence_id", "offset"])

        return each

    names = [f.name for f in items.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"
    return map_arrow(ranked.select(*[F.col(f"`{n}`") for n in names], rank_name), make, schema)
