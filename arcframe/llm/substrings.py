"""Substring dedup with difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._common import materialize
from ._words import join_words, mix, read_words, windows

#: Every difference modulo 7 is one of two members of {0, 1, 3}: of any two places, a shift below 7 moves both onto the cover.
PERIOD, COVER = 7, (0, 1, 3)


class Group:
    """The documents of one group: words, ids, and for each word its document, place and the words from it to the end."""

    def __init__(self, table: pa.Table):
        self.texts = read_words(table.column("text"))
        ids = table.column("id")
        self.known = ids.is_valid().to_numpy()
        self.owner = self.texts.owner
        self.id = ids.fill_null(0).to_numpy()[self.owner]
        n, bounds = len(self.owner), self.texts.bounds
        self.first = bounds[:-1][self.owner]
        self.place = np.arange(n) - self.first
        self.left = np.where(self.known[self.owner], bounds[1:][self.owner] - np.arange(n), 0)

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(words where they start, hashes) of the windows of width - PERIOD + 1 words at cover places."""
        size = width - PERIOD + 1
        at = np.flatnonzero((self.left >= size) & np.isin(self.place % PERIOD, COVER))
        return at, windows(self.texts.hashes, size, salt=1)[at] if len(at) else np.empty(0, np.uint64)

    def candidates(self, shared: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, hash that deals out, hash that compares) of the windows around shared anchors."""
        at, found = self.anchors(width)
        at = at[_held(shared, _anchor_keys(found, buckets))]
        edge = np.zeros(len(self.owner) + 1, np.int64)
        np.add.at(edge, np.maximum(at - PERIOD + 1, self.first[at]), 1)
        np.add.at(edge, at + 1, -1)
        starts = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & (self.left >= width))
        if not len(starts):
            return starts, np.empty(0, np.uint64), np.empty(0, np.uint64)
        return starts, windows(self.texts.hashes, width, salt=2)[starts], windows(mix(self.texts.hashes), width, salt=3)[starts]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _anchor_keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket and 31 further bits; a bucket has about a million anchors at any size of the corpus."""
    return _bucket(h, buckets) << np.uint64(32) | (h & np.uint64(0xFFFFFFFE))


def _held(sorted_set: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _spans(values: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal neighbours."""
    cuts = np.flatnonzero(np.diff(values)) + 1 if len(values) else np.empty(0, np.int64)
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True)) if len(values) else []


def _first(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)


def _runs(values: np.ndarray) -> np.ndarray:
    """The number of its run for each of sorted values."""
    return np.cumsum(np.concatenate(([False], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)


def _packed(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _owners(table: pa.Table, item: int) -> np.ndarray:
    return np.repeat(np.arange(table.num_rows), [len(x) // item for x in table.column("c0").to_pylist()])


def _returned(table: pa.Table, owner: np.ndarray, values: np.ndarray, bucket: int) -> pa.Table:
    """Rows (g, bucket, packed values), one for each row of ``table`` that gets something back."""
    order = np.argsort(owner, kind="stable")
    spans = _spans(owner[order])
    who = table.column("g").take(pa.array([int(owner[order[a]]) for a, _ in spans], pa.int64()))
    return pa.table({"g": who, "bucket": pa.array([bucket] * len(spans), pa.int64()), "c0": pa.array([values[order[a:b]].tobytes() for a, b in spans], pa.binary())})


def drop_repeated_passages(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", width: int = 13, group_bytes: int = 4 << 20) -> DataFrame:
    """(id, text, n_words, n_removed): each whole text without words of passages that documents of smaller id hold too.

    A word goes if a window of ``width`` words over it also starts in a document with a smaller id (all judged on the
    input). The kept words are joined by one blank. ``width`` must be over 7.

    Anchors are windows of width - 6 words, hashed only at places of a difference cover modulo 7. Two equal windows of
    ``width`` words share an aligned anchor, so only anchors that two documents hold lead on: matches extend from them to
    the windows of ``width`` words around them, which are compared by 64-bit hashes. Documents meet in groups of about
    ``group_bytes`` (beyond 32 GiB more, by the root of the input, up to 16 times that), and a group sends each hash once, so a passage in a third of all documents is no hot key.

    Ids are integers. Null or empty text has no words (text is then returned as it is); the texts of a group are held whole
    in a task; rows of one id are one document (they do not
    remove each other's words); rows of null id neither remove nor lose words; an empty table gives an empty result;
    other columns are not read.
    """
    if width <= PERIOD:
        raise ValueError("width must be over 7")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of an integer type: ids are sent as 64-bit numbers")
    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # With every group sending to every bucket, both must grow with the root of the input for messages to stay large.
    group_bytes = int(group_bytes * min(16.0, max(1.0, (total / (32 << 30)) ** 0.5)))
    groups, buckets = max(16, total // group_bytes), max(16, total // (4 * group_bytes))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(groups)))

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        group = Group(table)
        at, h = group.anchors(width)
        order = np.argsort(_anchor_keys(h, buckets))
        keys, ids = _anchor_keys(h, buckets)[order], group.id[at][order]
        first = _first(keys)
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.empty(0, bool)
        keys = keys[first] | several.astype(np.uint64)  # the free lowest bit: two documents of this group have it
        bucket = keys >> np.uint64(32)
        spans = _spans(bucket)
        return pa.table({"bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), "g": pa.array([key[0].as_py()] * len(spans), pa.int64()), "c0": pa.array([keys[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary())})

    def shared_anchors(key: tuple, table: pa.Table) -> pa.Table:
        h, owner = _packed(table, "c0", np.uint32), _owners(table, 4)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        run = _runs(h & np.uint32(0xFFFFFFFE))
        several = (np.bincount(run) > 1) | (np.bincount(run, weights=h & 1) > 0)
        keep = several[run]
        return _returned(table, owner[keep], h[keep] & np.uint32(0xFFFFFFFE), key[0].as_py())

    def anchors_of(replies: pa.Table) -> np.ndarray:
        h = _packed(replies, "c0", np.uint32).astype(np.uint64)
        bucket = np.repeat(replies.column("bucket").to_numpy(), [len(x) // 4 for x in replies.column("c0").to_pylist()]) if replies.num_rows else np.empty(0)
        return np.sort(bucket.astype(np.uint64) << np.uint64(32) | h)

    def send_windows(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        group = Group(table)
        starts, deal, h = group.candidates(anchors_of(replies), width, buckets)
        order = np.argsort(h)
        first = _first(h[order])
        ids = np.minimum.reduceat(group.id[starts][order], first) if len(first) else np.empty(0, np.int64)
        h, bucket = h[order][first], _bucket(deal[order][first], buckets)
        order = np.lexsort((ids, bucket))
        h, bucket, ids = h[order], bucket[order], ids[order]
        spans = _spans(bucket)
        each = [_first(ids[a:b]) for a, b in spans]  # ids in runs take little room
        return pa.table({
            "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), "g": pa.array([key[0].as_py()] * len(spans), pa.int64()),
            "c0": pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), "c1": pa.array([ids[a:b][f].tobytes() for (a, b), f in zip(spans, each, strict=True)], pa.binary()),
            "c2": pa.array([np.diff(np.append(f, b - a)).astype("<i4").tobytes() for (a, b), f in zip(spans, each, strict=True)], pa.binary()),
        })

    def later_windows(key: tuple, table: pa.Table) -> pa.Table:
        h, owner = _packed(table, "c0", np.uint64), _owners(table, 8)
        ids = np.repeat(_packed(table, "c1", np.int64), _packed(table, "c2", np.int32))
        order = np.argsort(h, kind="stable")
        h, owner, ids = h[order], owner[order], ids[order]
        late = ids > np.minimum.reduceat(ids, _first(h))[_runs(h)]
        return _returned(table, owner[late], h[late], key[0].as_py())

    def apply(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        group = Group(table)
        windows_too = replies.column("kind").to_numpy() == 1 if replies.num_rows else np.empty(0, bool)
        late = np.sort(_packed(replies.filter(pa.array(windows_too)), "c0", np.uint64))
        starts, _, h = group.candidates(anchors_of(replies.filter(pa.array(~windows_too))), width, buckets)
        order = np.argsort(h)
        gone = np.zeros(len(h), bool)
        if len(h):  # a smaller id in this group, or, by a reply, in another
            ids, run = group.id[starts][order], _runs(h[order])
            gone[order] = (ids > np.minimum.reduceat(ids, _first(h[order]))[run]) | _held(late, h[order])
        edge = np.zeros(len(group.owner) + 1, np.int64)
        np.add.at(edge, starts[gone], 1)
        np.add.at(edge, starts[gone] + width, -1)
        keep = np.cumsum(edge)[:-1] == 0
        bounds = group.texts.bounds
        counts = np.diff(bounds)
        left = np.diff(np.concatenate(([0], np.cumsum(keep)))[bounds])
        return pa.table({"id": table.column("id"), "text": join_words(group.texts, keep), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(counts - left, pa.int64())})

    reply = "g long, bucket long, c0 binary"
    anchors = rows.groupBy("g").applyInArrow(send_anchors, "bucket long, g long, c0 binary")
    shared = materialize(anchors.groupBy("bucket").applyInArrow(shared_anchors, reply))
    del anchors
    sent = rows.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(send_windows, "bucket long, g long, c0 binary, c1 binary, c2 binary")
    later = materialize(sent.groupBy("bucket").applyInArrow(later_windows, reply))
    del sent
    replies = shared.withColumn("kind", F.lit(0)).unionAll(later.withColumn("kind", F.lit(1)))
    out = rows.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(apply, "id long, text string, n_words long, n_removed long")
    return out.select(F.col("id").cast(id_kind).alias(id_col), F.col("text").alias(text), "n_words", "n_removed")
