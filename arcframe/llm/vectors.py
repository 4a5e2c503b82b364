"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosine checks in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ._common import map_arrow, materialize
from ._graph import connected_components, group_cuts
from ._words import mix, seeds


def _agree(width: float, distance: float) -> float:
    """Probability that one quantised Gaussian projection agrees for two points at this distance."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def hash_plan(rows: int, threshold: float, *, width: float = 1.2, miss: float = 1e-5) -> tuple[int, int]:
    """(projections a table, tables): random vectors share a bucket of about one row, and a pair at the threshold is
    missed with probability ``miss`` at most, at any number of rows."""
    near, far = _agree(width, math.sqrt(2 - 2 * threshold)), _agree(width, math.sqrt(2))
    per = max(4, math.ceil(math.log(max(rows, 2)) / -math.log(far)))
    return per, math.ceil(math.log(miss) / math.log(1 - near**per))


def near_vectors(rows: DataFrame, *, vec: str = "embedding", id_col: str = "vec_id", label: str = "label", threshold: float = 0.98, width: float = 1.2, miss: float = 1e-5, seed: int = 11, block: int = 1024) -> DataFrame:
    """(id, label, n_links, component_id, kept) for every row.

    Two vectors of one (non-null) label and dimension are linked if their cosine in double precision is at least
    ``threshold``. Unit vectors are hashed by quantised Gaussian projections into several tables; rows in one bucket are
    compared exactly, in blocks of at most ``block`` by ``block``, and a pair is counted in the first table where it meets
    (by 32 bits of each bucket's hash, so that tables' names take little room beside a vector).
    n_links counts all other rows linked directly; component_id is the smallest id reachable; kept: id = component_id.

    Null vectors or labels, zero vectors and those with a null, infinite or NaN component link with nothing. Equal vectors
    are one node with a count. A bucket's pairs are tested but never emitted: a block returns counts and a spanning
    forest of its links. Repeated ids are rows of their own; ids
    may be of any type that has an order. Other columns are not read; an empty table gives an empty result.
    """
    base = materialize(rows.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vec).alias("v")))
    sizes = base.groupBy("label", F.size("v").alias("d")).agg(F.count("*").alias("n"))
    largest = sizes.where("label is not null").agg(F.max("n")).first()[0] or 1
    per, tables = hash_plan(largest, threshold, width=width, miss=miss)
    exact = np.dtype("<f4") if base.schema["v"].dataType.elementType == FloatType() else np.dtype("<f8")  # what a component is sent as

    def hash_rows():
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        odd, salts = seeds(per, 7), seeds(tables, 8)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, lists = batch.column(1).to_pylist(), batch.column(2)
            values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is NaN
            starts = lists.offsets.to_numpy()[:-1]
            lengths = lists.value_lengths().fill_null(0).to_numpy()
            named = np.array([x is not None for x in names], bool)
            out = [[], [], [], [], []]
            for d in np.unique(lengths[lengths > 0]).tolist():
                if d not in planes:
                    draw = np.random.Generator(np.random.PCG64([seed, d]))
                    planes[d] = draw.standard_normal((tables * per, d)).T.copy(), draw.uniform(0, width, tables * per)
                some = np.flatnonzero((lengths == d) & named)
                for first in range(0, len(some), 256):
                    at = some[first : first + 256]
                    raw = values[starts[at][:, None] + np.arange(d)]
                    fine = np.isfinite(raw).all(axis=1) & raw.any(axis=1)
                    at, raw = at[fine], raw[fine]
                    a, b = planes[d]
                    cells = np.floor((unit_rows(raw) @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(at), tables, per)
                    tags = [repr((names[i], d)).encode() for i in at]
                    with np.errstate(over="ignore"):
                        own = np.array([xxhash.xxh3_64_intdigest(x) for x in tags], np.uint64)
                        keys = mix((cells * odd).sum(axis=2, dtype=np.uint64) + salts + own[:, None])
                    same = [xxhash.xxh3_128_intdigest(x.tobytes() + tag) for x, tag in zip(raw + 0.0, tags, strict=True)]
                    out[0].append(at)
                    out[1] += [(x >> 64) - (1 << 63) for x in same]
                    out[2] += [(x & (1 << 64) - 1) - (1 << 63) for x in same]
                    out[3].append(keys.view(np.int64))
                    out[4] += [x.tobytes() for x in raw.astype(exact)]
            at = np.concatenate([np.empty(0, np.int64), *out[0]])
            flat = np.concatenate([np.empty((0, tables), np.int64), *out[3]])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * tables, pa.int32()), pa.array(flat.ravel()))
            marks = [x.tobytes() for x in (flat & 0xFFFFFFFF).astype("<u4")]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), keys, pa.array(marks, pa.binary()), pa.array(out[4], pa.binary())], ["_row", "one", "two", "keys", "marks", "vector"])

        return each

    hashed = map_arrow(base.select("_row", F.col("label").cast("string"), "v"), hash_rows, "_row long, one long, two long, keys array<long>, marks binary, vector binary")
    hashed = materialize(hashed)
    same = ["one", "two"]
    nodes = hashed.groupBy(*same).agg(F.min("_row").alias("node"), F.count("*").alias("m"), F.first("keys").alias("keys"), F.first("marks").alias("marks"), F.first("vector").alias("vector"))
    nodes = materialize(nodes)
    cells = nodes.select("node", F.posexplode("keys").alias("t", "key"))
    many = cells.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    member = cells.join(many, ["t", "key"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # Each member meets every part of its bucket once: block (i, j) with i <= j holds parts i and j.
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = member.select("t", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node")
    member = member.join(nodes.select("node", "m", "marks", "vector"), "node")

    by = ["t", "key", "i", "j"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            cut = group_cuts(table, by)
            if len(cut) > 2:
                yield from _linked(table.slice(0, cut[-2]), cut[:-1], threshold, exact)
            rest = table.slice(cut[-2])
        if rest is not None:
            yield from _linked(rest, group_cuts(rest, by), threshold, exact)

    dealt = member.repartition(*by).sortWithinPartitions(*by)
    tested = materialize(dealt.mapInArrow(blocks, "node long, links long, root long"))
    links = tested.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    found = connected_components(tested.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = nodes.select(*same, "node", "m").join(links, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per_row = hashed.select("_row", *same).join(labelled.select(*same, "component", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), same)
    per_row = materialize(per_row.join(base.select("_row", "id"), "_row"))
    names = per_row.groupBy("component").agg(F.min("id").alias("component_id"))
    verdict = per_row.join(names, "component").select("_row", "n_links", "component_id")
    out = base.select("_row", "id", "label").join(verdict, "_row", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; none is zero."""
    x = raw.astype(np.float64)
    square = np.einsum("ij,ij->i", x, x)
    wild = ~np.isfinite(square) | (square < 1e-280)
    if wild.any():  # very large or small components
        x[wild] /= np.abs(x[wild]).max(axis=1, keepdims=True)
        square[wild] = np.einsum("ij,ij->i", x[wild], x[wild])
    return x / np.sqrt(square)[:, None]


def _linked(table: pa.Table, cuts: list[int], threshold: float, exact: np.dtype) -> Iterator[pa.RecordBatch]:
    node, m, part, i, j, t = (table.column(c).to_numpy() for c in ("node", "m", "part", "i", "j", "t"))
    marks, vectors = table.column("marks").to_pylist(), table.column("vector").to_pylist()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a < 2:
            continue
        here = unit_rows(np.frombuffer(b"".join(vectors[a:b]), exact).reshape(b - a, -1))
        keys = np.frombuffer(b"".join(marks[a:b]), np.uint32).reshape(b - a, -1)
        left = np.arange(b - a) if i[a] == j[a] else np.flatnonzero(part[a:b] == i[a])
        right = left if i[a] == j[a] else np.flatnonzero(part[a:b] == j[a])
        x, y = np.nonzero(here[left] @ here[right].T >= threshold)
        x, y = left[x], right[y]
        if i[a] == j[a]:
            x, y = x[x < y], y[x < y]
        keep = np.empty(len(x), bool)
        for k in range(0, len(x), 1 << 14):  # is this the first table where the two meet?
            keep[k : k + (1 << 14)] = np.argmax(keys[x[k : k + (1 << 14)]] == keys[y[k : k + (1 << 14)]], axis=1) == t[a]
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        links = np.bincount(x, m[a + y], b - a) + np.bincount(y, m[a + x], b - a)
        root = np.arange(b - a)
        while True:
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(links)
        out.append((node[a + some], links[some].astype(np.int64), node[a + root[some]]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "links", "root"])
