"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, materialize
from ._graph import cluster_buckets
from ._words import mix, read_words, windows

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: hashes of its runs of ``width`` words, and how often each occurs.

    Fewer words are one run, no word is none.
    """
    for a in range(0, len(column), 512):
        texts = read_words(column.slice(a, 512))
        for first, last in zip(texts.bounds[:-1].tolist(), texts.bounds[1:].tolist(), strict=True):
            hashes = texts.hashes[first:last]
            yield np.unique(windows(hashes, min(width, len(hashes))) if len(hashes) else hashes, return_counts=True)


def dart_signature(elements: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """DartMinHash of a weighted set: ``k`` values; two sets agree in each with the probability of their weighted Jaccard.

    Each element owns a strip as wide as its weight and open to the right. Darts fall on the strips with density
    one, at places that follow from the element alone: along unit layers of the strip, the gaps between the ranks of
    successive darts are exponential, hashed from element, layer and number. A dart also draws its place across
    the layer (a layer that is cut by the weight keeps the darts inside) and one of the ``k`` coordinates; each
    coordinate keeps its earliest dart. About k (ln k + 3) darts over the whole set leave few coordinates empty; then
    ranks twice as far are thrown. Time follows elements plus darts, not their product.
    """
    with np.errstate(over="ignore"):
        if weights is None:
            seeds, width = mix(elements), None
            total = float(len(elements))
        else:
            layers = np.ceil(weights).astype(np.int64)
            layer = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
            seeds = mix(np.repeat(elements, layers) + layer.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            width = np.repeat(weights, layers) - layer
            total = float(weights.sum())
        reach = k * (np.log(k) + 3) / total
        while True:
            ranks, darts = _darts(seeds, width, reach)
            out = np.zeros(k, np.uint64)
            hit = np.zeros(k, bool)
            at = (mix(darts) % np.uint64(k)).astype(np.int64)
            late_first = np.argsort(-ranks, kind="stable")
            out[at[late_first]] = darts[late_first]  # the earliest dart is written last
            hit[at] = True
            if hit.all():
                return out
            reach *= 2


def _darts(seeds: np.ndarray, width: np.ndarray | None, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(rank, dart) of all darts of rank up to ``reach`` inside the strips."""
    ranks, darts, first = [], [], 0
    rank = np.zeros(len(seeds))
    while len(seeds):
        many = max(1, min(int(reach * 1.2) + 4, 4096 // len(seeds)))  # darts of one element thrown at once
        number = np.arange(first + 1, first + many + 1, dtype=np.uint64) * _STEP
        h = mix(seeds[:, None] + number[None, :])
        r = rank[:, None] + np.cumsum(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1)
        inside = r <= reach
        go_on = inside[:, -1]
        if width is not None:
            inside &= (mix(h ^ _STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < width[:, None]
        ranks.append(r[inside])
        darts.append(h[inside])
        rank, seeds, width = r[go_on, -1], seeds[go_on], None if width is None else width[go_on]
        first += many
    return np.concatenate(ranks), np.concatenate(darts)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One key for each band of the signature; keys of different bands differ."""
    rows = signature.reshape(bands, -1)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
        for c in range(rows.shape[1]):
            key = mix(key + rows[:, c])
    return key.view(np.int64)


def near_duplicates(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", width: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 5, weights: str = "set") -> DataFrame:
    """``docs`` with class_id, kept and n_shingles, one row for each row.

    Two documents are linked if the Jaccard similarity of their sets of runs of ``width`` words is at least ``threshold``
    (found if a band of the signature agrees, at 0.8 with probability 0.99993; then checked exactly). Classes are the
    connected components; class_id is the smallest id in the class, and the first row in order of id is kept.
    ``weights="count"`` weighs runs by how often they occur, in signatures and in the check; "set" weighs all alike.

    Texts of fewer words are one run; documents without words and null text link with nothing. Null ids
    come last in a class. Rows with equal run sets are one node, so copies are never paired; of other rows only members and
    pivots of a bucket are paired (see ``cluster_buckets``). Columns pass through; class_id, kept and n_shingles
    are replaced if there; an empty table gives an empty result.
    """
    spark, counted = docs.sparkSession, weights == "count"
    stored = materialize(docs.drop("class_id", "kept", "n_shingles").withColumn("_row", F.monotonically_increasing_id()))

    def sketch():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, one, two, keys = [], [], [], []
            for found, count in shingle_sets(batch.column(1), width):
                n.append(len(found))
                with np.errstate(over="ignore"):
                    own = mix(found + count.astype(np.uint64)) if counted else found
                    one.append(int(own.sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(mix(own ^ _STEP).sum(dtype=np.uint64).view(np.int64)))
                keys.append(band_keys(dart_signature(found, count.astype(float) if counted else None, bands * rows), bands) if len(found) else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in keys]))), pa.int32()), pa.array(np.concatenate(keys)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists], ["_row", "n", "one", "two", "keys"])

        return each

    def runs():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = list(shingle_sets(batch.column(1), width))
            # Counted runs become sets of (run, 1), (run, 2), ...: their Jaccard is the weighted one.
            sets = [mix(np.repeat(e, c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64) * _STEP) if counted else e for e, c in found]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "runs"])

        return each

    sketches = materialize(map_arrow(stored.select("_row", F.col(text).alias("t")), sketch, "_row long, n long, one long, two long, keys array<long>"))
    ids = stored.select("_row", F.col(id_col).alias("_id"))
    same = ["one", "two", "n"]
    order = lambda i, r: F.struct(F.col(i).isNull().alias("none"), F.col(i).alias("id"), F.col(r).alias("row"))
    nodes = sketches.where("n > 0").join(ids, "_row").groupBy(*same).agg(F.min(order("_id", "_row")).alias("head"), F.first("keys").alias("keys"))
    nodes = materialize(nodes.withColumn("node", F.col("head.row")))
    sets: list[DataFrame] = []

    def payload(members: DataFrame) -> DataFrame:
        needed = members.select(F.col("node").alias("_row")).hint("merge")
        texts = stored.select("_row", F.col(text).alias("t")).join(needed, "_row", "left_semi")
        sets.append(materialize(map_arrow(texts, runs, "node long, runs array<long>")))
        return sets[0]

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (sets[0].select(F.col("node").alias(x), F.col("runs").alias(f"s{x}")).hint("merge") for x in "ab")  # the same plan at any size
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(a, "a").join(b, "b").where(both >= F.lit(threshold) * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")

    def match(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard of all left with all right, by products of 0/1 rows over the runs, a slab of runs at a time."""
        parts = [t.column("runs").combine_chunks() for t in (left, right)]
        sizes = [p.value_lengths().to_numpy() for p in parts]
        _, ids = np.unique(np.concatenate([p.flatten().to_numpy() for p in parts]), return_inverse=True)
        split = np.split(ids, [int(sizes[0].sum())])
        owners = [np.repeat(np.arange(len(n)), n) for n in sizes]
        both = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
        for a in range(0, int(ids.max(initial=-1)) + 1, 4096):
            slabs = []
            for n, i, owner in zip(sizes, split, owners, strict=True):
                here = (i >= a) & (i < a + 4096)
                slab = np.zeros((len(n), 4096), np.float32)
                slab[owner[here], i[here] - a] = 1
                slabs.append(slab)
            both += slabs[0] @ slabs[1].T
        union = sizes[0][:, None] + sizes[1][None, :] - both
        return np.nonzero(both >= threshold * union - 1e-6)

    found = cluster_buckets(nodes.select(F.explode("keys").alias("key"), "node"), verify, payload, match)
    labelled = nodes.select(*same, "head", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = labelled.groupBy("component").agg(F.min("head").alias("first"))
    labelled = labelled.join(first, "component").select(*same, F.col("first.id").alias("class_id"), F.col("first.row").alias("_keeper"))
    verdict = sketches.select("_row", *same).join(labelled, same, "left")
    verdict = verdict.select("_row", "class_id", F.coalesce(F.col("_keeper") == F.col("_row"), F.lit(True)).alias("kept"), F.col("n").alias("n_shingles"), F.col("_keeper").isNull().alias("_alone"))
    out = stored.join(materialize(verdict).hint("merge"), "_row")  # the same plan at any size
    return out.withColumn("class_id", F.when(F.col("_alone"), F.col(id_col)).otherwise(F.col("class_id"))).drop("_row", "_alone")
