"""Connected components and clustering of candidate buckets, all distributed.

Nothing here collects links or labels to the driver, and no step needs all members of a bucket in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import in_arrow, materialize
from ._words import mix

#: Links that one task contracts at a time.
LOCAL_LINKS = 1 << 19


def _ranked(node: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(F.lit(salt), node).alias("p"), node.alias("v"))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, centre) links that connect what the links a-b connect: every node but the centre of each component."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    order = np.argsort(mix(nodes.view(np.uint64)), kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    low = rank.copy()  # least rank known to be reachable
    while True:
        before = low.copy()
        least = np.minimum(low[x], low[y])
        np.minimum.at(low, x, least)
        np.minimum.at(low, y, least)
        low = np.minimum(low, low[order[low]])
        if (low == before).all():
            break
    off = np.flatnonzero(low != rank)
    return nodes[off], nodes[order[low[off]]]


def _contracted(links: DataFrame) -> DataFrame:
    """Links of the same components, each task's share turned into stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= LOCAL_LINKS:
                yield stars(held)
                held, size = [], 0
        if size:
            yield stars(held)

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        a, b = _stars(table.column("a").to_numpy(), table.column("b").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return in_arrow(links, run, "a long, b long")


def connected_components(links: DataFrame) -> DataFrame:
    """(a long, b long) links -> (node, component): the smallest node reachable, for every node with a link.

    Contraction: each task turns its links into stars; then every node points to the neighbour (or itself) of least
    hashed rank, links are relabelled and loops dropped, until none is left; the pointers of all rounds are then
    chained. A random order of ranks contracts chains by a constant factor a round; stars take one or two rounds.
    """
    current = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    layers: list[DataFrame] = []
    while True:
        current = materialize(current)
        if layers and current.isEmpty():
            break
        current = _contracted(current)  # whatever a second run contracts otherwise has the same components
        salt = len(layers)
        both = current.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(current.select("b", "a"))
        least = both.groupBy("node").agg(F.min(_ranked(F.col("other"), salt)).alias("m"))
        layer = materialize(least.select("node", F.least("m", _ranked(F.col("node"), salt))["v"].alias("to")))
        layers.append(layer)
        left, right = layer.select(F.col("node").alias("a"), F.col("to").alias("ta")), layer.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = current.join(left, "a").join(right, "b").where("ta <> tb")
        current = moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
    chained = layers[-1]
    for layer in reversed(layers[:-1]):
        later = chained.select(F.col("node").alias("to"), F.col("to").alias("end"))
        chained = layer.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    if len(layers) > 1:
        chained = materialize(chained)
    names = chained.groupBy("to").agg(F.min("node").alias("component"))
    return materialize(chained.join(names, "to").select("node", "component"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components once further links are there: those links connect old components, which is a small graph."""
    of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias("c" + x))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    ends = materialize(ends)
    if ends.isEmpty():
        return found
    merged = connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    fresh = ends.select(F.col("a").alias("node"), F.col("ca").alias("component")).unionAll(ends.select("b", "cb")).where("node = component").distinct()
    known = found.where("node = component").select("node")
    every = found.unionAll(fresh.join(known, "node", "left_anti").select("node", "component"))
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("now"))
    return materialize(every.join(moved, "component", "left").select("node", F.coalesce("now", "component").alias("component")))


#: A key with this share of the probed rows is dealt over all parts; at most 1 / HOT_SHARE keys have it.
HOT_SHARE = 1 / 4096
#: (key, node) pairs of a part, and parts that one step deals to.
PART_PAIRS, FAN_OUT = 1 << 20, 4096


def parts_for(pairs: float) -> int:
    """In how many parts so many pairs are dealt, a power of two; fine parts are cut out of coarse ones."""
    return 1 << max(8, int(np.ceil(np.log2(max(1.0, pairs / PART_PAIRS)))))


def deal_pairs(key: np.ndarray, node: np.ndarray, hot: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, packed) rows: the pairs of each part, keys before nodes. A pair goes by its key, that of a hot key by its node."""
    part = (mix(np.where(np.isin(key, hot), node, key).view(np.uint64)) & np.uint64(parts - 1)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    key, node, part = key[order], node[order], part[order]
    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1 if part.dtype == np.int64 else part[:1] ^ 1)), len(part)) if len(part) else np.zeros(1, np.int64)
    packed = [key[a:b].tobytes() + node[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int64)), pa.array(packed, pa.binary())], ["part", "packed"])


def _unpacked(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = [np.frombuffer(x, np.int64) for x in held]
    return np.concatenate([x[: len(x) // 2] for x in both]), np.concatenate([x[len(x) // 2 :] for x in both])


def _by_part(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[list[bytes]]:
    """The packed rows of each part in turn, of rows sorted by part; or any rows, of about ``most`` bytes together."""
    held, size, now = [], 0, None
    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (part != now if most is None else size >= most):
                yield held
                held, size = [], 0
            held.append(packed)
            size, now = size + len(packed), part
    if held:
        yield held


def shared_buckets(deal: Callable[[np.ndarray, int], DataFrame], probe: DataFrame, share: float) -> DataFrame:
    """The (key, node) pairs, each once, of keys with several nodes; stored.

    ``probe``: (key, ...) rows of about a ``share`` of all pairs; it tells how many pairs there are and which keys hold a large
    part of them. ``deal``: hot keys and a number of parts -> (part, packed) rows, as ``deal_pairs`` makes them, of
    all pairs. Equal keys meet in one part, each of which is sorted in one task; pairs of hot keys are spread by
    their nodes and all kept, so no task needs all pairs of a key. The probe only decides how pairs are dealt.
    Beyond FAN_OUT parts pairs are dealt twice, first to coarse parts, so that packed rows stay large at any size.
    """
    counted = materialize(probe.groupBy("key").agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(64, int(total * HOT_SHARE))
    hot = np.array(sorted(r[0] for r in counted.where(F.col("n") >= least).select("key").collect()), np.int64)  # a bounded number
    parts = parts_for(total / share)

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_part(batches, 64 << 20):
            yield deal_pairs(*_unpacked(held), hot, parts)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_part(batches):
            key, node = _unpacked(held)
            order = np.argsort(key, kind="stable")
            key, node = key[order], node[order]
            again = key[1:] == key[:-1]
            keep = np.isin(key, hot)
            keep[1:] |= again
            keep[:-1] |= again
            key, node = key[keep], node[keep]  # few are left
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            again = key[1:] == key[:-1]
            keep = np.isin(key, hot)
            keep[1:] |= again
            keep[:-1] |= again
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], ["key", "node"])

    dealt = deal(hot, min(parts, FAN_OUT))
    if parts > FAN_OUT:
        dealt = in_arrow(dealt.repartition("part"), finer, "part long, packed binary")
    return materialize(in_arrow(dealt.repartition("part").sortWithinPartitions("part"), several, "key long, node long"))


def cluster_buckets(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], payload: Callable[[DataFrame], DataFrame], match: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray]], *, few: int = 16, block: int = 1024) -> DataFrame:
    """Components of the links that hold inside buckets.

    ``rows``: (key long, node long), one row for each bucket and member. ``payload``: (node) rows, every member of a bucket
    of several -> (node, ...) what a check needs, for all those; it is called once, before ``verify``: (a, b) pairs -> those
    that are links. ``match``: rows of payload left and right -> indices of the links between them.

    Result: (node, component) for nodes with a link. It equals testing all pairs that share a bucket, yet emits
    few. Every member is held against the first node of one of its buckets, then, where that left them in different
    components, of its other buckets, then, in buckets that still span several components, against the first node of one of
    those. What then still spans several goes on without exception: in buckets of up to ``few`` members as pairs across
    components, in larger ones by blocks, in which the members outside the bucket's largest component meet all others and
    only a spanning forest of the links found comes out.

    Buckets are counted before they are shuffled, and tables by key are joined as stored ones, so that Spark can split
    a bucket that holds a large share of the rows.
    """
    sized = materialize(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1"))
    rows = materialize(rows.join(sized.hint("merge"), "key"))
    held = payload(rows.select("node").distinct())
    tested = materialize(_pairs(rows.where("node <> pivot"), "node", "pivot"))
    one = tested.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = connected_components(verify(one))
    ends = lambda x: found.select(F.col("node").alias(x), F.col("component").alias("c" + x))
    apart = tested.join(ends("a"), "a", "left").join(ends("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    apart = materialize(apart.join(one, ["a", "b"], "left_anti"))
    if not apart.isEmpty():
        found = _joined(found, verify(apart))

    def spanning() -> tuple[DataFrame, DataFrame]:
        comp = F.coalesce("component", "node").alias("comp")
        labelled = rows.select("key", "n", "node").join(found, "node", "left").select("key", "n", "node", comp)
        ends = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        return labelled, materialize(ends.select("key", "hi")).hint("merge")

    labelled, spans = spanning()
    pairs = _pairs(labelled.join(spans, "key").where("comp <> hi"), "node", "hi")  # a component's name is its first node
    fresh = materialize(pairs.join(tested, ["a", "b"], "left_anti"))
    if not fresh.isEmpty():
        found = _joined(found, verify(fresh))
    labelled, spans = spanning()
    open_rows = materialize(labelled.join(spans, "key", "left_semi"))
    one = open_rows.where(F.col("n") <= few)
    other = one.select("key", F.col("node").alias("other"), F.col("comp").alias("other_comp"))
    pairs = _pairs(one.join(other, "key").where("comp < other_comp"), "node", "other")
    fresh = materialize(pairs.join(tested, ["a", "b"], "left_anti").join(fresh, ["a", "b"], "left_anti"))
    links = verify(fresh) if not fresh.isEmpty() else fresh
    large = open_rows.where(F.col("n") > few)
    if not large.isEmpty():
        links = links.unionAll(_block_links(large, held, match, block))
    elif fresh.isEmpty():
        return found
    return _joined(found, links)


def cluster_sieved(rows: DataFrame, payload: Callable[[DataFrame], DataFrame], sieve: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]], verify: Callable[[DataFrame], DataFrame], match: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray]], *, marks: list[str], most: int = 1024, block: int = 8192) -> DataFrame:
    """Components of the links that hold inside buckets, as ``cluster_buckets``, where few bytes tell most pairs apart.

    ``payload``: as there, but its columns ``marks`` are the few bytes. ``sieve``: rows with those columns -> a test of pairs of
    their indices, true for all that can be links. ``verify``: (a, b) pairs -> those that are links. ``match``: rows of payload with
    ``key`` and ``comp``, left and right -> indices of links that connect what all links between them connect.

    All pairs of a bucket are sieved where it is sorted, so what is shuffled are marks of members and pairs that passed. If these
    are many for the bucket's size, each member is paired with the first one only, the links found are merged, and then
    every pair that passes between two components is verified; where these are many still, they are matched in place, by blocks, and
    a forest of the links comes out. Buckets of over ``most`` members start with pairs of members and their first node
    instead, and are then sieved by blocks. No pair between components is left out.
    """
    held = payload(rows.select("node").distinct())
    of = held.select("node", *marks)
    sized = materialize(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where(F.col("n") > most))
    small = rows.join(sized, "key", "left_anti") if (large := not sized.isEmpty()) else rows
    first = materialize(_sieved(small.join(of.hint("merge"), "node").select("key", "node", *marks), sieve))
    pairs = first.where("wide is null").select("a", "b")
    if large:
        rows_of_large = materialize(rows.join(sized, "key"))
        pairs = pairs.unionAll(rows_of_large.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")))
    tested = materialize(pairs.distinct())
    found = connected_components(verify(tested))
    comp = F.coalesce("component", "node").alias("comp")
    wide = small.join(first.where("wide is not null").select(F.col("wide").alias("key")), "key", "left_semi")
    labelled = materialize(wide.join(found, "node", "left").select("key", "node", comp))
    rest = _sieved(labelled.join(marked(of, labelled), "node").select("key", "node", "comp", *marks), sieve, across=True)
    if large:
        labelled = materialize(rows_of_large.join(found, "node", "left").select("key", "node", comp))

        def passing(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            test, n, m = sieve(pa.concat_tables([left, right])), left.num_rows, right.num_rows
            mine, others = left.column("comp").to_numpy(), right.column("comp").to_numpy()
            x, y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            step = max(1, SIEVED // m)
            for a in range(0, n, step):
                i, j = np.nonzero(mine[a : a + step, None] != others)
                ok = test(i + a, j + n)
                x.append(i[ok] + a)
                y.append(j[ok])
                if sum(map(len, x)) > DENSE * (n + m):
                    break
            return np.concatenate(x), np.concatenate(y)

        rest = rest.unionAll(_block_links(labelled, marked(of, labelled), passing, block, whole=True))
    rest = materialize(rest)
    pairs = materialize(rest.where("wide is null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
    links = verify(pairs) if not pairs.isEmpty() else pairs
    wide = rest.where("wide is not null").select(F.col("wide").alias("key"))
    if not wide.isEmpty():
        labelled = materialize(rows.join(wide, "key", "left_semi").join(found, "node", "left").select("key", "node", comp))
        links = links.unionAll(_block_links(labelled, marked(held, labelled), match, 256))
    return _joined(found, links)


#: Bits that tell which rows may be needed, 64 in a row of a broadcast table.
MARKED = 1 << 23


def marked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with a node of ``nodes``, and a few others: by a table of bits of a bounded size, so that the rest isn't shuffled."""
    at = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(MARKED))
    cell, place = F.shiftright(at, 6).alias("_cell"), F.pmod(at, F.lit(64)).cast("int")
    bits = nodes.select(cell, place.alias("_place")).groupBy("_cell").agg(F.expr("bit_or(shiftleft(1L, _place))").alias("_bits"))
    return rows.withColumns({"_cell": cell, "_place": place}).join(F.broadcast(bits), "_cell").where(F.getbit("_bits", "_place") == 1).select(*rows.columns)


#: Pairs that are sieved at a time, and how many that pass, for each of its members, make a bucket wide.
SIEVED, DENSE = 1 << 18, 2


def _sieved(rows: DataFrame, sieve: Callable, across: bool = False) -> DataFrame:
    """(a, b, wide) rows from (key, node, ...) rows: pairs that pass, and as ``wide`` the keys of which not all are there.

    ``across``: only pairs of different ``comp``, and none of a wide key.
    """

    def pairs(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        test, node, key = sieve(table), table.column("node").to_numpy(), table.column("key").to_numpy()
        comp = table.column("comp").to_numpy() if across else None
        begins, sizes = cuts[:-1], np.diff(cuts)
        for n in np.unique(sizes[sizes > 1]):
            groups, (left, right) = begins[sizes == n], np.triu_indices(n, 1)
            step = max(1, SIEVED // len(left))
            for k in range(0, len(groups), step):
                here = groups[k : k + step]
                i, j = (here[:, None] + left).ravel(), (here[:, None] + right).ravel()
                of = np.repeat(np.arange(len(here)), len(left))
                ok = np.flatnonzero(comp[i] != comp[j]) if across else slice(None)
                i, j, of = i[ok], j[ok], of[ok]
                ok = test(i, j)
                i, j, of = i[ok], j[ok], of[ok]
                wide = np.bincount(of, minlength=len(here)) > DENSE * n
                once = ~wide[of]
                if not across:
                    once[np.unique(j, return_index=True)[1]] = True  # pairs come by their left members
                yield _pair_rows(node[i[once]], node[j[once]], key[here[wide]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            cuts = group_cuts(table, ["key"])
            if len(cuts) > 2:
                yield from pairs(table.slice(0, cuts[-2]).combine_chunks(), np.array(cuts[:-1]))
            rest = table.slice(cuts[-2])
        if rest is not None and rest.num_rows:
            yield from pairs(rest.combine_chunks(), np.array([0, rest.num_rows]))

    return in_arrow(rows.repartition("key").sortWithinPartitions("key", "node"), run, "a long, b long, wide long")


def _pair_rows(x: np.ndarray, y: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
    """(a, b, wide) rows: pairs in order, then keys."""
    none = lambda n: pa.nulls(n, pa.int64())
    ends = [pa.concat_arrays([pa.array(end), none(len(wide))]) for end in (np.minimum(x, y), np.maximum(x, y))]
    return pa.RecordBatch.from_arrays([*ends, pa.concat_arrays([none(len(x)), pa.array(wide)])], ["a", "b", "wide"])


def _block_links(members: DataFrame, payload: DataFrame, match: Callable, block: int, *, whole: bool = False) -> DataFrame:
    """Links between components, from (key, node, comp) rows of buckets of any size: a forest of them, or (``whole``) as ``_sieved`` gives them."""
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("all"), F.max(F.struct("k", "comp")).alias("core"))
    cut = lambda n: F.ceil(n / block).cast("int")
    sizes = sizes.select("key", F.col("core.comp").alias("core"), cut(F.col("all")).alias("rights"), cut(F.col("all") - F.col("core.k")).alias("lefts"))
    placed = members.join(sizes, "key")
    part = lambda n: F.pmod(F.xxhash64(F.lit(3), "node"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    right = placed.select("key", upto(F.col("lefts")).alias("i"), part(F.col("rights")).alias("j"), F.lit(1).alias("side"), "node", "comp")
    left = placed.where("comp <> core").select("key", part(F.col("lefts")).alias("i"), upto(F.col("rights")).alias("j"), F.lit(0).alias("side"), "node", "comp")
    by = ["key", "i", "j"]
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said here, or Spark joins them by bytes, of which a block has few for its time
    dealt = right.unionAll(left).join(payload, "node").repartition(tasks, *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            cuts = group_cuts(table, by)
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                yield from linked(table.slice(a, b - a))
            rest = table.slice(cuts[-2])
        if rest is not None and rest.num_rows:
            yield from linked(rest)

    def linked(group: pa.Table) -> Iterator[pa.RecordBatch]:
        side = group.column("side").to_numpy()
        left, right = (group.filter(pa.array(side == k)) for k in (0, 1))
        if not left.num_rows or not right.num_rows:
            return
        x, y = match(left, right)
        keep = left.column("comp").to_numpy()[x] != right.column("comp").to_numpy()[y]
        a, b = left.column("node").to_numpy()[x[keep]], right.column("node").to_numpy()[y[keep]]
        if whole:
            wide = len(a) > DENSE * group.num_rows
            yield _pair_rows(*((a[:0], b[:0]) if wide else (a, b)), group.column("key").to_numpy()[:wide])
        elif len(a):
            a, b = _stars(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return in_arrow(dealt, run, "a long, b long" + ", wide long" * whole)


def group_cuts(table: pa.Table, by: list[str]) -> list[int]:
    """Where groups begin in sorted rows, and the end."""
    new = np.zeros(table.num_rows, bool)
    for c in by:
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return [0, *np.flatnonzero(new).tolist(), table.num_rows]


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
