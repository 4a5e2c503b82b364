"""Fuzzy line dedup: SimHash blocks and MinHash bands of words, edit similarity, one occurrence of each connected group."""

from __future__ import annotations

import bisect
import itertools
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_bytes, in_arrow, map_arrow, materialize, unused
from ._graph import cluster_sieved, deal_pairs, marked, shared_buckets
from ._words import Texts, join_words, mix, read_words, seeds

#: 64-bit numbers of a SimHash, and bits of its pigeonhole blocks.
PARTS, BLOCK = 2, 32

#: MinHash bands of a line and words of each; those of lines of less than SHORT words in addition.
BANDS, ROWS, SHORT, MORE_BANDS, MORE_ROWS = 16, 4, 10, 48, 3

#: Lines of SHORT words or more have a sketch, a byte for each MinHash coordinate. Two are compared only if this share of
#: them agrees, or, if both have LONG words, the larger one.
AGREE, LONG, LONG_AGREE = 0.3, 64, 0.45

#: Words that are laid side by side at a time, or one line's, bits of their hashes that count, and products made of them at a time.
LAID_WORDS, HASHED, PRODUCTS = 1 << 16, 40, 1 << 16

#: Lines of less words than this carry counts of their characters, so many.
COUNTED, COUNTS = 20, 96

#: Of so many documents one is probed for keys that many lines have.
PROBE = 64

#: Keys that a task deals at a time, and pairs that it sieves at a time.
DEALT, SIEVE_STEP = 1 << 20, 1 << 15

#: From so many pairs on distances are found side by side.
SIDE_BY_SIDE = 20

#: So many pairs of a bucket are compared together, if no row has more.
TOGETHER = 1024

#: Weight of a word, as a power of two, by its bytes: the shortest words are the most common ones.
_WEIGHT = np.array([0, 0, 1, 2, 3], np.uint64)

#: All but the top bit of each byte.
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)


def normalized(column: pa.Array) -> pa.Array:
    """Texts in lower case (the simple mapping of Unicode), null as empty; words and lines keep their order."""
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def edit_distance(a: str, b: str, most: float | None = None) -> int:
    """Levenshtein distance, bit-parallel over arbitrarily long strings; if it is over ``most``, some number over that."""
    if len(a) > len(b):
        a, b = b, a
    n = 0
    while n < len(a) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    n = len(a)
    while n and a[n - 1] == b[n - 1 - len(a) + len(b)]:
        n -= 1
    b = b[: len(b) - len(a) + n]
    a = a[:n]
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    most = len(a) + len(b) if most is None else most
    every = 64 if len(a) <= 1024 else 256
    for left, c in zip(range(len(b), 0, -1), b):
        if distance - left > most:  # it falls by one a character at most
            return distance - left
        if left % every == 0 and left < len(b) and len(a) > 64 and _least(up, down, len(a), len(b) - left, left) > most:
            return int(most) + 1
        equal = where.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rise = down | (full & ~(horizontal | up))
        fall = up & horizontal
        distance += 1 if rise & top else -1 if fall & top else 0
        rise = (rise << 1 | 1) & full
        up = ((fall << 1) & full) | (full & ~(vertical | rise))
        down = rise & vertical
    return distance


def _least(up: int, down: int, rows: int, read: int, left: int) -> int:
    """What a distance is at least, by the bit vectors after some characters: each row's own and what lengths add to it."""
    bits = [np.unpackbits(np.frombuffer(x.to_bytes(-(-rows // 8), "little"), np.uint8), count=rows, bitorder="little").view(np.int8) for x in (up, down)]
    low = np.append(0, np.cumsum(bits[0] - bits[1], dtype=np.int64)) + read
    return int((low + np.abs(np.arange(rows, -1, -1) - left)).min())


def anchored_distance(a: str, b: str, most: float | None = None, *, exact: bool = True) -> int | None:
    """A number that the Levenshtein distance doesn't exceed: words that both have once, as far as they come in one order,
    stay, and what lies between is compared piece by piece, but only if to replace it whole takes over ``most``. None if little would be
    saved, or if it is over ``most`` (or so much lies between that it hardly can be less); without ``exact`` pieces are not compared."""
    sides = [x.split(" ") for x in (a, b)]
    counts = [Counter(x) for x in sides]
    if most is not None:  # what lies between at least: a word that stays takes two blanks with it at most
        common = counts[0].keys() & counts[1].keys()
        if max(len(a), len(b)) - sum(map(len, common)) - 2 * len(common) > most * (1 + exact):
            return None
    where = {w: k for k, w in enumerate(sides[1]) if counts[1][w] == 1}
    pairs = [(k, where[w]) for k, w in enumerate(sides[0]) if w in where and counts[0][w] == 1]
    rises = [j for _, j in pairs]
    if rises != sorted(rises):
        tails: list[int] = []  # the last place in b of the best run of each length, and what came before each pair
        ends, before = [], []
        for n, j in enumerate(rises):
            at = bisect.bisect_left(tails, j)
            tails[at : at + 1], ends[at : at + 1] = [j], [n]
            before.append(ends[at - 1] if at else -1)
        kept, n = [], ends[-1]
        while n >= 0:
            kept.append(pairs[n])
            n = before[n]
        pairs = kept[::-1]
    gaps, i, j = [], 0, 0
    for k, m in [*pairs, (len(sides[0]), len(sides[1]))]:
        if i < k or j < m:
            gaps.append((" ".join(sides[0][i:k]), " ".join(sides[1][j:m])))
        i, j = k + 1, m + 1
    gaps = [(x, y) for x, y in gaps if x != y]
    # Where words were put in or left out on one side only, a blank goes with them.
    if most is not None and (total := sum([max(len(x), len(y)) + (bool(x) != bool(y)) for x, y in gaps])) <= most:
        return total
    if not exact or sum([len(x) * len(y) for x, y in gaps]) * 3 > len(a) * len(b):
        return None
    if most is not None and sum([max(len(x), len(y)) for x, y in gaps]) > 2 * most:
        return None
    total = 0
    for x, y in gaps:
        total += edit_distance(x, y, None if most is None else most - total) + (bool(x) != bool(y))
        if most is not None and total > most:
            return None
    return total


def edit_distances(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distances of many pairs of code point arrays (no ``a`` empty) at once, by the same bit vectors as
    ``edit_distance``, in numbers of 64 bits: cells, one or several to a pair, of which each is a character behind the one above it, so
    that one step of the loop treats all cells of all pairs of whatever length. Of distances over ``most`` only that is told: cells
    that lie too far above the diagonal go, and a pair once no row can lead to so few."""
    n = len(a)
    size, other = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    blocks = -(-size // 64)
    cells = int(blocks.sum())
    left, right = np.concatenate(a), np.concatenate(b)
    named = np.zeros(int(max(left.max(), right.max(initial=0))) + 1, bool)
    named[left] = True
    alphabet = int(named.sum())
    if n > 1 and alphabet * cells > 1 << 22:
        return np.concatenate([edit_distances(a[i:j], b[i:j], None if most is None else most[i:j]) for i, j in ((0, n // 2), (n // 2, n))])
    code = np.where(named, np.cumsum(named) - 1, alphabet) * cells  # those that no pattern holds come last
    first = np.cumsum(blocks) - blocks
    pair = np.repeat(np.arange(n), blocks)
    cell = np.arange(cells)
    nth = cell - first[pair]
    where = np.zeros((alphabet + 1) * cells, np.uint64)
    row = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
    np.bitwise_or.at(where, code[left] + np.repeat(first, size) + row // 64, np.uint64(1) << (row % 64).astype(np.uint64))
    ahead = int(blocks.max())  # before a text and behind all of them: characters that no pattern holds
    begins = np.cumsum(other + ahead) - other
    text = np.full(int(begins[-1] + other.max() + other[-1] + 3 * ahead + 64), alphabet * cells)
    text[np.repeat(begins - np.cumsum(other) + other, other) + np.arange(len(right))] = code[right]
    at = begins[pair] - nth
    one = np.uint64(1)
    last = first + blocks - 1
    shift = np.full(cells, 63, np.uint64)
    shift[last] = (size - 1) % 64
    up, down = np.full(cells, ~np.uint64(0)), np.zeros(cells, np.uint64)
    score = 64 * (nth + 1)  # the distance in a cell's last row
    score[last] = size
    rise_out, fall_out = np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
    rise_in, fall_in = np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
    bound = size + other if most is None else most
    out = np.where(other == 0, size, np.maximum(bound, 0) + 1)
    ends = np.where(other == 0, -1, other + blocks - 2)  # the step after which a distance is known
    order = np.argsort(ends, kind="stable")
    known = int((ends < 0).sum())
    alive = ends >= 0
    ordered = ends[order]
    for step in range(int(ends.max()) + 1):
        equal = where.take(text.take(at) + cell)
        at += 1
        rise_in[1:], fall_in[1:] = rise_out[:-1], fall_out[:-1]
        rise_in[first], fall_in[first] = one, 0
        vertical = equal | down
        equal |= fall_in
        horizontal = equal & up
        horizontal += up
        horizontal ^= up
        horizontal |= equal
        rise = horizontal | up
        np.invert(rise, out=rise)
        rise |= down
        fall = up & horizontal
        rise_out, fall_out = rise >> shift & one, fall >> shift & one
        score += rise_out.view(np.int64)
        score -= fall_out.view(np.int64)
        rise <<= one
        rise |= rise_in
        fall <<= one
        fall |= fall_in
        np.bitwise_and(rise, vertical, out=down)
        vertical |= rise
        np.invert(vertical, out=vertical)
        np.bitwise_or(fall, vertical, out=up)
        if ordered[known] == step:
            to = int(np.searchsorted(ordered, step, "right"))
            done = order[known:to]
            known = to
            done = done[alive[done]]
            out[done] = score[last[done]]
            alive[done] = False
            if known == n:
                break
        if step % 64 < 63:
            continue
        read = step + 1 - nth  # characters that a cell has read
        keep = alive[pair]
        if most is not None:
            keep &= (read - 64 * (nth + 1) <= bound[pair]) | (nth == blocks[pair] - 1)
            # No path comes from a row that is too far from both ends; from cell to cell it may pass between what they have read, by two at most.
            test = np.flatnonzero(keep & (read <= other[pair]))
            of, seen = pair[test], np.maximum(read[test], 0)
            bits = [np.unpackbits(x[test].view(np.uint8).reshape(len(test), 8), axis=1, bitorder="little").view(np.int8) for x in (up, down)]
            rows = 64 * nth[test, None] + np.arange(65)
            inside = rows <= size[of, None]
            low = np.zeros((len(test), 65), np.int32)
            np.cumsum((bits[0] - bits[1]) * inside[:, 1:], axis=1, out=low[:, 1:])
            low += (score[test] - low[:, -1])[:, None].astype(np.int32)
            low += np.abs((size[of] - other[of] + seen)[:, None] - rows).astype(np.int32)
            near = np.full(n, 1 << 30)
            np.minimum.at(near, of, np.where(inside, low, 1 << 30).min(axis=1) - 2)
            alive &= near <= bound
            keep &= alive[pair]
            if not alive.any():
                break
        if keep.sum() > 0.8 * len(cell):
            continue
        cell, at, pair, nth, shift, up, down, score, rise_out, fall_out = (x[keep] for x in (cell, at, pair, nth, shift, up, down, score, rise_out, fall_out))
        rise_in, fall_in = rise_in[keep], fall_in[keep]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        last = np.zeros(n, np.int64)
        last[pair] = np.arange(len(pair))  # the later one stays
    return out


def replaced_words(a: str, b: str) -> int | None:
    """A number that the Levenshtein distance of two lines of as many words doesn't exceed: words that differ at a place are replaced whole. None if one has more words."""
    a, b = a.split(" "), b.split(" ")
    return sum([max(len(x), len(y)) for x, y in zip(a, b) if x != y]) if len(a) == len(b) else None


def similar_pairs(a: list[str], b: list[str], threshold: float, *, longest: int = 4096, cells: int = 16384, anchored: int = 64) -> np.ndarray:
    """``similar`` for each pair. Most that are similar are so by words that differ at their places, or, where over ``anchored`` characters are left between equal ends,
    between the words that both have once. Of the others many of like length are compared side by side, those of over ``longest`` characters one by one."""
    if len(a) > 16384:
        return np.concatenate([similar_pairs(a[k : k + 16384], b[k : k + 16384], threshold, longest=longest, cells=cells, anchored=anchored) for k in range(0, len(a), 16384)])
    out = np.zeros(len(a), bool)
    rest: list[tuple] = []  # length, blocks, number, most, texts
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if len(x) > len(y):
            x, y = y, x
        most = (1 - threshold) * len(y) + 1e-9
        if len(y) - len(x) > most:
            continue
        if (bound := replaced_words(x, y)) is not None and bound <= most:
            out[i] = True
            continue
        p, q = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (x, y))
        unlike = p != q[: len(p)]
        k = int(unlike.argmax()) if unlike.any() else len(p)
        p, q, x, y = p[k:], q[k:], x[k:], y[k:]
        unlike = p[::-1] != q[::-1][: len(p)]
        k = int(unlike.argmax()) if unlike.any() else len(p)
        p, q, x, y = p[: len(p) - k], q[: len(q) - k], x[: len(x) - k], y[: len(y) - k]
        if len(q) <= most:
            out[i] = True
            continue
        if len(p) > anchored and anchored_distance(x, y, most, exact=len(p) > longest) is not None:
            out[i] = True
        elif len(p) > longest:
            out[i] = edit_distance(x, y, most) <= most
        elif len(p):
            rest.append((len(q), -(-len(p) // 64), i, most, p, q))
    rest.sort(key=lambda r: r[:2])
    at = 0
    while at < len(rest):
        to, held = at + 1, rest[at][1]
        while to < len(rest) and rest[to][0] <= rest[at][0] * 1.5 + 64 and held < cells:
            held += rest[to][1]
            to += 1
        group = rest[at:to]
        if len(group) >= SIDE_BY_SIDE:
            found = edit_distances([r[4] for r in group], [r[5] for r in group], np.array([r[3] for r in group]))
        else:  # long numbers in Python take less steps
            found = np.array([edit_distance(a[r[2]], b[r[2]], r[3]) for r in group])
        out[[r[2] for r in group]] = found <= np.array([r[3] for r in group])
        at = to
    return out


def similar(a: str, b: str, threshold: float) -> bool:
    """Edit similarity 1 - distance / longer length at least ``threshold``."""
    longer = max(len(a), len(b))
    most = (1 - threshold) * longer + 1e-9
    return abs(len(a) - len(b)) <= most and edit_distance(a, b, most) <= most


@dataclass
class Laid:
    """Some lines side by side. For each weight of words that they have (as a power of two): a row for each word of a line, first to last
    with the words of that weight that are different, then with the last one again; and how many are different."""

    lines: np.ndarray
    words: dict[int, tuple[np.ndarray, np.ndarray]]


def side_by_side(hashes: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, most: int = LAID_WORDS) -> list[Laid]:
    """All lines, such with like many words of the largest weight together, so many words at a time or one line's.

    ``hashes`` and ``lengths`` (bytes): the words of all lines one after another; ``sizes``: words of each line, at least one.
    """
    out: list[Laid] = []
    if not len(sizes):
        return out
    first = np.cumsum(sizes) - sizes
    weight = _WEIGHT[np.minimum(lengths, len(_WEIGHT) - 1)]
    order = np.argsort(np.add.reduceat((weight == _WEIGHT[-1]).astype(np.int64), first), kind="stable")
    total = np.cumsum(sizes[order])
    kept = weight << np.uint64(HASHED) | hashes >> np.uint64(64 - HASHED)
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        lines = order[at:to]
        n, own = to - at, sizes[lines]
        begins = np.cumsum(own) - own
        words = kept[np.arange(int(own.sum())) + np.repeat(first[lines] - begins, own)] | np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(HASHED + 2), own)
        words.sort()
        words = words[np.append(True, words[1:] != words[:-1])]
        counts = np.bincount((words >> np.uint64(HASHED)).astype(np.int64), minlength=4 * n)
        begins = (np.cumsum(counts) - counts).reshape(n, 4)
        counts = counts.reshape(n, 4)
        words &= np.uint64((1 << HASHED) - 1)
        held = {}
        for k in range(4):
            if rows := int(counts[:, k].max()):
                place = begins[:, k] + np.minimum(np.arange(rows)[:, None], np.maximum(counts[:, k] - 1, 0))
                held[k] = words.take(place, mode="clip"), counts[:, k]
        out.append(Laid(lines, held))
        at = to
    return out


def simhash(hashes: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, laid: list[Laid] | None = None) -> np.ndarray:
    """(lines, PARTS) unsigned numbers: for each line the weighted majority of the hash bits of its different words.

    Arguments as for ``side_by_side``, or what it made of them. Repeated words count once, or a frequent one would make unlike lines
    alike. The bits of 64 hashes are added at once: of three numbers the sums and the carries are two.
    """
    out = np.empty((len(sizes), PARTS), np.uint64)
    for some in side_by_side(hashes, lengths, sizes) if laid is None else laid:
        n = len(some.lines)
        added: dict[int, list[np.ndarray]] = {}  # numbers by the weight of their bits
        whole = np.zeros(n, np.int64)
        for k, (words, counts) in some.words.items():
            here = words << np.uint64(2) | np.uint64(k)
            with np.errstate(over="ignore"):
                bits = np.concatenate([mix(here * np.uint64(2 * j + 1) + np.uint64(j)) for j in range(1, PARTS + 1)], axis=1)
            if (least := int(counts.min())) < len(words):
                bits[least:] *= np.tile(np.arange(least, len(words))[:, None] < counts, PARTS)  # rows beyond a line's words count nothing
            added[k] = [bits]
            whole += counts << k
        planes, k = [], 0
        while added:
            rows = added.pop(k, None)
            if rows is None:
                planes.append(np.zeros(n * PARTS, np.uint64))
                k += 1
                continue
            rows = np.concatenate(rows) if len(rows) > 1 else rows[0]
            while len(rows) > 1:
                if len(rows) == 2:
                    carry, rows = rows[:1] & rows[1:], rows[:1] ^ rows[1:]
                else:
                    m = len(rows) // 3
                    x, y, z = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
                    unlike = x ^ y
                    carry = x & y
                    carry |= unlike & z
                    unlike ^= z
                    rows = np.concatenate((unlike, rows[3 * m :])) if 3 * m < len(rows) else unlike
                added.setdefault(k + 1, []).append(carry)
            planes.append(rows[0])
            k += 1
        least = np.tile(whole // 2 + 1, PARTS)  # a bit is set if its sum is that or more
        above = np.full(n * PARTS, ~np.uint64(0))
        for k, plane in enumerate(planes):
            wanted = np.where(least >> k & 1 == 1, ~np.uint64(0), np.uint64(0))
            above = plane & ~wanted | ~(plane ^ wanted) & above
        out[some.lines] = above.reshape(PARTS, n).T
    return out


def line_hashes(texts: Texts) -> tuple[np.ndarray, ...]:
    """(first word, words, text, number in the text, two hashes) of each line that has a word."""
    feeds = np.flatnonzero(texts.data == 0x0A)
    line = np.searchsorted(feeds, texts.starts)  # numbered over all texts
    owner = texts.owner
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(line)))
    number = line[first] - np.searchsorted(feeds, texts.edges)[owner[first]]
    nth = np.arange(len(line)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        each = mix(texts.hashes + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        one = mix(np.add.reduceat(each, first) + sizes.astype(np.uint64)) if len(first) else np.empty(0, np.uint64)
        two = np.add.reduceat(mix(each ^ texts.hashes), first) if len(first) else one
    return first, sizes, owner[first], number, one, two


def line_bands(hashes: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, bands: int, rows: int, laid: list[Laid] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, bands) keys, in each of which two lines agree with the ``rows``-th power of the weighted Jaccard of their words,
    and (lines, bands * rows) bytes, each of which agrees with that Jaccard (and by chance, in 1 of 256).

    Arguments as for ``side_by_side``, or what it made of them. A word of four bytes or more weighs eight times one of a byte, so that few
    bands consist of the commonest words alone. Coordinates are the least of 32-bit numbers.
    """
    out = np.empty((len(sizes), bands), np.uint64)
    sketch = np.empty((len(sizes), bands * rows), np.uint8)
    factors, start = seeds(bands * rows, 8 + rows).astype(np.uint32), np.arange(bands, dtype=np.uint64) * np.uint64(8) + np.uint64(rows)
    for some in side_by_side(hashes, lengths, sizes) if laid is None else laid:
        n = len(some.lines)
        least = np.full((bands * rows, n), ~np.uint32(0))
        for k, (words, counts) in some.words.items():
            values = (words >> np.uint64(HASHED - 32)).astype(np.uint32)
            if n < 32:  # few lines of many words: a line's lie together
                values = np.ascontiguousarray(values.T)
            step = max(1, PRODUCTS // values.size)
            lowest = np.concatenate([np.minimum.reduce(values * factors[j : j + step, None, None], axis=1 if n >= 32 else 2) for j in range(0, len(factors), step)])
            lowest >>= np.uint32(k)
            lowest[:, counts == 0] = ~np.uint32(0)
            np.minimum(least, lowest, out=least)
        with np.errstate(over="ignore"):
            sketch[some.lines] = (least * np.uint32(0x9E3779B1) >> np.uint32(24)).T
            least = least.reshape(bands, rows, n)
            key = np.repeat(start[:, None], n, axis=1)
            for j, c in enumerate(seeds(rows, 7)):
                key += least[:, j] * c
            out[some.lines] = mix(key).T
    return out, sketch


def line_keys(hashes: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which lines meet others (blocks of their SimHashes, MinHash bands), and the line of each key."""
    laid = side_by_side(hashes, lengths, sizes)
    blocks = simhash(hashes, lengths, sizes, laid).view(np.uint32).astype(np.uint64)  # 32 bits each
    with np.errstate(over="ignore"):
        blocks = mix(blocks + (np.arange(1, blocks.shape[1] + 1, dtype=np.uint64) << np.uint64(40)))
    table = np.concatenate([blocks, line_bands(hashes, lengths, sizes, BANDS, ROWS, laid)[0]], axis=1)
    short = sizes < SHORT
    of = np.repeat(short, sizes)
    more, _ = line_bands(hashes[of], lengths[of], sizes[short], MORE_BANDS, MORE_ROWS)
    keys = np.concatenate([table.ravel(), more.ravel()])
    return keys, np.concatenate([np.repeat(np.arange(len(sizes)), table.shape[1]), np.repeat(np.flatnonzero(short), MORE_BANDS)])


def sketches(lines: Texts, joined: pa.Array | None = None) -> pa.Array:
    """For each line whether it is short, middling or LONG (2, 0, 1), and a byte for each coordinate of its bands; of lines of less than
    COUNTED words also how often ``joined`` (if given) has each of 64 kinds of character pairs and 32 of characters."""
    sizes = np.diff(lines.bounds)
    table = line_bands(lines.hashes, lines.ends - lines.starts, sizes, BANDS, ROWS)[1]
    kind = np.where(sizes >= LONG, 1, np.where(sizes >= SHORT, 0, 2)).astype(np.uint8)
    whole = np.zeros((len(sizes), 1 + BANDS * ROWS + COUNTS), np.uint8)
    whole[:, 0], whole[:, 1 : 1 + BANDS * ROWS] = kind, table
    few = np.flatnonzero(sizes < COUNTED) if joined is not None else np.empty(0, np.int64)
    if len(few):
        whole[few, 1 + BANDS * ROWS :] = character_counts(joined.take(pa.array(few)))
    width = np.full(len(sizes), whole.shape[1] - COUNTS)
    width[few] += COUNTS
    data = whole[np.arange(whole.shape[1]) < width[:, None]]
    edges = np.append(0, np.cumsum(width)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes())])


def band_marks(lines: Texts, none: int) -> np.ndarray:
    """(lines, BANDS + MORE_BANDS) numbers: 32 bits of each band key of a line, first of those that all lines have; ``none`` where it has none."""
    sizes, lengths = np.diff(lines.bounds), lines.ends - lines.starts
    short = sizes < SHORT
    of = np.repeat(short, sizes)
    out = np.full((len(sizes), BANDS + MORE_BANDS), none, np.int64)
    out[:, :BANDS] = line_bands(lines.hashes, lengths, sizes, BANDS, ROWS)[0] & np.uint64(0xFFFFFFFF)
    out[short, BANDS:] = line_bands(lines.hashes[of], lengths[of], sizes[short], MORE_BANDS, MORE_ROWS)[0] & np.uint64(0xFFFFFFFF)
    return out


def character_counts(lines: pa.Array) -> np.ndarray:
    """(lines, COUNTS) bytes: how often (255 at most) each of 64 kinds of two consecutive characters occurs, and each of 32 of characters."""
    texts = lines.to_pylist()
    sizes = np.array([len(x) for x in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    with np.errstate(over="ignore"):
        pair = (mix(code[:-1] << np.uint64(32) | code[1:]) & np.uint64(63)).astype(np.int64)
    same = owner[1:] == owner[:-1]
    pairs = np.bincount(owner[1:][same] * 64 + pair[same], minlength=64 * len(texts)).reshape(-1, 64)
    ones = np.bincount(owner * 32 + (code & np.uint64(31)).astype(np.int64), minlength=32 * len(texts)).reshape(-1, 32)
    return np.minimum(np.concatenate([pairs, ones], axis=1), 255).astype(np.uint8)


def sketch_table(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lines, COUNTS) of counts as 16-bit numbers (-1: none) and rows of the other bytes."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.empty(0, np.uint8)
    size = 1 + BANDS * ROWS
    counts = np.full((len(column), COUNTS), -1, np.int16)
    few = np.flatnonzero(np.diff(edges) > size)
    counts[few] = data[edges[few, None] + np.arange(size, size + COUNTS)]
    return counts, data[edges[:-1, None] + np.arange(size)]


def alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether enough of the coordinates agrees, for each pair of such rows; of short lines always."""
    least = np.where(left[:, 0] & right[:, 0] == 1, LONG_AGREE, AGREE) * (left.shape[1] - 1)
    unlike = np.ascontiguousarray(left[:, 1:]).view(np.uint64) ^ np.ascontiguousarray(right[:, 1:]).view(np.uint64)
    unlike = (unlike & _LOW) + _LOW | unlike  # the top bit of each byte: whether it has any
    same = left.shape[1] - 1 - np.bitwise_count(unlike & ~_LOW).sum(axis=1)
    return (same >= least) | (left[:, 0] == 2) | (right[:, 0] == 2)


def line_sieve(table: pa.Table, threshold: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs of rows (size, sketch) go on to be compared: lengths must allow it, ``alike`` must hold, and characters that few
    edits can have left. An edit changes four counts of pairs and one character on either side at most."""
    size = table.column("size").to_numpy()
    counts, rows = sketch_table(table.column("sketch").combine_chunks())
    kind, words, counted = rows[:, 0], np.ascontiguousarray(rows[:, 1:]).view(np.uint64), counts[:, 0] >= 0

    def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if len(i) > SIEVE_STEP:
            return np.concatenate([test(i[k : k + SIEVE_STEP], j[k : k + SIEVE_STEP]) for k in range(0, len(i), SIEVE_STEP)])
        most = np.maximum(size[i], size[j]) * (1 - threshold) + 1e-9
        at = np.flatnonzero(np.abs(size[i] - size[j]) <= most)
        p, q = i[at], j[at]
        unlike = words[p] ^ words[q]
        unlike = (unlike & _LOW) + _LOW | unlike
        same = 8 * words.shape[1] - np.bitwise_count(unlike & ~_LOW).sum(axis=1)
        ok = (same >= np.where(kind[p] & kind[q] == 1, LONG_AGREE, AGREE) * (8 * words.shape[1])) | (kind[p] == 2) | (kind[q] == 2)
        at = at[ok]
        few = np.flatnonzero(counted[i[at]] & counted[j[at]])
        gone = np.zeros(len(at), bool)
        for a in range(0, len(few), 4096):
            here = few[a : a + 4096]
            apart = counts[i[at[here]]] - counts[j[at[here]]]
            pairs, ones = np.abs(apart[:, :64]).sum(axis=1), apart[:, 64:]
            ones = np.maximum(np.maximum(ones, 0).sum(axis=1), np.maximum(-ones, 0).sum(axis=1))
            gone[here] = (pairs > 4 * most[at[here]]) | (ones > most[at[here]])
        out = np.zeros(len(i), bool)
        out[at[~gone]] = True
        return out

    return test


def dedup_lines(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """``docs`` with ``text`` cut to the kept lines, and n_lines, n_removed: one occurrence of each group of lines stays.

    Lines are split at line feeds and compared as normalised words (lower case, single blanks). Lines are
    linked if they are candidates and their edit similarity is at least ``threshold``. Candidates share one of the four
    32-bit blocks of their 128-bit SimHashes (so all within 3 differing bits), or one of 16 MinHash bands of 4 of their words,
    or, if both have less than 10 words, one of 48 bands of 3, at any number of lines. A pair whose sets of words have the
    (weighted) Jaccard J is missed with probability (1 - J**4)**16 at most: 0.002 at 3/4, 0.03 at 2/3 (a fifth of the
    words changed), 0.10 at 0.6; if short, with (1 - J**3)**48 too: 0.002 at 1/2, 0.02 at 3/7, 0.16 at 1/3. Two lines of 10
    words or more are compared if also 30 % of their 64 MinHash coordinates agree, of 64 words or more if 45 % do (at
    J = 1/2, and 2/3 if long, all but one pair in 1,000). So a pair at ``threshold`` whose edits are spread over most of its words may be missed. Of each connected
    group the first occurrence, in order of id, row and line, is kept. Equal normalised lines (by 128 bits of hash) are one
    node and never paired.

    Lines without a word are no candidates and stay. Null text stays null (no lines); null ids come last; rows of one
    id are documents of their own. n_lines counts lines with a word. A line that a third of all rows hold is counted
    before it is shuffled. A text is held whole in its task, about 20 bytes a byte; comparing two lines takes time
    as the product of their lengths / 64. Columns pass through (n_lines and n_removed are replaced); an empty table gives
    an empty result.
    """
    row, gone_of = unused(docs, "_row", "_gone")
    stored = materialize(docs.drop("n_lines", "n_removed").withColumn(row, F.monotonically_increasing_id()), level=1)

    def slices(column: pa.Array) -> Iterator[tuple[int, Texts, tuple[np.ndarray, ...]]]:
        """(first row, words, lines) of stretches of the texts, a MiB or one text each."""
        column = column.cast(pa.large_string())
        for a, b in by_bytes((pc.binary_length(column).fill_null(0).to_numpy() + 64).tolist(), 1 << 20):
            texts = read_words(normalized(column.slice(a, b - a)))
            yield a, texts, line_hashes(texts)

    def split():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[], [], [], []]
            for a, _, (_, _, owner, number, one, two) in slices(batch.column(2)):
                for held, x in zip(out, (owner + a, number.astype(np.int32), one.view(np.int64), two.view(np.int64)), strict=True):
                    held.append(x)
            owner, number, one, two = (pa.array(np.concatenate(x)) for x in out)
            return pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), number, one, two], ["row", "id", "line", "one", "two"])

        return each

    def keyed(rows: DataFrame, out: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
        """What ``out`` makes of the keys and nodes of the lines of a batch that are new to their task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.empty(0, np.uint64)
            found, size = ([], []), 0
            for batch in batches:
                for _, texts, (_, sizes, _, _, one, _) in slices(batch.column(0)):
                    fresh, at = np.unique(one, return_index=True)
                    place = np.searchsorted(seen, fresh)
                    new = (place == len(seen)) | (np.append(seen, np.uint64(0))[place] != fresh)
                    seen = np.sort(np.concatenate((seen if len(seen) < 1 << 21 else seen[:0], fresh[new])))
                    mine = np.zeros(len(one), bool)
                    mine[at[new]] = True
                    of = np.repeat(mine, sizes)
                    key, line = line_keys(texts.hashes[of], (texts.ends - texts.starts)[of], sizes[mine])
                    found[0].append(key)
                    found[1].append(one[mine][line])
                    size += len(key)
                    if size >= DEALT:
                        yield out(*(np.concatenate(x).view(np.int64) for x in found))
                        found, size = ([], []), 0
            if size:
                yield out(*(np.concatenate(x).view(np.int64) for x in found))

        return in_arrow(rows.select(F.col(text).alias("t")), run, schema)

    def deal(hot: np.ndarray, parts: int) -> DataFrame:
        return keyed(stored, lambda key, node: deal_pairs(key, node, hot, parts), "part long, packed binary")

    def texts():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts, names = [], ["node", "two", "words", "size", "sketch"]
            column = batch.column(0).cast(pa.large_string())
            for a, b in by_bytes((pc.binary_length(column).to_numpy() + 64).tolist(), 1 << 20):
                needs, found = batch.column(1).slice(a, b - a), pc.split_pattern(column.slice(a, b - a), "\n")
                which = pc.list_parent_indices(needs).to_numpy()
                node, two, line = (x.to_numpy() for x in needs.flatten().flatten())
                first = found.offsets.to_numpy()
                words = read_words(normalized(found.flatten().take(pa.array(first[which] - first[0] + line))))
                joined = join_words(words, np.ones(len(words.hashes), bool))
                columns = [pa.array(node), pa.array(two), joined, pc.utf8_length(joined).cast(pa.int32()), sketches(words, joined)]
                parts.append(pa.RecordBatch.from_arrays(columns, names))
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        return each

    def check():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = similar_pairs(batch.column(2).to_pylist(), batch.column(3).to_pylist(), threshold)
            return batch.select([0, 1]).filter(pa.array(keep))

        return each

    lines = map_arrow(stored.select(row, F.col(id_col).alias("id"), F.col(text).alias("t")), split, f"row long, id {docs.schema[id_col].dataType.simpleString()}, line int, one long, two long")
    lines = materialize(lines, level=1)
    probe = keyed(stored.where(F.pmod(F.xxhash64(row), F.lit(PROBE)) == 0), lambda key, node: pa.RecordBatch.from_arrays([pa.array(key)], ["key"]), "key long")
    shared = shared_buckets(deal, probe, 1 / PROBE)
    known: list[DataFrame] = []
    rounds = itertools.count()

    def payload(members: DataFrame) -> DataFrame:
        # Of different lines with one hash the least stands for it; the others only match their equals.
        needed = members.withColumnRenamed("node", "one").hint("merge")
        at = lines.select("one", "two", "row", "line").join(needed, "one", "left_semi").groupBy("one").agg(F.min(F.struct("two", "row", "line")).alias("x"))
        at = at.groupBy(F.col("x.row").alias(row)).agg(F.collect_list(F.struct(F.col("one").alias("node"), "x.two", "x.line")).alias("needs"))  # lines of one document
        wanted = stored.select(row, F.col(text).alias("t")).join(at.hint("merge"), row).select("t", "needs")
        known.append(materialize(map_arrow(wanted, texts, "node long, two long, words string, size int, sketch binary"), level=1))
        return known[0]

    def verify(pairs: DataFrame) -> DataFrame:
        # After the first round few pairs are left.
        held = marked(known[0], pairs.select(F.explode(F.array("a", "b")).alias("node"))) if next(rounds) else known[0]
        a, b = (held.select(F.col("node").alias(x), F.col("words").alias(f"words{x}")).hint("merge") for x in "ab")  # the same plan at any size
        return map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "wordsa", "wordsb"), check, "a long, b long")

    def match(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Similar lines of different components, for those on the left; a pair that shares several bands is compared in the bucket of
        the first, and none that the links found here connect already."""
        test, n, m = line_sieve(pa.concat_tables([left, right]), threshold), left.num_rows, right.num_rows
        names, now = np.unique(np.concatenate([t.column("comp").to_numpy() for t in (left, right)]), return_inverse=True)
        bands = [band_marks(read_words(t.column("words")), -k) for k, t in enumerate((left, right), 1)]  # few rows come here
        words = [t.column("words").to_pylist() for t in (left, right)]
        here = left.column("key")[0].as_py() & 0xFFFFFFFF
        x, y, label = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.arange(len(names))
        found, count = [], 0
        for a in range(0, n, 64):
            i, j = np.nonzero(label[now[a : min(a + 64, n)], None] != label[now[n:]])
            i += a
            ok = test(i, j + n)
            i, j = i[ok], j[ok]
            same = bands[0][i] == bands[1][j]
            ok = ~same.any(axis=1) | (bands[0][i, same.argmax(axis=1)] == here)
            found.append((i[ok], j[ok]))
            count += int(ok.sum())
            if count < TOGETHER and a + 64 < n:
                continue
            i, j = (np.concatenate(side) for side in zip(*found, strict=True))
            found, count = [], 0
            ok = similar_pairs([words[0][k] for k in i], [words[1][k] for k in j], threshold)
            for p, q in zip(i[ok], j[ok], strict=True):
                if (one := label[now[p]]) != (other := label[now[n + q]]):
                    label[label == other] = one
                    x.append([p])
                    y.append([q])
        return np.concatenate(x).astype(np.int64), np.concatenate(y).astype(np.int64)

    found = cluster_sieved(shared, payload, lambda table: line_sieve(table, threshold), verify, match, marks=["size", "sketch"])
    linked = known[0].select(F.col("node").alias("one"), "two").join(found.withColumnRenamed("node", "one"), "one")
    equal = lines.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two")
    members = materialize(equal.join(linked, ["one", "two"], "full_outer").withColumn("component", F.coalesce("component", F.xxhash64("one", "two"))))
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("line").alias("line"))
    held = materialize(lines.join(members.hint("merge"), ["one", "two"]).select("component", place.alias("place")))
    heads = materialize(held.groupBy("component").agg(F.min("place").alias("head")))
    gone = held.join(heads.hint("merge"), "component").where("place <> head")
    gone = gone.groupBy(F.col("place.row").alias(row)).agg(F.collect_list("place.line").alias(gone_of))  # lines of one document
    counts = lines.groupBy(F.col("row").alias(row)).agg(F.count("*").alias("n_lines"))
    found = materialize(counts.join(gone, row, "left"))
    out = stored.join(found.hint("merge"), row, "left")  # the same plan at any size
    left = F.array_except(F.sequence(F.lit(0), F.size(F.split(text, "\n")) - 1), F.col(gone_of))
    # A one-element array binds the lines to a name, so that the text is split once and not for each line.
    kept = F.get(F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")), F.lit(0))
    out = out.withColumn(text, F.when(F.col(gone_of).isNull(), F.col(text)).otherwise(kept))
    removed = F.when(F.col(gone_of).isNull(), 0).otherwise(F.size(gone_of)).cast("long")
    return out.withColumn("n_removed", removed).withColumn("n_lines", F.coalesce("n_lines", F.lit(0)).cast("long")).drop(row, gone_of)
