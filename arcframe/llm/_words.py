"""Words, word hashes and shingle hashes of whole texts, vectorised."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def windows(hashes: np.ndarray, width: int, salt: int = 1) -> np.ndarray:
    """A hash of each run of ``width`` consecutive word hashes (empty if there are fewer words)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k, c in enumerate(seeds(width, salt)):
            out += hashes[k : k + n] * c
        return mix(out)


#: Words of more bytes are hashed one by one.
_LONG = 256
#: The first so many bytes of a number of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Texts:
    """The words of a batch of texts, in order: no Python object for a word.

    Text k has the words bounds[k]..bounds[k + 1]; word i lies in data[starts[i]:ends[i]] (UTF-8) and belongs to owner[i].
    """

    data: np.ndarray
    edges: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def read_words(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Split and hash the words of a string column; null is empty. Equal words have equal hashes in any batch."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw is not None and edges[-1] > edges[0] else np.empty(0, np.uint8)
    edges = edges - edges[0]
    inside = np.zeros(len(data) + 2, bool)  # with a place before and behind the data
    inside[1:-1] = (data != 0x20) & (data - np.uint8(9) > 4)  # numbers below nine come round
    change = inside[1:] != inside[:-1]  # at the first byte of a word, and just behind its last one
    held = inside[edges] & inside[edges + 1]  # texts that meet without white space
    if held.any():
        meet = np.unique(edges[held])
        change[meet] = False
        places = np.flatnonzero(change)
        places = np.sort(np.concatenate((places, meet, meet)), kind="stable")  # an end and a beginning
    else:
        places = np.flatnonzero(change)
    starts, ends = places[::2], places[1::2]
    bounds = np.searchsorted(starts, edges)
    return Texts(data, edges, starts, ends, _hashed(data, starts, ends), bounds)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, of eight bytes at a time; words of one length of up to eight never have the same."""
    sizes = ends - starts
    eights = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))  # from each byte on
    with np.errstate(over="ignore"):
        size = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out = mix(size + (eights[starts] & _FIRST[np.minimum(sizes, 8)]))
        some, at = np.flatnonzero((sizes > 8) & (sizes <= _LONG)), 8
        while len(some):
            out[some] = mix(out[some] + (eights[starts[some] + at] & _FIRST[np.minimum(sizes[some] - at, 8)]))
            at += 8
            some = some[sizes[some] > at]
        for k in np.flatnonzero(sizes > _LONG):
            out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
        return mix(out + size)


def join_words(texts: Texts, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one blank."""
    last = np.full(len(texts.bounds) - 1, -1)
    kept = np.flatnonzero(keep)
    owner = texts.owner[kept]
    last[owner] = kept  # the later one stays
    gap = kept[last[owner] != kept]
    mask = np.zeros(len(texts.data) + 1, np.int8)
    mask[texts.starts[kept]] = 1
    mask[texts.ends[kept]] -= 1  # ends differ from one another, and so do starts
    mask = np.cumsum(mask[:-1], dtype=np.int8).view(bool)
    data = texts.data.copy()
    data[texts.ends[gap]] = 0x20
    mask[texts.ends[gap]] = True
    edges = np.concatenate(([0], np.cumsum(mask)))[texts.edges]
    return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data[mask].tobytes())).cast(pa.string())
