"""Vectorised text primitives over the UTF-8 buffers of Arrow string columns.

All functions work on whole batches: one ``uint8`` buffer and the offsets of its texts.
Hashes are 64-bit, depend on content alone and so mean the same in every task; two independent
families of them make 128 bits where equality is decided by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1_000_000


def byte_class(allowed) -> np.ndarray:
    """A 256-entry table from a predicate on byte values."""
    return np.array([bool(allowed(b)) for b in range(256)])


_BLANKS = frozenset((0x20, *range(0x09, 0x0E)))
#: Words are runs of anything but space and the control characters from tab to carriage return.
SPACED = byte_class(lambda b: b not in _BLANKS)
#: Words are runs of digits, lower-case letters and everything outside ASCII.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F))
_ODD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xE7037ED1A0B428DB))


class _Keys:
    """A pseudo-random number per place in a span, grown on demand."""

    def __init__(self, seed: np.uint64):
        self.seed, self.table = seed, np.zeros(0, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            places = np.arange(max(n, 2 * len(self.table)), dtype=np.uint64)
            with np.errstate(over="ignore"):
                self.table = mix(mix(places + self.seed) + self.seed)
        return self.table


_KEYS = tuple(map(_Keys, _SEEDS))


def _keyed_sums(values: np.ndarray, counts: np.ndarray, second: bool) -> np.ndarray:
    """Per span of ``counts`` consecutive values: the sum of every value mixed with the key of its place.

    Mixing is not linear, so no pattern of equal values cancels out, as it does in polynomials.
    """
    total = len(values)
    first = np.cumsum(counts) - counts
    place = np.arange(total) - np.repeat(first, counts)
    keys = _KEYS[second].upto(int(counts.max(initial=0)))
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(mix(values ^ keys[place]), out=sums[1:])
    return sums[first + counts] - sums[first]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """Hashes of the slices ``values[starts:ends]`` of 64-bit numbers, the length mixed in; ``second`` is an independent family."""
    counts = ends - starts
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return mix(_keyed_sums(values[at], counts, second) + counts.astype(np.uint64) * _ODD[second])


def byte_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """Hashes of the byte slices ``data[starts:ends]``, read in lanes of eight bytes, the length mixed in."""
    sizes = ends - starts
    counts = (sizes + 7) // 8
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    first = np.cumsum(counts) - counts
    place = np.arange(int(counts.sum())) - np.repeat(first, counts)
    value = lanes[np.repeat(starts, counts) + 8 * place]
    # the last lane of a slice keeps its own bytes only
    last = (first + counts - 1)[counts > 0]
    value[last] &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (((-sizes[counts > 0]) % 8) * 8).astype(np.uint64)
    return mix(_keyed_sums(value, counts, second) + sizes.astype(np.uint64) * _ODD[second])


class Texts(NamedTuple):
    """Texts of a chunk: their bytes and offsets (``len + 1`` of them)."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cut a string column into chunks of at most ``limit`` bytes (one text at least); nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        own = offsets[at : end + 1]
        yield Texts(slice(at, end), data[own[0] : own[-1]], own - own[0])
        at = end


class Words(NamedTuple):
    """Word spans in bytes, and for each text the index of its first word (``len + 1``)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words(texts: Texts, kind: np.ndarray, data: np.ndarray | None = None) -> Words:
    inside = kind[texts.data if data is None else data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[texts.offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.offsets))


def word_hashes(data: np.ndarray, found: Words, second: bool = False) -> np.ndarray:
    return byte_hash(data, found.starts, found.ends, second)


def joined_hash(a: np.ndarray, b: np.ndarray, second: bool = False) -> np.ndarray:
    """A hash of two hashes in their order."""
    return mix(a * _ODD[second] + mix(b + _SEEDS[second]))


def window_hashes(hashes: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """A hash for every run of ``width`` entries, whatever text they belong to; windows of powers of two are joined."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, power, own = None, 0, 1, hashes
    while True:
        if width & power:
            own_n = own[at : at + n]
            out = own_n if out is None else joined_hash(out, own_n, second)
            at += power
        if 2 * power > width:
            return mix(out + np.uint64(width)) if width > 1 else out.copy()
        own = joined_hash(own[:-power], own[power:], second)
        power *= 2


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """For each place where ``window_hashes`` has an entry: whether the window stays in its text."""
    total = int(first[-1])
    last = np.repeat(first[1:], np.diff(first))[: max(0, total - width + 1)]
    return np.arange(len(last)) + width <= last


def covered(starts: np.ndarray, width: int | np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in any of the runs that begin at ``starts``."""
    delta = np.bincount(starts, minlength=total + 1).astype(np.int64)
    delta -= np.bincount(starts + width, minlength=total + 1)[: total + 1]
    return np.cumsum(delta[:total]) > 0


def totals(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over consecutive ranges that ``offsets`` bound."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def owner(first: np.ndarray) -> np.ndarray:
    """For each word, the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def repeated(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether its group holds it more than once, and whether it held it before."""
    order = np.lexsort((np.arange(len(keys)), keys, group)) if len(keys) else np.zeros(0, np.int64)
    same = np.zeros(len(keys) + 1, bool)
    if len(keys) > 1:
        k, g = keys[order], group[order]
        same[1:-1] = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    twice, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return twice, again
