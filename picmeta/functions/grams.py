"""Runs of bytes (grams) that stand for longer strings, as 64-bit hashes taken from arrays of whole columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONG = 32
#: The ways to look for a string, best first: (bytes of a gram, which of them is a sign; None: any byte). A sign is neither letter nor digit. Of grams of LONG * 2^i bytes one in 2^i counts, by the hash of their first LONG.
WAYS = (*((LONG << i, 0) for i in range(10, -1, -1)), (24, 23), (24, 0), (16, 15), (16, 0), (8, 7), (8, 0), (4, 3), (2, 1), (8, None), (4, None), (2, None), (1, None))
#: A string takes a way of long grams that are at most a quarter of it, for LEAST of them or more, and picks about PICKS.
LEAST, PICKS = 8, 16
WINDOW, SLICE = 1 << 18, 4 << 20
SIGNS = np.zeros(256, bool)
for first, last in ((0x01, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    SIGNS[first : last + 1] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def laid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each row begins, with the end of the last."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if ends else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at


def hashed(data: np.ndarray, begin: int, p: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The hashes of the bytes at p, all at or behind begin and ascending."""
    if not len(p):
        return np.empty(0, np.uint64)
    own = np.concatenate([data[begin : p[-1] + size], np.zeros(8, np.uint8)])
    words, h = np.ndarray((len(own) - 7,), "<u8", own, 0, (1,)), np.full(len(p), seed, np.uint64)
    for i in range(0, size, 8):
        word = words[p - begin + i]
        h = mixed(h ^ (word if size >= 8 else word & np.uint64((1 << 8 * size) - 1)))
    return h


def placed(data: np.ndarray, at: np.ndarray, begin: int, end: int, size: int, sign: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places, ends of the rows) of runs of so many bytes that begin from begin to end."""
    p = np.arange(begin, end) if sign is None else np.flatnonzero(SIGNS[data[begin + sign : min(end + sign, at[-1])]]) + begin
    near = np.arange(np.searchsorted(at, begin, side="right") - 1, np.searchsorted(at, end, side="left"))
    each = np.diff(np.searchsorted(p, at[near[0] : near[-1] + 2]))
    row, ends = np.repeat(near, each), np.repeat(at[near + 1], each)
    inside = p + size <= ends
    return row[inside], p[inside], ends[inside]


def runs(data: np.ndarray, at: np.ndarray, ways: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(way, rows, hashes): the grams of these ways, WINDOW bytes at a time.

    A long gram's hash adds up those of the runs of LONG bytes in it that begin
    with a sign, so that all sizes are told from one sum over a window."""
    long = [w for w in ways if WAYS[w][0] >= LONG]
    reach = max((WAYS[w][0] for w in long), default=0)
    for begin in range(int(at[0]), int(at[-1]), WINDOW):
        end = min(begin + WINDOW, int(at[-1]))
        if long:
            row, p, ends = placed(data, at, begin, min(end + reach, int(at[-1])), LONG, 0)
            h = hashed(data, begin, p, LONG, 1)
            sums, own = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)]), np.searchsorted(p, end)
        for way in long:
            size = WAYS[way][0]
            i = np.flatnonzero(h[:own] & np.uint64(size // LONG - 1) == 0)
            i = i[p[i] + size <= ends[i]]
            yield way, row[i], mixed((sums[np.searchsorted(p, p[i] + size - LONG, side="right")] - sums[i]) ^ np.uint64(way + 1))
        for way in set(ways) - set(long):
            size, sign = WAYS[way]
            near, q, _ = placed(data, at, begin, end, size, sign)
            yield way, near, hashed(data, begin, q, size, way + 1)


def once(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((h, row))
    row, h = row[o], h[o]
    new = np.ones(len(o), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes, each pair once."""
    return once(np.concatenate([r for r, _ in found]), np.concatenate([h for _, h in found])) if found else (np.empty(0, np.int64), np.empty(0, np.uint64))


def slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows): the column in pieces of about SLICE bytes; a longer string is in one piece."""
    held = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
    heads = np.flatnonzero(np.diff(held, prepend=-1))
    for i, j in zip(heads, [*heads[1:], len(column)], strict=True):
        yield int(i), column.slice(i, j - i)


def few(n: int, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """About PICKS of the hashes of each of n rows (ascending), each once: the least, so that the same hashes give the same picks."""
    count, heads = np.bincount(row, minlength=n), np.flatnonzero(np.diff(row, prepend=-1))
    most = np.where(count > PICKS, PICKS / np.maximum(count, 1) * 2.0**63, 2.0**63).astype(np.uint64)
    least = np.repeat(np.minimum.reduceat(h, heads), np.diff([*heads, len(row)]))
    keep = (h >> np.uint64(1) < most[row]) | (h == least)
    return once(row[keep], h[keep])


def picked(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(way, rows, hashes): the grams that each string picks, of the best way that it has enough of. Empty strings have none."""
    ways = list(range(len(WAYS)))
    long, signs = [w for w in ways if WAYS[w][0] >= LONG], [w for w in ways if WAYS[w][0] < LONG and WAYS[w][1] is not None]
    for begin, part in slices(column):
        left = np.arange(begin, begin + len(part))
        for some in (long, signs, ways[len(long) + len(signs) :]):
            data, at = laid(part)
            n, taken = np.diff(at), np.diff(at) == 0
            found: dict[int, list] = {w: [(np.empty(0, np.int64), np.empty(0, np.uint64))] for w in some}
            if WAYS[some[0]][1] is not None:
                for way, row, h in runs(data, at, some):
                    fits = (WAYS[way][0] <= LONG) | (n[row] >= 4 * WAYS[way][0])
                    found[way].append((row[fits], h[fits]))
            for way in some:
                size, sign = WAYS[way]
                if sign is None:
                    row = np.flatnonzero(~taken & (n >= size))
                    h = np.array([x for r in row for x in hashed(data, at[r], at[r : r + 1], size, way + 1)], np.uint64)
                else:
                    own = found.pop(way)
                    row, h = np.concatenate([r for r, _ in own]), np.concatenate([h for _, h in own])
                    enough = (np.bincount(row, minlength=len(n)) >= (LEAST if size > LONG else 1)) & ~taken
                    row, h = row[enough[row]], h[enough[row]]
                if len(row):
                    taken[row] = True
                    row, h = few(len(n), row, h)
                    yield way, left[row], h
            rest = np.flatnonzero(~taken)
            if not len(rest):
                break
            part, left = part.take(pa.array(rest)), left[rest]


def bit_of(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The k-th position of each hash in a filter of so many bits, a power of two."""
    return ((h + np.uint64(k) * mixed(h) if k else h) & np.uint64(bits - 1)).astype(np.int64)


def hashes(way: int) -> int:
    """How many positions a gram has: more where few strings ask and many grams are tried."""
    return 3 if WAYS[way][0] >= LONG else 6


def asked(column: pa.Array, ways: list[int], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the grams of these ways whose bits are all set in the filter (bytes), each once."""
    data, at = laid(column)
    found = []
    for way, row, h in runs(data, at, ways):
        for k in range(hashes(way)):
            bit = bit_of(h, len(wanted) * 8, k)
            hit = wanted[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 != 0
            row, h = row[hit], h[hit]
        found.append(once(row, h))
    return joined(found)
