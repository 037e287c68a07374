"""Texts of a batch as numpy arrays of code points: hashed n-grams, shared neighbouring pairs, hashes of code units. What a Column expression works out
character by character through lambdas is here a few array operations for many texts; Spark deals the texts, these functions see a batch.
"""

from __future__ import annotations

import numpy as np

#: Code points that are worked on at once.
PIECE = 1 << 18


def ends_of(sizes) -> np.ndarray:
    """Where each of the pieces of the given sizes begins, and where the last one ends."""
    return np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64))))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after the other, and the places where texts begin, with the end of the last one."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), ends_of(np.fromiter(map(len, texts), np.int64, len(texts)))


def pieces(sizes: np.ndarray, most: int = PIECE):
    """Slices of neighbouring items that have no more than `most` together, or are one item."""
    ends, at = ends_of(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield slice(at, to)
        at = to


# ---- hashed n-grams ----


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320) ^ (out >> np.uint32(1)), out >> np.uint32(1))
    return out


CRC = _crc_table()


def crc_after(state: np.ndarray, points: np.ndarray) -> np.ndarray:
    """CRC-32 registers after one more code point each, as UTF-8 has it."""
    take = lambda s, byte: CRC[(s ^ byte) & np.uint32(255)] ^ (s >> np.uint32(8))
    if not len(points) or points.max() < 0x80:
        return take(state, points)
    u = np.uint32
    lead = np.where(points < 0x80, points, np.where(points < 0x800, u(0xC0) | points >> u(6), np.where(points < 0x10000, u(0xE0) | points >> u(12), u(0xF0) | points >> u(18))))
    out = take(state, lead)
    for shift, first in ((12, 0x10000), (6, 0x800), (0, 0x80)):
        at = np.flatnonzero(points >= first)
        out[at] = take(out[at], u(0x80) | (points[at] >> u(shift) & u(0x3F)))
    return out


def hashed_counts(texts: list[str], dimensions: int, longest: int = 3) -> np.ndarray:
    """For each text the sums of signs of its runs of 1 to `longest` code points, by the remainder of their CRC-32; its highest bit is the sign."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for part in pieces(np.fromiter(map(len, texts), np.int64, len(texts))):
        points, ends = code_points(texts[part])
        row, state = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), np.full(len(points), 0xFFFFFFFF, np.uint32)
        # what is left of the text at each place
        left = ends[row + 1] - np.arange(len(points)) if len(points) else row
        total = np.zeros((len(ends) - 1) * dimensions)
        for n in range(1, longest + 1):
            state = crc_after(state[: max(0, len(points) - n + 1)], points[n - 1 :])
            whole = left[: len(state)] >= n
            found = ~state[whole]
            total += np.bincount(row[: len(state)][whole] * dimensions + found % np.uint32(dimensions), np.where(found >> np.uint32(31), 1.0, -1.0), len(total))
        out[part] = total.reshape(-1, dimensions)
    return out


# ---- neighbouring pairs ----


class Pairs:
    """The sets of neighbouring pairs of code points of texts, and of texts with the one that follows. A text of one code point has itself as its set."""

    def __init__(self, texts: list[str]):
        points, self.ends = code_points(texts)
        wide = points.astype(np.uint64)
        #: The pair that begins at each place, also where the second code point is the next text's.
        self.grams = np.zeros(len(points), np.uint64)
        self.grams[:-1] = wide[:-1] << np.uint64(32) | wide[1:]
        self.alone = np.uint64(1) << np.uint64(63) | wide
        self.sizes = np.diff(self.ends)

    def part(self, lo: int, hi: int, neighbours: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
        """Of texts lo to hi: all entries of sets and the rows that have them. Rows from 0 are the texts, then come neighbours, if asked for; the number of rows."""
        first, last, n = self.ends[lo], self.ends[hi], hi - lo
        sizes, begin = self.sizes[lo:hi], self.ends[lo:hi] - first
        row = np.repeat(np.arange(n), sizes)
        crossing = np.zeros(last - first, bool)
        crossing[(begin + sizes - 1)[sizes > 0]] = True
        inner, grams = ~crossing, self.grams[first:last]
        mine, own = row[inner], grams[inner]
        single = np.flatnonzero(sizes == 1)
        of_single = self.alone[first + begin[single]]
        if not neighbours or n < 2:
            return np.concatenate([own, of_single]), np.concatenate([mine, single]), n
        # neighbours have what either has, and the pair where they meet
        before, after, meet = mine > 0, mine < n - 1, np.flatnonzero((sizes[:-1] > 0) & (sizes[1:] > 0))
        pair = np.flatnonzero(sizes[:-1] + sizes[1:] == 1)
        of_pair = self.alone[first + begin[pair]]  # the one that is empty begins where the other does
        entries = [own, own[before], own[after], grams[(begin + sizes - 1)[meet]], of_single, of_pair]
        rows = [mine, n + mine[before] - 1, n + mine[after], n + meet, single, n + pair]
        return np.concatenate(entries), np.concatenate(rows), 2 * n - 1


def shared(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """For rows of two parts of Pairs how many entries they share, and the sizes of the sets of both; None where the tables have over `most` cells."""
    every, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    if max(a[2], b[2]) * len(every) > most or a[2] * b[2] > most:
        return None

    def table(rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(every)), np.float32)
        out[rows, places] = 1
        return out

    x, y = table(a[1], at[: len(a[0])], a[2]), table(b[1], at[len(a[0]) :], b[2])
    # whole numbers below 2^24, so single precision is exact
    return x @ y.T, x.sum(axis=1), y.sum(axis=1)


def pair_scores(both: np.ndarray, n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """0.72 of the similarity of sets of n and m entries that share some, and 0.28 of the ratio of lengths; 0 where a text is empty."""
    n, m, both = (v.astype(np.int64) for v in (n, m, both))
    jaccard = np.where((n == 0) & (m == 0), 1.0, np.where((n == 0) | (m == 0), 0.0, both / np.maximum(n + m - both, 1)))
    x, y = np.maximum(x, 1.0), np.maximum(y, 1.0)
    return np.where(empty, 0.0, jaccard * 0.72 + np.minimum(x, y) / np.maximum(x, y) * 0.28)


def row_shared(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts beside each other: pairs that both have, and the sizes of both sets."""
    keys, n = [], len(a)
    places, codes = [], []
    for texts in (a, b):
        p = Pairs(texts)
        row = np.repeat(np.arange(n), p.sizes)
        last = np.zeros(len(row), bool)
        last[(p.ends[1:] - 1)[p.sizes > 0]] = True
        one = np.flatnonzero(p.sizes == 1)
        places.append(np.concatenate([row[~last], one]))
        codes.append(np.concatenate([p.grams[~last], p.alone[p.ends[one]]]))
    every, at = np.unique(np.concatenate(codes), return_inverse=True)
    at = at.astype(np.int64)
    width = max(1, len(every))
    for rows, code in zip(places, (at[: len(codes[0])], at[len(codes[0]) :])):
        keys.append(np.unique(rows * width + code))
    count = lambda k: np.bincount(k // width, minlength=n)
    return count(np.intersect1d(*keys, assume_unique=True)), count(keys[0]), count(keys[1])


# ---- hashes of code units ----

#: Texts that are hashed side by side at least; fewer go on one by one.
BESIDE = 24


def fnv_1a(texts: list[str], offset: int, prime: int) -> np.ndarray:
    """32-bit FNV-1a over UTF-16 units. The texts of a batch go on side by side, the longest to the end."""
    coded = [t.encode("utf-16-le") for t in texts]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
    out = np.full(len(texts), offset, np.uint32)
    order = np.argsort(-sizes, kind="stable")
    units, begin = np.frombuffer(b"".join(coded), np.uint16), ends_of(sizes)[:-1][order]
    alive = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")  # texts that have a unit at each place
    state, times, at = out.copy(), np.uint32(prime), 0
    while at < len(alive) and alive[at] >= BESIDE:
        # units of a stretch of places, a place a row
        to = at + max(1, min(len(alive) - at, PIECE // int(alive[at])))
        n = int(alive[at])
        block = units[np.minimum(begin[:n] + np.arange(at, to)[:, None], len(units) - 1)].astype(np.uint32)
        for k, now in zip(range(to - at), alive[at:to].tolist()):
            part = state[:now]
            np.bitwise_xor(part, block[k, :now], out=part)
            np.multiply(part, times, out=part)
        at = to
    for k in range(int(alive[at]) if at < len(alive) else 0):
        h = int(state[k])
        for unit in memoryview(coded[order[k]]).cast("H")[at:]:
            h = (h ^ unit) * prime & 0xFFFFFFFF
        state[k] = h
    out[order] = state
    return out
