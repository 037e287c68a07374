"""The best covers of many small gaps side by side. What align.Band does for one gap a row at a time is done here for a run of gaps of like size, with the same totals and steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Steps of a cover, from the ones that come from furthest back; of equal totals the first wins.
STEPS = [(2, 2), (2, 1), (1, 2), (1, 1), (1, 0), (0, 1)]
UNREACHED = np.float32(-1e9)
#: Cells of the padded tables of a run of gaps.
CELLS = 1 << 16


def band_middle(n: int, m: int, half_even: bool) -> np.ndarray:
    """Where the diagonal stands at each of the n + 1 places."""
    at = np.arange(n + 1) / max(1, n) * m
    return np.rint(at).astype(int) if half_even else np.floor(at + 0.5).astype(int)


def along(best: np.ndarray, empty: float, inside: np.ndarray | None = None) -> np.ndarray:
    """The last step, which stays within a row: carries totals from left to right in `best` and says where that was better.

    A place depends on the one before it alone, so working all places out anew until none changes gives what one walk from left to right gives.
    """
    first, before = best[..., 1:].astype(float), best[..., :-1]
    while True:
        total = before + np.float64(empty)
        better = (before > UNREACHED) & (total > first)
        if inside is not None:
            better &= inside[..., 1:]
        now = np.where(better, total, first).astype(np.float32)
        if np.array_equal(now, best[..., 1:]):
            return better
        best[..., 1:] = now


def runs(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Numbers of gaps of like size whose padded tables have up to CELLS cells."""
    run: list[int] = []
    n = m = 0
    for g in sorted(range(len(sizes)), key=lambda g: (max(sizes[g]), sizes[g])):
        x, y = max(n, sizes[g][0]), max(m, sizes[g][1])
        if run and (len(run) + 1) * (x + 1) * (y + 1) > CELLS:
            yield run
            run, x, y = [], *sizes[g]
        run.append(g)
        n, m = x, y
    if run:
        yield run


def best(sizes: list[tuple[int, int]], tables: list[dict[tuple[int, int], np.ndarray]], band: int, empty: float, half_even: bool) -> tuple[np.ndarray, ...]:
    """(gap, i, j, items of the left, items of the right, score) of the covers of gaps of n and m items, none of them 0. tables have the scores by (a, b): of a items from i with b items from j."""
    out = [_run([sizes[g] for g in run], [tables[g] for g in run], band, empty, half_even, np.array(run)) for run in runs(sizes)]
    return tuple(map(np.concatenate, zip(*out))) if out else tuple(np.zeros(0, t) for t in (int, int, int, int, int, float))


def _run(sizes, tables, band: int, empty: float, half_even: bool, names: np.ndarray) -> tuple[np.ndarray, ...]:
    count, (n, m) = len(sizes), np.array(sizes).max(axis=0).tolist()
    low, high = np.zeros((count, n + 1), int), np.full((count, n + 1), -1)
    scores = {(a, b): np.zeros((count, n, m)) for a, b in STEPS if a and b}
    for g, ((x, y), table) in enumerate(zip(sizes, tables)):
        middle = band_middle(x, y, half_even)
        low[g, : x + 1], high[g, : x + 1] = np.maximum(0, middle - band), np.minimum(y, middle + band)
        for step, values in table.items():
            scores[step][g, : values.shape[0], : values.shape[1]] = values
    places, steps, rows = np.arange(m + 1), np.full((n + 1, count, m + 1), -1, np.int8), []
    for x in range(n + 1):
        inside = (places >= low[:, x, None]) & (places <= high[:, x, None])
        total, step = np.full((count, m + 1), UNREACHED), steps[x]
        if x == 0:
            total[:, 0] = 0
        for k, (a, b) in enumerate(STEPS[:-1]):
            if a > x or b > m:
                continue
            source = rows[-a][:, : m + 1 - b].astype(float)
            offer = source + (scores[a, b][:, x - a, : m + 1 - b] if b else empty)
            better = (source > UNREACHED) & (offer > total[:, b:]) & inside[:, b:]
            np.copyto(total[:, b:], offer, casting="same_kind", where=better)
            step[:, b:][better] = k
        step[:, 1:][along(total, empty, inside)] = len(STEPS) - 1
        rows = [*rows[-1:], total]
    at, found = np.arange(count), []
    x, y = np.array(sizes).T.copy()
    left, right = np.array(STEPS).T
    while len(at):
        k = steps[x, at, y]
        # a place that the band leaves unreached is left by 1:1, 1:0 or 0:1
        a, b = np.where(k >= 0, left[k], np.minimum(x, 1)), np.where(k >= 0, right[k], np.minimum(y, 1))
        x, y = x - a, y - b
        worth = np.full(len(at), float(empty))
        for (i, j), table in scores.items():
            of = np.flatnonzero((a == i) & (b == j) & (low[at, x] <= y) & (y <= high[at, x]))
            worth[of] = table[at[of], x[of], y[of]]
        found.append((names[at], x, y, a, b, worth))
        more = (x > 0) | (y > 0)
        at, x, y = at[more], x[more], y[more]
    return tuple(map(np.concatenate, zip(*found)))
