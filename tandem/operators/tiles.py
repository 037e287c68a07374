"""The cover of two embedded books of any size: the band of places is cut into tiles of TILE left items, which are worked out apart.

What a tile makes of any totals on the two rows of places before it is a (max, +) matrix between those rows and its own last two. The matrices of FAN
neighbouring tiles are multiplied, level by level, until a book has few; from the start of the book the totals then go down the levels to each tile. Knowing its first totals a tile
finds its steps, and where each of its last places comes from; the chain of these gives the place at which the path leaves each tile, and every tile is traced alone.

Scores are whole numbers of 1 / UNIT and totals are exact, so the tiles give the cover that one pass over the whole book gives, ties included. Totals of
single precision, as shorter books have them, could not tell the steps of so long a book apart: beyond 2 ** 18 they are multiples of 1 / 64.

A task holds one tile, FAN matrices (5 MB with the usual band), or of the chain some 200 bytes for each tile of a book.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE, FAN, UNIT = 4096, 64, 1 << 24
NEVER = -(1 << 60)
#: Large books that are told by a broadcast; more of them are joined.
MAX_BOOKS = 100_000


class Places:
    """Rows of places from `first` to `last` of a book of n and m items: where the band of each begins, before it is cut at 0 and m."""

    def __init__(self, n: int, m: int, first: int, last: int, window: int):
        self.m, self.first, self.last, self.window, self.width = m, first, last, window, 2 * window + 1
        # the diagonal as band_middle() has it, for these rows alone
        self.begin = np.rint(np.arange(first, last + 1) / max(1, n) * m).astype(np.int64) - window

    def at(self, x: int) -> int:
        return int(self.begin[x - self.first])

    def outside(self, x: int) -> np.ndarray:
        y = self.at(x) + np.arange(self.width)
        return (y < 0) | (y > self.m)


class Tile:
    """Rows x0 + 1 to last of a book of n and m items; sides are spans (idx, steps, vector)."""

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame, x0: int, last: int, n: int, m: int, window: int, empty: float, merge: float, steps: list[tuple[int, int]]):
        self.x0, self.last = x0, last
        self.places = Places(n, m, max(0, self.x0 - 1), self.last, window)
        self.m, self.width, self.steps, self.merge = m, 2 * window + 1, steps, merge
        self.empty = round(empty * UNIT)
        self.mine = {int(s): dict(zip(p.idx.tolist(), p.vector)) for s, p in left.groupby("steps")}
        self.other = {}
        for s, p in right.groupby("steps"):
            p = p.sort_values("idx")
            # the items dealt to a tile follow each other
            self.other[int(s)] = int(p.idx.iloc[0]), np.stack(p.vector.to_list()).astype(float)

    def scores(self, i: int, a: int, b: int, first: int) -> np.ndarray:
        """Scores of a items from i with b items from first, first + 1 and so on; NEVER where there are none."""
        out = np.full(self.width, NEVER, np.int64)
        if a in self.mine and i in self.mine[a] and b in self.other:
            start, vectors = self.other[b]
            lo, hi = max(first, start), min(first + self.width, start + len(vectors), self.m - b + 1)
            if lo < hi:
                worth = (vectors[lo - start : hi - start] * np.asarray(self.mine[a][i], float)).sum(axis=1) - self.merge * (a + b - 2)
                out[lo - first : hi - first] = np.rint(worth * UNIT).astype(np.int64)
        return out

    def row(self, x: int, before: list[np.ndarray], trace: bool = False):
        """Totals of row x from those of the two rows before (the nearer last), for one or many starts; with trace also the steps."""
        shape = before[-1].shape
        best, step, drift = np.full(shape, NEVER, np.int64), np.full(self.width, -1, np.int8), np.arange(self.width) * self.empty
        for k, (a, b) in enumerate(self.steps[:-1]):
            if x - a < 0:
                continue
            # place p of this row comes from place p + shift of the row a before
            shift = self.places.at(x) - self.places.at(x - a) - b
            lo, hi = max(0, -shift), min(self.width, self.width - shift)
            if lo >= hi:
                continue
            worth = self.scores(x - a, a, b, self.places.at(x) - b)[lo:hi] if b else self.empty
            total = before[-a][..., lo + shift : hi + shift] + worth
            if trace:
                better = (total > best[lo:hi]) & (total > NEVER // 2)
                step[lo:hi][better] = k
            best[..., lo:hi] = np.maximum(best[..., lo:hi], total)
        best[..., self.places.outside(x)] = NEVER
        best[best < NEVER // 2] = NEVER
        # the last step stays within the row: a running maximum carries it, as each place costs the same
        along = np.maximum.accumulate(best - drift, axis=-1) + drift
        if trace:
            step[(along > best) & (along > NEVER // 2)] = len(self.steps) - 1
        along[..., self.places.outside(x)] = NEVER
        along[along < NEVER // 2] = NEVER
        return along, step

    def rows(self, start: np.ndarray, trace: bool = False):
        """start has the totals of rows x0 - 1 and x0, one after the other. The same of the last two rows, and with trace the steps of each row."""
        before, steps = [start[..., : self.width], start[..., self.width :]], []
        for x in range(self.x0 + 1, self.last + 1):
            totals, step = self.row(x, before, trace)
            before = [before[-1], totals]
            steps.append(step)
        return np.concatenate(before, axis=-1), steps

    def matrix(self) -> np.ndarray:
        start = np.full((2 * self.width, 2 * self.width), NEVER, np.int64)
        np.fill_diagonal(start, 0)
        return self.rows(start)[0]

    def origins(self, steps: list[np.ndarray]) -> np.ndarray:
        """For each of the last places (of two rows) the first place from which its path comes, -1 if none does."""
        before = [np.arange(self.width), np.arange(self.width, 2 * self.width)]
        for x, step in zip(range(self.x0 + 1, self.last + 1), steps):
            row = np.full(self.width, -1)
            for p, k in enumerate(step.tolist()):
                if k == len(self.steps) - 1:
                    row[p] = row[p - 1]
                elif k >= 0:
                    a, b = self.steps[k]
                    row[p] = before[-a][p + self.places.at(x) - self.places.at(x - a) - b]
            before = [before[-1], row]
        return np.concatenate(before)


def first_totals(m: int, window: int, empty: float) -> np.ndarray:
    """Totals before the first tile: nothing is covered but right items alone. Row 0 begins `window` places before 0."""
    out = np.full(2 * (2 * window + 1), NEVER, np.int64)
    most = min(m, window)
    out[2 * window + 1 + window : 2 * window + 1 + window + most + 1] = np.arange(most + 1) * round(empty * UNIT)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product; a may be one row."""
    out = np.full(a.shape[:-1] + b.shape[1:], NEVER, np.int64)
    for q in range(b.shape[0]):
        np.maximum(out, a[..., q, None] + b[q], out=out)
    out[out < NEVER // 2] = NEVER
    return out


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(-1, 2 * width)


def large_books(left: DataFrame, right: DataFrame, keys: list[str], window: int, tile: int) -> DataFrame:
    """(keys, n, m) of books of more than two tiles whose band is one piece, as it is where the right side is at most `window` times the left."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    return count(left, "n").where(F.col("n") > 2 * tile).join(count(right, "m"), keys).where(F.col("m") <= window * F.col("n"))


def told(rows: DataFrame, books: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows joined with books, broadcast while they are few."""
    few = books.limit(MAX_BOOKS + 1).count() <= MAX_BOOKS
    return rows.join(F.broadcast(books) if few else books, keys, how)


def dealt(spans: DataFrame, books: DataFrame, keys: list[str], lo: Column, hi: Column, size: int) -> DataFrame:
    """spans of large books with n, m and each tile from that of item lo to that of item hi."""
    tile = lambda x: F.least(F.greatest(F.floor(x / size), F.lit(0)), F.floor((F.col("n") - 1) / size)).cast("long")
    return told(spans, books, keys, "inner").withColumn("tile", F.explode(F.sequence(tile(lo), tile(hi))))


def cover(left: DataFrame, right: DataFrame, books: DataFrame, keys: list[str], window: int, empty: float, merge: float, steps: list[tuple[int, int]], keep, size: int = TILE, fan: int = FAN) -> DataFrame:
    """(keys, i, j, a, b, score) of the best cover of the given books (keys, n, m); sides are spans (keys, idx, steps, vector). keep writes a table and reads it back."""
    from .align import beside, dot

    width, by, types = 2 * window + 1, [*keys, "tile"], dict(left.dtypes)
    fields = ", ".join(f"`{k}` {types[k]}" for k in keys)
    # a tile's rows x use left items x - 2 and x - 1, and right items within the band and the steps around it
    mine = keep(dealt(left, books, keys, F.col("idx"), F.col("idx") + 1, size))
    near = lambda y: y / F.greatest(F.col("m"), F.lit(1)) * F.col("n")
    other = keep(dealt(right, books, keys, F.floor(near(F.col("idx") - window - 3)) - 3, F.ceil(near(F.col("idx") + window + 3)) + 3, size))

    def tile_of(key, l, r) -> Tile:  # noqa: E741
        n, m, x0 = int(l.n.iloc[0]), int(l.m.iloc[0]), int(key[-1]) * size
        return Tile(l, r, x0, min(n, x0 + size), n, m, window, empty, merge, steps)

    def transfer(key: tuple, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        return pd.DataFrame([(*key, tile_of(key, l, r).matrix().tobytes())], columns=[*by, "matrix"])

    matrices = keep(beside(mine, other, by).applyInPandas(transfer, f"{fields}, tile long, matrix binary"))
    levels, most = [matrices], books.agg(F.max(F.ceil(F.col("n") / size))).first()[0] or 0

    def multiplied(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for blob in pdf.sort_values("tile").matrix:
            out = _unpacked(blob, width) if out is None else product(out, _unpacked(blob, width))
        return pd.DataFrame([(*key, out.tobytes())], columns=[*keys, "tile", "matrix"])

    parent = F.floor(F.col("tile") / fan).cast("long")
    while most > fan:
        grouped = levels[-1].withColumn("up", parent).groupBy(*keys, "up")
        levels.append(keep(grouped.applyInPandas(multiplied, f"{fields}, tile long, matrix binary")))
        most = -(-most // fan)

    starts = books.select(*keys, F.lit(0).cast("long").alias("tile"), F.col("m"))

    def opened(batches):
        for pdf in batches:
            yield pdf[keys].assign(tile=0, start=[first_totals(int(m), window, empty).tobytes() for m in pdf.m])

    starts = starts.mapInPandas(opened, f"{fields}, tile long, start binary")

    def downward(key: tuple, members: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        at, out = np.frombuffer(start.start.iloc[0], np.int64), []
        for tile, blob in members.sort_values("tile")[["tile", "matrix"]].itertuples(index=False):
            out.append((*key[:-1], tile, at.tobytes()))
            at = product(at, _unpacked(blob, width))
        return pd.DataFrame(out, columns=[*keys, "tile", "start"])

    for level in reversed(levels):
        members = level.withColumn("up", parent)
        starts = keep(beside(members, starts.withColumnRenamed("tile", "up"), [*keys, "up"]).applyInPandas(downward, f"{fields}, tile long, start binary"))

    def traced(key: tuple, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        tile = tile_of(key, l[l.steps > 0], r)
        _, found = tile.rows(np.frombuffer(l.start[l.steps == 0].iloc[0], np.int64), trace=True)
        return pd.DataFrame([(*key, int(l.n.max()), int(l.m.max()), tile.origins(found).astype(np.int32).tobytes(), np.stack(found).tobytes())], columns=[*by, "n", "m", "origins", "found"])

    begun = mine.unionByName(starts.withColumns({"steps": F.lit(0), "idx": F.lit(-1).cast(types["idx"])}), allowMissingColumns=True)
    tiles = keep(beside(begun, other, by).applyInPandas(traced, f"{fields}, tile long, n long, m long, origins binary, found binary"))

    def chained(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, out = width + window, []  # the path ends at (n, m), in the middle of the last row
        for tile, origins in pdf.sort_values("tile", ascending=False)[["tile", "origins"]].itertuples(index=False):
            out.append((*key, tile, at))
            at = int(np.frombuffer(origins, np.int32)[at])
        return pd.DataFrame(out, columns=[*by, "leaves_at"])

    leaves = tiles.select(*by, "origins").groupBy(*keys).applyInPandas(chained, f"{fields}, tile long, leaves_at int")

    def walked(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                x0, last, key = row.tile * size, min(row.n, (row.tile + 1) * size), [getattr(row, k) for k in keys]
                places, found = Places(row.n, row.m, max(0, x0 - 1), last, window), np.frombuffer(row.found, np.int8).reshape(-1, width)
                x = last - 1 if row.leaves_at < width else last
                y = places.at(x) + row.leaves_at % width
                while x > x0 or (x == 0 and y > 0):
                    a, b = steps[found[x - x0 - 1][y - places.at(x)]] if x else steps[-1]
                    x, y = x - a, y - b
                    out.append((*key, x, y, a, b))
            yield pd.DataFrame(out, columns=[*keys, "i", "j", "a", "b"])

    path = tiles.drop("origins").join(leaves, by).select(*keys, "tile", "n", "m", "found", "leaves_at").mapInPandas(walked, f"{fields}, i long, j long, a int, b int")
    on = lambda s, idx, n: [*[F.col(f"g.{k}") == F.col(f"{s}.{k}") for k in keys], F.col(f"g.{idx}") == F.col(f"{s}.idx"), F.col(f"g.{n}") == F.col(f"{s}.steps")]
    scored = path.alias("g").join(left.alias("l"), on("l", "i", "a"), "left").join(right.alias("r"), on("r", "j", "b"), "left")
    both = dot(F.col("l.vector"), F.col("r.vector")) - merge * (F.col("g.a") + F.col("g.b") - 2)
    score = F.when((F.col("g.a") > 0) & (F.col("g.b") > 0), both).otherwise(empty)
    return scored.select(*[F.col(f"g.{k}") for k in keys], "g.i", "g.j", "g.a", "g.b", score.alias("score"))
