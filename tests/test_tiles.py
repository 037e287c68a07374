"""Books in tiles against one pass over the whole book."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tandem.operators import align, tiles
from tandem.plans.compare import kept_in

W = 3


def spans_of(vectors):
    unit = lambda v: v / np.sqrt((v * v).sum()) if (v * v).sum() else v
    rows = [(i, 1, unit(v)) for i, v in enumerate(vectors)] + [(i, 2, unit((a + b) / 2)) for i, (a, b) in enumerate(zip(vectors, vectors[1:]))]
    return pd.DataFrame(rows, columns=["idx", "steps", "vector"])


def by_hand(left, right, window=W):
    """One pass over all places in whole numbers, as the rules say."""
    n, m = int((left.steps == 1).sum()), int((right.steps == 1).sum())
    l, r = ({(int(s), int(i)): v for i, s, v in side.itertuples(index=False)} for side in (left, right))  # noqa: E741
    empty = round(align.VECTOR_EMPTY * tiles.UNIT)
    score = lambda i, j, a, b: int(np.rint(((r[b, j] * l[a, i]).sum() - align.VECTOR_MERGE * (a + b - 2)) * tiles.UNIT)) if a and b else empty
    middle = [int(np.rint(x / max(1, n) * m)) for x in range(n + 1)]
    inside = lambda x, y: x >= 0 and 0 <= y <= m and abs(y - middle[x]) <= window
    best, step = {(0, 0): 0}, {}
    for x in range(n + 1):
        for y in range(m + 1):
            if not inside(x, y):
                continue
            for a, b in align.STEPS:
                if (x - a, y - b) in best and (total := best[x - a, y - b] + score(x - a, y - b, a, b)) > best.get((x, y), tiles.NEVER):
                    best[x, y], step[x, y] = total, (a, b)
    out, x, y = [], n, m
    while x or y:
        a, b = step[x, y]
        x, y = x - a, y - b
        out.append((x, y, a, b))
    return out[::-1]


def drawn(rng, n, m, ties):
    if ties:
        return np.eye(4)[rng.integers(0, 4, n)], np.eye(4)[rng.integers(0, 4, m)]
    return rng.normal(size=(n, 8)), rng.normal(size=(m, 8))


def test_tiles_of_a_book_against_one_pass(spark):
    rng, rows, want = np.random.default_rng(3), {"l": [], "r": []}, {}
    for book, (n, m, ties) in enumerate([(60, 60, True), (61, 44, True), (100, 190, True), (40, 2, True), (90, 91, False), (21, 63, True)]):
        a, b = drawn(rng, n, m, ties)
        left, right = spans_of(a), spans_of(b)
        want[book] = by_hand(left, right)
        for side, spans in (("l", left), ("r", right)):
            rows[side] += [(book, int(i), int(s), v.tolist()) for i, s, v in spans.itertuples(index=False)]
    schema = "book int, idx long, steps int, vector array<double>"
    left, right = (spark.createDataFrame(rows[s], schema) for s in "lr")
    books = tiles.large_books(left.where("steps = 1"), right.where("steps = 1"), ["book"], W, 10)
    assert books.count() == 6
    for size, fan in ((10, 2), (7, 3), (1, 4)):
        got = tiles.cover(left, right, books, ["book"], W, align.VECTOR_EMPTY, align.VECTOR_MERGE, align.STEPS, kept_in(spark), size, fan)
        found = {}
        for r in got.orderBy("book", "i", "j").collect():
            found.setdefault(r.book, []).append((r.i, r.j, r.a, r.b))
        assert found == want, (size, fan)


def test_large_and_small_books_side_by_side(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sides = {s: [(book, i, v.tolist()) for book, n in enumerate(sizes) for i, v in enumerate(rng.normal(size=(n, 8)))] for s, sizes in (("l", (30, 200, 5)), ("r", (31, 190, 0)))}
    left, right = (spark.createDataFrame(sides[s], "book int, idx long, vector array<double>") for s in "lr")
    want = align.align_vectors(left, right, ["book"]).collect()
    monkeypatch.setattr(tiles, "TILE", 50)
    monkeypatch.setattr(tiles.cover, "__defaults__", (50, 3))
    got = align.align_vectors(left, right, ["book"])
    assert sorted(got.collect()) == sorted(want)
    assert got.where("book = 1").agg(F.sum(F.col("left_end") - F.col("left_start"))).first()[0] == 200
