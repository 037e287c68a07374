"""What is worked out for many texts or gaps at once gives what is worked out for one; the work in Python does not go character by character."""

import random
import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tandem.functions import hashing, points
from tandem.functions import text as T
from tandem.operators import align, covers, rows
from tandem.plans import compare

ALPHABET = "ab cdeé中𠮷文ΣÿĀ\x00"


def texts(rng, n, longest=40):
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 0, 1, 1, 2, 3, longest]))) for _ in range(n)]


def grams(t):
    return {t[k : k + 2] for k in range(len(t) - 1)} if len(t) != 1 else {t}


def calls(f) -> int:
    """Calls that Python makes while f runs."""
    seen = [0]

    def count(frame, event, arg):
        seen[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return seen[0]


def test_default_encoder_goes_by_texts_and_not_by_characters(monkeypatch):
    def brute(given, dimensions):
        out = np.zeros((len(given), dimensions), np.float32)
        for i, t in enumerate(given):
            t = t.lower()
            for n in (1, 2, 3):
                for k in range(len(t) - n + 1):
                    h = zlib.crc32(t[k : k + n].encode())
                    out[i, h % dimensions] += 1.0 if h >> 31 else -1.0
        return out

    given = texts(random.Random(1), 300) + ["x" * 420]
    for dimensions in (256, 7):
        assert (compare.hashed_ngrams(given, dimensions) == brute(given, dimensions)).all()
    monkeypatch.setattr(points, "PIECE", 50)
    assert (compare.hashed_ngrams(given, 64) == brute(given, 64)).all()
    monkeypatch.undo()
    assert compare.hashed_ngrams([]).shape == (0, compare.DIMENSIONS)
    long = ["some words of a paragraph " * 16] * 50
    assert calls(lambda: compare.hashed_ngrams(long)) < 20 * len(long)  # 62,250 n-grams, each hashed by calls of its own before


def test_covers_side_by_side_are_those_of_one_gap(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(covers, "CELLS", 2000)
    for trial in range(12):
        band, half, empty = int(rng.choice([1, 2, 8, 60])), bool(rng.integers(2)), (-0.22, -0.26, -0.25, 0.0)[trial % 4]
        sizes = [(int(rng.integers(1, rng.choice([3, 12]))), int(rng.integers(1, rng.choice([3, 12, 40])))) for _ in range(25)]
        tables = [{(a, b): rng.uniform(-0.3, 1, (n - a + 1, m - b + 1)) for a, b in align.STEPS if a and b and n >= a and m >= b} for n, m in sizes]
        if trial % 3 == 0:  # ties
            tables = [{k: np.round(v * 4) / 4 for k, v in t.items()} for t in tables]
        got = sorted(zip(*(x.tolist() for x in covers.best(sizes, tables, band, empty, half))))
        want = [(g, *step) for g, ((n, m), t) in enumerate(zip(sizes, tables)) for step in align.Band(n, m, band, empty, lambda i, a, b, lo, hi: t[a, b][i, lo:hi], half).path()]  # noqa: B023
        assert got == sorted(want)


def sides_of(rng, sizes):
    """Tables (k, idx, normal, empty) of gaps, rows in any order."""
    out = [(k, i, t, t == "") for k, n in sizes for i, t in enumerate(texts(rng, n, 12))]
    rng.shuffle(out)
    return pa.table({"k": pa.array([r[0] for r in out], pa.int64()), "idx": pa.array([r[1] for r in out], pa.int32()), "normal": pa.array([r[2] for r in out], pa.string()), "empty": pa.array([r[3] for r in out], pa.bool_())})


@pytest.mark.parametrize("whole, small, together", [(1 << 22, 1 << 14, 1 << 20), (200, 1 << 14, 300), (1 << 22, 20, 1)])
def test_small_gaps_need_no_band_of_their_own(monkeypatch, whole, small, together):
    rng = random.Random(7)
    left, right = sides_of(rng, [(k, rng.randint(0, 9)) for k in range(40)] + [(99, 30)]), sides_of(rng, [(k, rng.randint(0, 9)) for k in range(5, 45)] + [(99, 26)])
    want = []
    spans = {}
    for s, side in enumerate((left, right)):
        for k, g in side.to_pandas().sort_values("idx").groupby("k"):
            t, e = g.normal.tolist(), g["empty"].tolist()
            two = [a + b for a, b in zip(t, t[1:])]
            spans[s, k] = pd.DataFrame({"idx": [*range(len(t)), *range(len(two))], "steps": [1] * len(t) + [2] * len(two), "normal": t + two, "empty": e + [a and b for a, b in zip(e, e[1:])]})
    for k in {k for _, k in spans}:
        l, r = spans.get((0, k)), spans.get((1, k))  # noqa: E741
        n, m = (0 if x is None else int((x.steps == 1).sum()) for x in (l, r))
        path = align.Band(n, m, align.BAND, align.EMPTY, align.text_scorer(l, r)).path() if n and m else [(i, 0, 1, 0, align.EMPTY) for i in range(n)] + [(0, j, 0, 1, align.EMPTY) for j in range(m)]
        want += [(k, *step) for step in path]
    monkeypatch.setattr(align, "WHOLE", whole)
    monkeypatch.setattr(align, "SMALL", small)
    monkeypatch.setattr(align, "TOGETHER", together)
    if whole == 1 << 22 and small == 1 << 14:
        monkeypatch.setattr(align, "Band", None)  # 45 gaps took a Band each before
    got = align._text_cover(["k"], align.BAND, align.EMPTY, False)(left, right)
    assert sorted(tuple(r.values()) for r in got.to_pylist()) == sorted(want)


def test_vectors_are_sent_alone_and_neighbours_made_in_the_task(spark):
    rng = np.random.default_rng(5)
    data = [(k, s, i, rng.integers(-2, 3, 6).astype(float).tolist()) for k in range(6) for s in (0, 1) for i in range(int(rng.integers(0, 7)))]
    df = spark.createDataFrame(data, "k int, s int, idx int, vector array<float>")
    left, right = (df.where(F.col("s") == s).drop("s") for s in (0, 1))
    want = []
    one, two = (align.vector_spans(x, ["k"]).toPandas() for x in (left, right))
    for k in range(6):
        sides = [{int(s): np.stack(p.sort_values("idx").vector.to_list()) for s, p in x[x.k == k].groupby("steps")} for x in (one, two)]
        n, m = (len(s.get(1, [])) for s in sides)
        score = lambda i, a, b, lo, hi: (sides[1][b][lo:hi] * sides[0][a][i]).sum(axis=1) - align.VECTOR_MERGE * (a + b - 2)  # noqa: B023, E731
        path = align.Band(n, m, align.VECTOR_WINDOW, align.VECTOR_EMPTY, score, True).path() if n and m else [(i, 0, 1, 0, align.VECTOR_EMPTY) for i in range(n)] + [(0, j, 0, 1, align.VECTOR_EMPTY) for j in range(m)]
        want += [(k, i, i + a, j, j + b, pytest.approx(s, abs=6e-5)) for i, j, a, b, s in path]
    found = align.align_vectors(left, right, ["k"])
    got = sorted(tuple(r)[:6] for r in found.collect())
    assert got == sorted(want, key=lambda r: r[:5])
    assert "steps" not in found._jdf.queryExecution().toString()  # before, items and neighbours were dealt as rows of doubles


def test_anchors_from_both_sides(spark):
    """Pairs best from one side within a stretch hold all that are best from both."""
    rng = random.Random(2)
    base = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(14)) for _ in range(90)]
    data = [(0, i, t) for i, t in enumerate(base)] + [(1, i, t) for i, t in enumerate(base[:20] + base[23:60] + base[20:23] + base[60:] + base[10:12] + ["短"])]
    df = spark.createDataFrame(data, "s int, idx int, text string").withColumn("k", F.lit("b"))
    left, right = (df.where(F.col("s") == s).drop("s") for s in (0, 1))
    f = [align.features(x, align.generic) for x in (left, right)]
    pairs = align.band_candidates(*f, ["k"], align.RADIUS, align.pair_score("l", "r").alias("score"), ((F.col("l.size") >= 10) & (F.col("r.size") >= 10)).alias("_long"))
    want = align.increasing(align.mutual_best(pairs, ["k"]).where("_long and score >= 0.34").drop("_long"), ["k"])
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, align.local_anchors(left, right, ["k"], align.generic).collect()))


def test_scores_and_signatures_of_rows(spark, monkeypatch):
    rng = random.Random(4)
    a, b = texts(rng, 60), texts(rng, 60)
    a[0] = b[0] = "x" * 3000
    df = spark.createDataFrame([(i, x, y if i % 5 else x) for i, (x, y) in enumerate(zip(a, b))] + [(900, None, "q")], "i int, a string, b string")
    empty = T.text_of("a") == ""
    plain = T.paragraph_score(T.bigrams(F.col("a")), T.bigrams(F.col("b")), F.length(T.text_of("a")), F.length("b"), empty)
    row = df.select(T.row_score(T.text_of("a"), F.col("b"), empty).alias("s"), plain.alias("p"), hashing.row_signature("a", "b", F.lit(""), F.lit(None), F.col("a")).alias("h"), hashing.short_hash(F.concat_ws("\x1f", T.text_of("a"), "b", F.lit(""), F.lit(""), T.text_of("a"))).alias("w")).collect()
    assert all(r.s == r.p and r.h == r.w for r in row)
    monkeypatch.setattr(points, "BESIDE", 5)
    brute = lambda t: __import__("functools").reduce(lambda h, u: (h ^ u) * hashing.PRIME & 0xFFFFFFFF, memoryview(t.encode("utf-16-le")).cast("H"), hashing.OFFSET)
    assert points.fnv_1a(a, hashing.OFFSET, hashing.PRIME).tolist() == [brute(t) for t in a]


def test_rows_that_can_not_be_refined_are_told_before_they_are_cut(spark, monkeypatch):
    cut = []
    own = rows.segment.fragments
    monkeypatch.setattr(rows.segment, "fragments", lambda items, keys: cut.append(items) or own(items, keys))
    kinds = {0: ("一句。二句。", "三！四八九十百千万一二三四五六七"), 1: ("没", "也许这里都不见了吧"), 2: ("一。二。", "三")}
    paragraphs = spark.createDataFrame([(p, s, 0, "正文", t, t, len(t)) for p, (cn, tw) in kinds.items() for s, t in (("jp", "原文"), ("cn", cn), ("tw", tw))], "project int, lang string, source_index int, chapter string, text string, cn_text string, chars int")
    groups = align.relation(spark.createDataFrame([(p, 0, 1, 0, 1, 0.5) for p in kinds], "project int, left_start long, left_end long, right_start long, right_end long, score double"))
    found = rows.compare_rows(paragraphs, groups, groups, ["project"], normal=align.generic)
    assert found.count() == 3
    assert {r.project for r in cut[0].select("project").collect()} == {0, 2}  # all three before
