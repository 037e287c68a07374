"""The learnt mapping: sums against numpy, and held-out pairs of an invented language."""

import random

import numpy as np
from pyspark.sql import functions as F

from tandem.plans import compare, crosslingual


def test_sums_and_mapping_against_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(300, 6)), rng.normal(size=(300, 6))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)] + [(None, [0.0] * 6)], "left array<double>, right array<double>").repartition(5)
    got, n = crosslingual.cross_covariance(df)
    assert n == 300 and np.allclose(got, a.T @ b)
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    assert np.allclose(crosslingual.procrustes(a.T @ (a @ turn)), turn)
    assert crosslingual.cross_covariance(df.limit(0))[1] == 0


def books(seed, n):
    """Paragraphs of an invented language beside their translation word by word into another script; some share a number that no other has."""
    rng = random.Random(seed)
    words = ["".join(chr(rng.randrange(0x3042, 0x3092)) for _ in range(rng.randint(2, 4))) for _ in range(150)]
    other = {w: "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(rng.randint(1, 3))) for w in words}
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(6, 14))]
        mark = f" {1000 + i}" if i % 2 else ""
        rows += [(1, "jp", i, "".join(text) + mark), (1, "cn", i, "".join(other[w] for w in text) + mark)]
    return rows


def ranks_first(source, target):
    """Share of source vectors whose partner is the nearest of all."""
    return float((np.argmax(source @ target.T, axis=1) == np.arange(len(source))).mean())


def test_held_out_pairs_find_their_partner(spark):
    df = spark.createDataFrame(books(3, 1600), "book int, lang string, source_index int, text string")
    anchors = crosslingual.anchor_pairs(df, ["book"])
    assert anchors.count() == 800 and anchors.where("source_index <> pivot_index or source_index % 2 = 0").count() == 0
    vectors = compare.embed(df).cache()
    matrix = crosslingual.learn(vectors, anchors, ["book"])
    held = {lang: np.array([r.vector for r in vectors.where((F.col("lang") == lang) & (F.col("source_index") % 2 == 0)).orderBy("source_index").collect()]) for lang in ("jp", "cn")}
    plain, learnt = ranks_first(held["jp"], held["cn"]), ranks_first(held["jp"] @ matrix, held["cn"])
    print("held-out pairs whose partner ranks first:", plain, learnt)
    assert plain < 0.02 and learnt > 0.5
    assert np.allclose(crosslingual.mapped(compare.hashed_ngrams, matrix)(["", "abc"])[1], compare.hashed_ngrams(["abc"])[0] / np.linalg.norm(compare.hashed_ngrams(["abc"])[0]) @ matrix, atol=1e-5)
    assert crosslingual.learn(vectors, anchors.limit(3), ["book"]) is None
    turned = compare.embedded(df, ["book"], "cn", compare.embed.__defaults__[0], lambda x: x, True)
    got = np.array([r.vector for r in turned.where("lang = 'jp' and source_index % 2 = 0").orderBy("source_index").collect()])
    assert ranks_first(got, held["cn"]) == learnt
