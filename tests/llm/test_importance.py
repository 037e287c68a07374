import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np

from tandem.llm import importance

from .helper import same_as_sql

UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def features(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def by_hand(documents, target, n=1, buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text, n)) for texts in ([d[1] for d in documents], target))
    S, B, T = float(sum(s.values())), float(buckets), float(sum(t.values()))  # noqa: N806
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + B) / ((s[b] + 1.0) * (T + B)))) for b in range(buckets)}
    rows = []
    for doc_id, text in documents:
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in features(text, n))
        rows.append([doc_id, len(features(text, n)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r, (_, text) in zip(rows, documents) if len(words(text)) >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((tuple([*r, rank.get(id(r))]) for r in rows), key=repr)


def drawn(n, seed=3):
    rng = random.Random(seed)
    bits = ["The", "fox", "É", "日本", "x1", "\x00", "a-b", "\n", "ſ", "K", "42", "don't", "  ", "İ"] + [f"w{i}" for i in range(60)]
    return [(i, None if i % 37 == 5 else rng.choice([" ", "-", "\t"]).join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_query_and_sql_and_plain_python(spark, tmp_path):
    rows, target = drawn(400), [(str(i), t) for i, t in drawn(30, 4)]
    tables = {"documents": (rows, "doc_id long, text string"), "benchmark": (target, "item_id string, text string")}
    assert same_as_sql(spark, tmp_path, tables, importance.op12_importance_draw, importance.SQL) == 400
    got = importance.op12_importance_draw(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows, [t for _, t in target])
    assert got.where("rank is not null").count() > 10


def test_longer_features_blocks_and_pieces(spark, monkeypatch):
    rows, target = drawn(120, 5), [t for _, t in drawn(20, 6)]
    for block in (1 << 20, 300, 9):
        for n in (1, 2, 4):
            blocks = list(importance.features([t for _, t in rows], n, 500)) if block == 1 << 20 else None
            with monkeypatch.context() as m:
                m.setattr(importance, "BLOCK", block)
                counts, n_words = [Counter() for _ in rows], np.zeros(len(rows), int)
                for lo, size, text, bucket, w in importance.features([t for _, t in rows], n, 500):
                    for i, b in zip(text.tolist(), bucket.tolist()):
                        counts[lo + i][b] += 1
                    if w is not None:
                        n_words[lo : lo + size] += w
            for (_, text), found, w in zip(rows, counts, n_words):
                assert found == Counter(crc32(f.encode()) % 500 for f in features(text, n)) and w == len(words(text))
            assert blocks is None or len(blocks) == n + 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = importance.draw(df, spark.createDataFrame([(t,) for t in target], "text string"), n=3, buckets=700, least=5, percent=50, seed=9)
    assert sorted((tuple(r) for r in got.drop("text").collect()), key=repr) == by_hand(rows, target, 3, 700, 5, 50, 9)


def test_nulls_repeated_rows_clashes_and_empty_tables(spark):
    text = "one two three " * 10
    rows = [(None, text), (None, text), (7, text), (7, text), (7, "other words " * 20), (8, None), (9, "")]
    df = spark.createDataFrame([(*r, 5, "own") for r in rows], "doc_id long, text string, rank int, weight string")
    target = spark.createDataFrame([("one two",)], "text string")
    got = importance.draw(df, target, percent=100)
    assert got.columns == ["doc_id", "text", "rank_0", "weight_0", "n_features", "weight", "score", "rank"]
    found = got.collect()
    assert sorted(r.rank for r in found if r.rank) == [1, 2, 3, 4, 5] and all(r.rank_0 == 5 and r.weight_0 == "own" for r in found)
    assert sorted((tuple([r.doc_id, r.n_features, r.weight, r.score]) for r in found), key=repr) == sorted((x[:4] for x in by_hand(rows, ["one two"], percent=100)), key=repr)
    assert importance.draw(df.limit(0), target).count() == 0
    assert importance.draw(df, target.limit(0)).count() == len(rows)


def test_long_texts_in_bounded_time():
    import time

    for text in ("word " * 1_000_000, "x" * 5_000_000, "- " * 2_000_000, "é " * 1_000_000):
        began = time.time()
        total = sum(len(b) for *_, b, _ in importance.features([text, "a b"], 2, 100))
        n = len(words(text))
        assert total == max(0, 2 * n - 1) + 3 and time.time() - began < 20
