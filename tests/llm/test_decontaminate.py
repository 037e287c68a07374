import functools
import random
import re

import numpy as np

import corpus_pipeline
from tandem.llm import decontaminate


def tokens(text):
    return [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = tokens(t)
        for s in range(max(1, len(w) - window + 1) if w and i is not None else 0):
            wins.setdefault(tuple(w[s : s + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = tokens(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[x]
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


def data():
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "Étoile", "ab", "c7", "x"]) + rng.choice(["", "s", "ing"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 10, 12, 25])))) for i in range(20)] + [(30, None), (31, "..."), (None, "the of"), (5, "word again here")]
    docs = [(i, " ".join([*[word() for _ in range(rng.randint(0, 30))], *(items[rng.randrange(20)][1] or "").split(), *[f"zz{j}" for j in range(rng.randint(0, 9))]]) + rng.choice(["", "!", "-x"])) for i in range(60)]
    return docs + [(100, None), (101, ""), (100, docs[0][1]), (None, docs[1][1]), (102, (items[4][1] + " ") * 300)], items


def test_against_brute_force(spark):
    docs, items = data()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for args in ({}, {"shard_words": 64}, {"block_bytes": 300}):
        got = decontaminate.find_hits(d, b, **args).collect()
        assert sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.hit_spans), ",".join(sorted(r["items"]))) for r in got), key=str) == want, args
    assert decontaminate.find_hits(d.limit(0), b).count() == 0
    assert {r.n_words > 0 and len(r.hit_spans) for r in decontaminate.find_hits(d, b.limit(0)).collect()} <= {0, False}
    assert "items_0" in decontaminate.find_hits(d.withColumnRenamed("doc_id", "items"), b).columns


def test_removal_leaves_no_window(spark):
    docs, items = data()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([i for i in items if len(tokens(i[1])) >= 10], "item_id long, text string")
    cut = decontaminate.find_hits(d, b, remove=True)
    rows = [(r.doc_id, r.text) for r in cut.collect()]
    assert all(hit == 0 for _, _, hit, _ in brute(rows, [i for i in items if len(tokens(i[1])) >= 10]))
    clean = {t for (i, t), w in zip(sorted(docs, key=str), brute(docs, items)) if w[2] == 0}
    assert clean <= {t for _, t in rows}


def test_removal_over_several_blocks(spark, tmp_path, monkeypatch):
    docs, items = data()
    d = spark.createDataFrame([(i, t, len(t or "")) for i, t in docs], "doc_id long, text string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    b = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    blocks = list(decontaminate.benchmark_blocks(b, 300))
    known = [(str(i), t.encode()) for i, t in items if i is not None and t is not None]
    assert len(blocks) > 2 and sorted(r for x in blocks for r in x) == sorted(known)
    assert all(sum(len(t) for _, t in x) <= 300 + max(len(t) for _, t in known) for x in blocks)
    plain = lambda df: sorted((str((r.doc_id, r.text, r.n_words, r.hit_spans, sorted(r["items"]))) for r in df.collect()))
    assert plain(decontaminate.find_hits(d, b, block_bytes=300, remove=True)) == plain(decontaminate.find_hits(d, b, remove=True))
    want = sorted((tuple(r) for r in corpus_pipeline.benchmark_cut(spark, d, str(tmp_path)).collect()), key=str)
    monkeypatch.setattr(decontaminate, "find_hits", functools.partial(decontaminate.find_hits, block_bytes=300))
    assert sorted((tuple(r) for r in corpus_pipeline.benchmark_cut(spark, d, str(tmp_path)).collect()), key=str) == want


def test_index_finds_all_places():
    rng = np.random.default_rng(1)
    runs = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(30)]
    text = np.concatenate([np.append(r, 0) for r in runs])
    index = decontaminate.FMIndex(text, 4)
    for n in (1, 2, 5):
        windows = rng.integers(1, 5, (20, n))
        which, places = index.find(windows.ravel(), np.arange(20) * n, n)
        got = sorted(zip(which.tolist(), places.tolist()))
        assert got == sorted((w, p) for w in range(20) for p in range(len(text) - n + 1) if (text[p : p + n] == windows[w]).all())


def test_windows_are_distinct_and_keep_all_owners():
    items = [("a", b"x y z"), ("b", b"x y z"), ("c", b" ".join(b"w%d" % (i % 13) for i in range(60))), ("d", b"q"), ("a", b"q"), ("e", b"")]
    p = decontaminate.Phrases(items, 10)
    word = {n: w for w, n in p.alphabet.items()}
    got = {n: {tuple(word[x] for x in p.words[s : s + n]): {p.ids[o] for o in p.owners_of(n, i)} for i, s in enumerate(p.starts[n])} for n in p.lengths}
    c = items[2][1].split()
    assert got == {1: {(b"q",): {"a", "d"}}, 3: {(b"x", b"y", b"z"): {"a", "b"}}, 10: {tuple(c[i : i + 10]): {"c"} for i in range(51)}}
    assert len(p.starts[10]) == 13
