"""The whole pipeline over a small corpus against plain Python, stage by stage."""

import functools
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from tandem.llm import decontaminate, toxicity
from tests.llm.test_decontaminate import brute as hits_of
from tests.llm.test_decontaminate import tokens
from tests.llm.test_jaccard import brute as components_of
from tests.llm.test_mixing import mixed_by_rule, targets
from tests.llm.test_toxicity import corpus


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def tables(spark, path):
    rng, rows = random.Random(8), corpus(150, 8)
    items = [(i, " ".join(rng.choice("abcdefg") + str(rng.randint(0, 99)) for _ in range(n))) for i, n in enumerate((25, 12, 10))]
    texts = [t for _, t, _ in rows]
    texts += [texts[3], texts[3] + " tail", texts[5].replace(" ", "\n", 3), f"before it {items[0][1]} and after", items[1][1], "", None, texts[7] + " " + items[2][1]]
    docs = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, items


def without_hits(text, items):
    """text without the words of windows and what stands between them; None if no other word is left."""
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())]
    w, hit = [text.lower()[a:b] for a, b in spans], set()
    wins = {tuple(x[s : s + 10]) for x in (tokens(t) for _, t in items) for s in range(max(1, len(x) - 9))}
    for s in range(len(w)):
        for n in {len(x) for x in wins}:
            if tuple(w[s : s + n]) in wins:
                hit.update(range(s, s + n))
    if not hit:
        return text
    if len(hit) == len(w):
        return None
    out, last, i = "", 0, 0
    while i < len(w):
        if i in hit:
            j = i
            while j + 1 in hit:
                j += 1
            out, last, i = out + text[last : spans[i][0]], spans[j][1], j
        i += 1
    return out + text[last:]


def test_stages_against_plain_python(spark, tmp_path):
    docs, items = tables(spark, tmp_path)
    got = [docs]
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{i}")
        df = spark.read.parquet(f"{tmp_path}/stage{i}")
        if i < 4:
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append([tuple(r) for r in df.collect()])
    # toxicity: the field itself is checked elsewhere; here its decisions must take effect
    model = toxicity.fit(*toxicity.training_sample(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")))
    scores, _ = model.score([d[1] or "" for d in docs])
    want = [d for d, s in zip(docs, scores) if s < 0.3]
    assert 0 < len(want) < len(docs) and sorted(kept[0], key=str) == sorted(want, key=str)
    first = {d: c for d, _, c in components_of([(d[0], d[1]) for d in want], 5, 80)}
    want = [d for d in want if first[d[0]] == d[0]]
    assert len(want) < len(kept[0]) and sorted(kept[1], key=str) == sorted(want, key=str)
    cut = [(d, None if d[1] is None else without_hits(d[1], items)) for d in want]
    want = [(d[0], t, *d[2:4], len(t or "")) for d, t in cut if t is not None or d[1] is None]
    assert sorted(kept[2], key=str) == sorted(want, key=str) and all(h[2] == 0 for h in hits_of([(d[0], d[1]) for d in want], items))
    sizes, by = defaultdict(int), defaultdict(list)
    for d in want:
        sizes[d[3]] += words(d[1])
        by[d[3]].append(d)
    target, mixed = targets(sizes), []
    for s, x in by.items():
        e = target[s] / sizes[s]
        u = int(hashlib.md5(f"17:{'s' + s if s is not None else 'null'}".encode()).hexdigest()[:8], 16) / 2**32
        for pos, d in enumerate(sorted(x, key=lambda d: (words(d[1]), d[0]))):
            mixed += [d] * (math.floor((pos + 1) * e + u) - math.floor(pos * e + u))
    assert sorted(kept[3], key=str) == sorted(mixed, key=str)
    assert sorted((r[:5] for r in kept[4]), key=str) == sorted(mixed, key=str)
    slots = defaultdict(list)
    for r in kept[4]:
        slots[r[7]].append(r[8])
    assert set(slots) <= set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in again), key=str) == sorted(kept[4], key=str)


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("bcdfgaeiou", k=6)) for _ in range(rng.randint(20, 60) if i < 20 else 41 + i)) for i in range(30)]  # rows without an id differ in size
    docs = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts[:20])]
    others = [(None, t, "en", "s1", len(t)) for t in texts[20:]]
    rows = docs + others + docs[3:6] * 2 + others[:2] * 2  # repeated
    rows += [(None, texts[8], "en", "s0", 1), (9, texts[9] + " tail", "en", "s1", 1), (11, "another text of the same id entirely", "en", "s1", 36)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.near_copies(spark, df, str(tmp_path)).collect()]
    nine = [r for r in kept if r[0] == 9]
    assert len(nine) == 1 and nine[0] in rows
    assert sorted((r for r in kept if r[0] != 9), key=str) == sorted([d for d in docs if d[0] != 9] + others + rows[-1:], key=str)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(tuple(r)[:4] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = mixed_by_rule([(d, t, s) for d, t, _, s, _ in kept])
    assert got == Counter({(d, t, "en", s): n for (d, t, s), n in want.items()})


def test_stages_keep_columns_named_like_added_ones(spark, tmp_path, monkeypatch):
    rows = [(1, "a b c d e f g h i j and k", 99, "mine", "x", "y", 0.5, 7, "z", 8), (2, "none of it", 10, "too", None, "y", 1.5, 8, "z", 9)]
    names = ["doc_id", "text", "n_chars", "items", "score_0", "hit_spans", "score", "predicted", "toxic_spans", "n_words"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, items string, score_0 string, hit_spans string, score double, predicted int, toxic_spans string, n_words int")
    spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "k")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.toxicity_filter(spark, docs, str(tmp_path))
    assert out.columns == names and out.dtypes == docs.dtypes and sorted(map(tuple, out.collect())) == rows
    want = [(1, " and ", 5, *rows[0][3:]), rows[1]]
    whole = decontaminate.find_hits
    for bytes_ in (1 << 20, 8):
        monkeypatch.setattr(decontaminate, "find_hits", functools.partial(whole, block_bytes=bytes_))
        out = corpus_pipeline.benchmark_cut(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes and sorted(map(tuple, out.collect())) == want
