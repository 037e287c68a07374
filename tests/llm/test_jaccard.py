import random
import re

import pytest

from tandem.llm import jaccard
from tandem.llm.common import Workspace
from tandem.llm.components import connected_components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets, root = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    return sorted(out, key=str)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_components_against_brute_force(spark, k, percent):
    rng = random.Random(k)
    word = lambda: rng.choice(["Aa", "b", "ç", "dd", "e", "FF", "g"]) + str(rng.randint(0, 60))
    passage = [word() for _ in range(40)]
    texts = []
    for n in [1, 2, 3, 4, 6, 9, 10, 12, 14, 19, 20, 21, 24, 30, 45, 80, 150, 400]:
        base = [word() for _ in range(n)]
        for _ in range(6):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(t)) if t else 0
                t[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            texts.append(" ".join(t))
    texts += [" ".join([*passage, *[word() for _ in range(30)]]) for _ in range(40)] + [None, "", "  ", "x", "X"]
    texts += [" ".join(passage[:i] + ["q"] + passage[i + 1 :]) for i in range(0, 40, 3)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    rows += [(None, texts[3]), (None, "alone here now with words")] + rows[:3]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k, percent, columns=["doc_id"]).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, percent)


def test_frequent_shingles_do_not_change_results(spark):
    rows = [(i, " ".join([f"c{j}" for j in range(60)] + [f"own{i}w{j}" for j in range(i % 7)])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 90)
    for most in (0, 10, 1000):
        got = jaccard.join(df, 3, 90, max_hot=most, columns=["doc_id"]).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_boundary_and_empty(spark):
    assert 9 <= jaccard.light_boundary(90, 1.2) <= 40
    for percent in (80, 90):  # a link's overlap is among the subset sizes of both sets
        for a in range(1, 30):
            for b in range(a, 30):
                if 100 * a >= percent * b:
                    c = jaccard.overlap(a, b, percent)
                    if c <= a:
                        assert c in jaccard.subset_sizes(a, percent) and c in jaccard.subset_sizes(b, percent)
    out = jaccard.join(spark.createDataFrame([], "doc_id long, text string, node string"), columns=None)
    assert out.count() == 0 and "node_0" in out.columns


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    label = {n: n for e in edges for n in e if n is not None and e[0] != e[1] and None not in e}
    for _ in range(100):
        for a, b in edges:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " and a tail"), (3, "x" * 1_000_000), (4, "x" * 1_000_000), (5, "y " * 300_000), (None, "y " * 290_000), (6, None)]
    df = spark.createDataFrame([(*r, "n", 7) for r in rows], "doc_id long, text string, node string, n_shingles int")
    got = {r.doc_id: r for r in jaccard.join(df).collect()}
    assert {d: r.component_id for d, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, None: 5, 6: 6}
    assert {"node_0", "n_shingles_0"} <= set(got[1].asDict()) and got[5].n_shingles == got[3].n_shingles == 1


def test_a_group_of_many_near_copies_is_dealt_in_slices(spark, monkeypatch):
    import tandem.llm.common as common

    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):  # one large group of near copies, and others that share its beginning but nothing else
        words = list(base)
        words[rng.randrange(20, 120)] = f"z{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:9] + [f"o{i}x{j}" for j in range(30)])) for i in range(40)]
    want = brute(rows, 3, 90)
    for module in (common, jaccard):
        monkeypatch.setattr(module, "HEAVY", 8)
    monkeypatch.setattr(jaccard, "SLICE", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.join(df).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == want
