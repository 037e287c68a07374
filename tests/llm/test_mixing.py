import hashlib
import math
import re
from collections import Counter, defaultdict

from tandem.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """By the rule's words: share by weight, cap, share what is left again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        per = left / sum(w[s] for s in free)
        over = {s for s in free if per * w[s] > most * sizes[s] + 1e-9}
        if not over:
            return fixed | {s: per * w[s] for s in free}
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]
        free -= over
    return fixed


def test_targets_and_taken(spark):
    rows = [(i, " ".join("w" * (i % 3 + 1) for _ in range(i * 7 % 23)) if i % 11 else None, [None, "b", "a", "ü", "big", "big", "big"][i % 7], "x") for i in range(300)] + [(7, "a b c", "a", "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == len(rows) and sorted(plan, key=str) == sorted(mixing.mix_plan(df).collect(), key=str)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, largest = defaultdict(int), defaultdict(int)
    for _, t, s, _ in rows:
        total[s] += size(t)
        largest[s] = max(largest[s], size(t))
    want, got = targets(total), defaultdict(int)
    for r in plan:
        assert r.source_size == total[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken <= 2 * r.size and r.taken == r.copies * r.size
        got[r.source] += r.taken
    assert all(abs(got[s] - want[s]) <= 2 * largest[s] for s in total)
    mixed = mixing.mix(df.dropDuplicates(["doc_id"]))
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in mixing.mix_plan(df.dropDuplicates(["doc_id"])).collect())
    assert mixing.mix_plan(df.limit(0)).count() == 0


def mixed_by_rule(rows):
    """rows (doc_id, text, source) as often as the rule says; rows that tie in size and doc_id must be equal or take the same."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by, out = defaultdict(list), Counter()
    for r in rows:
        by[r[2]].append(r)
    sizes = {s: sum(size(r[1]) for r in x) for s, x in by.items()}
    target = targets(sizes)
    for s, x in by.items():
        e = target[s] / sizes[s]
        u = int(hashlib.md5(f"17:{'s' + s if s is not None else 'null'}".encode()).hexdigest()[:8], 16) / 2**32
        for pos, r in enumerate(sorted(x, key=lambda r: (size(r[1]), r[0] is None, r[0] or 0))):
            out[r] += math.floor((pos + 1) * e + u) - math.floor(pos * e + u)
    return +out


def test_mix_of_repeated_rows_and_null_ids(spark):
    rows = [(i, " ".join("w" * (i + 1)), "ab"[i % 2]) for i in range(40)] + [(5, " ".join("w" * 6), "b")] * 4
    rows += [(None, " ".join("n" * (i + 1)), "ab"[i % 2]) for i in range(40)] + [(None, "same text here", None)] * 3 + [(7, "other text of the same id " * 9, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert Counter(tuple(r) for r in mixing.mix(df).collect()) == mixed_by_rule(rows)


def test_very_long_texts_and_clashing_columns(spark):
    rows = [(1, "w " * 1_000_000, "a", 5), (2, "x" * 1_000_000, "a", 5), (3, "one two", "a", 5), (4, "", "b", 5), (None, None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    plan = {r.doc_id: r for r in mixing.mix_plan(df).collect()}
    assert {d: r["size"] for d, r in plan.items()} == {1: 1_000_000, 2: 1, 3: 2, 4: 0, None: 0} and all(r.taken <= 2 * r["size"] for r in plan.values())
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and {r.target for r in mixed.collect()} <= {5}


def test_columns_named_like_the_row_numbers_keep_their_values(spark):
    rows = [(i, " ".join("w" * (i + 1)), "ab"[i % 2], 10 * i, 3, 4) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_row int, _mix_copies int, _mix_copy int")
    got = mixing.mix(df)
    assert got.columns == df.columns and all(r._mix_row == 10 * r.doc_id and r._mix_copies == 3 and r._mix_copy == 4 for r in got.collect())
