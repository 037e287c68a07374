"""Word differences and phrase conversion against plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions import script
from tandem.operators import diff


def edits_by_hand(a, b):
    """Myers' front in plain Python, one path for each diagonal."""
    paths = {0: (0, [])}
    x, path = paths[0]
    while x < len(a) and x < len(b) and a[x] == b[x]:
        x += 1
    paths[0] = (x, path)
    d = 0
    while True:
        if len(a) - len(b) in paths and paths[len(a) - len(b)][0] == len(a):
            return paths[len(a) - len(b)][1]
        d, new = d + 1, {}
        for k in range(-d, d + 1, 2):
            ins = paths.get(k + 1)
            ins = ins if ins and ins[0] - k <= len(b) else None
            gone = paths.get(k - 1)
            gone = gone if gone and gone[0] + 1 <= len(a) else None
            if not ins and not gone:
                continue
            if ins and (not gone or gone[0] < ins[0]):
                x, path = ins[0], [*ins[1], ("ins", ins[0] - k - 1)]
            else:
                x, path = gone[0] + 1, [*gone[1], ("del", gone[0])]
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            new[k] = x, path
        paths = new


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row2 = [0]
        for j, y in enumerate(b):
            row2.append(row[j] + 1 if x == y else max(row[j + 1], row2[j]))
        row = row2
    return row[-1]


@pytest.mark.parametrize("remembered", [1, 150, 1 << 22])
def test_edits_against_a_plain_front_and_a_common_subsequence(monkeypatch, remembered):
    monkeypatch.setattr(diff, "REMEMBERED", remembered)
    rng = random.Random(remembered)
    for _ in range(300):
        letters = rng.choice([2, 3, 9])
        a, b = ([rng.randrange(letters) for _ in range(rng.randint(0, 18))] for _ in "ab")
        got = diff.Edits(np.array(a, np.int64), np.array(b, np.int64)).script()
        assert got == edits_by_hand(a, b)
        assert len(got) == len(a) + len(b) - 2 * lcs(a, b)


def test_parts_make_both_texts():
    rng, bits = random.Random(4), ["the", " ", "\n", "第", "一", "é", "don't", "。", "\r\n", "\r", "_x1", "　", "!", "😀"]
    for _ in range(300):
        a, b = ("".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in "ab")
        parts = diff.word_parts(a, b)
        assert "".join(p["value"] for p in parts if p["type"] != "ins") == a and "".join(p["value"] for p in parts if p["type"] != "del") == b
        assert all(p["type"] != q["type"] for p, q in zip(parts, parts[1:])) and all(p["value"] for p in parts)
    assert diff.TOKENS.findall("第一話 two\r\nthree-four  x") == ["第", "一", "話", " ", "two", "\r\n", "three", "-", "four", "  ", "x"]
    assert [(p["type"], p["value"]) for p in diff.word_parts("one two three", "one four three five")] == [("same", "one "), ("del", "two"), ("ins", "four"), ("same", " three"), ("ins", " five")]


def test_long_rows_are_fast():
    rng = random.Random(5)
    words = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(20_000)]
    other = [w if rng.random() > 0.01 else "changed" for w in words]
    began = time.time()
    parts = diff.word_parts(" ".join(words), " ".join(other))
    assert time.time() - began < 2 and 300 < sum(p["type"] != "same" for p in parts) < 500


def test_changes_end_at_the_limit(spark):
    a, b = " ".join(f"a{i} x" for i in range(40)), " ".join(f"b{i} x" for i in range(40))
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, None, "  \n"), (4, "", None), (5, "one two", "one three")], "i int, a string, b string")
    got = {r.i: r for r in df.select("i", diff.word_changes(diff.word_diff(F.col("a"), F.col("b"))).alias("c"), diff.summary(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got[1].c == [x for i in range(12) for x in (f"- a{i}", f"+ b{i}")] and got[2].c == got[3].c == got[4].c == [] and got[5].c == ["- two", "+ three"]
    assert got[5].s.endswith("- two\n+ three") and got[2].s == got[4].s


def replaced_by_hand(text, pairs):
    out, i, most = [], 0, max(map(len, pairs))
    while i < len(text):
        n = next((n for n in range(most, 0, -1) if text[i : i + n] in pairs and i + n <= len(text)), 0)
        out.append(pairs[text[i : i + n]] if n else text[i])
        i += n or 1
    return "".join(out)


@pytest.mark.parametrize("block", [1 << 20, 1, 5])
def test_longest_phrases_against_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(script, "BLOCK", block)
    rng = random.Random(6)
    for _ in range(60):
        pairs = {"".join(rng.choice("ab語😀") for _ in range(rng.randint(1, 5))): rng.choice(["", "X", "語a", "long one"]) for _ in range(rng.randint(1, 12))}
        phrases = script.Phrases(pairs)
        for _ in range(20):
            text = "".join(rng.choice("ab語😀c") for _ in range(rng.randint(0, 30)))
            assert phrases.replace(text) == replaced_by_hand(text, pairs), (text, pairs)
    chained = script.chain({"ab": "b", "a": "c"}, {"bb": "語", "c": "d"})
    got = spark.createDataFrame([(1, "abab a"), (2, None), (3, "")], "i int, t string").select("i", chained("t").alias("t")).collect()
    assert {r.i: r.t for r in got} == {1: "語 d", 2: None, 3: ""}


def test_a_large_dictionary_is_fast():
    rng = random.Random(7)
    signs = [chr(c) for c in range(0x4E00, 0x5E00)]
    pairs = {"".join(rng.choice(signs) for _ in range(rng.choice([1, 2, 2, 3, 4, 9]))): rng.choice(signs) for _ in range(200_000)}
    phrases = script.Phrases(pairs)
    known = list(pairs)
    text = "".join(rng.choice(known) if rng.random() < 0.5 else rng.choice(signs) for _ in range(200_000))[:350_000]  # about 1 MB of UTF-8
    began = time.time()
    got = phrases.replace(text)
    assert time.time() - began < 3
    assert got[:1200] == replaced_by_hand(text[:4000], pairs)[:1200]
