import random
import re
from collections import Counter

from tandem.llm import divergence


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_counts_against_brute_force(spark):
    texts = [None, "", "   ", "a", "a b c a b c", "x\nx\n\n y\nx", "a a a a a", "é#*$ 𠮷| b\x1c c", "one two three " * 40, " ".join(f"w{i % 7}" for i in range(3000)), "z" * 50_000]
    rows = [(i, t, ["en", "de", None, "xx"][i % 4]) for i, t in enumerate(texts)] + [(0, None, "en")]
    got = divergence.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (r, want)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_far_texts_go_and_clean_ones_stay(spark):
    rng = random.Random(1)
    clean = [(i, " ".join(rng.choice(["the", "of", "and", "to", "in", "".join(rng.choices("abcdefghij", k=6))]) if rng.random() < 0.6 else "".join(rng.choices("klmnorstu", k=5)) for _ in range(300)), "en") for i in range(60)]
    junk = [(100, " ".join(f"%{j}$#&" for j in range(300)), "en")]
    got = {r.doc_id: r for r in divergence.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert not got[100].kept and not got[100].base_failed
    assert all(got[i].kept for i, _, _ in clean)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, kept string")
    out = divergence.judge(empty)
    assert out.count() == 0 and "kept_0" in out.columns
