import random
import re

from tandem.llm import linededup


def brute(rows, words):
    """Deleted line numbers by row: lines of any run of so many words or more that also stands at an earlier place. Every run is looked at."""
    docs = {}
    for d, t in rows:
        if t is not None:
            docs[(d is None, d or 0, t)] = [(p, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for p, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    first, gone = {}, {k: set() for k in docs}
    for k in sorted(docs):
        for s in range(len(docs[k])):
            total, run = 0, ""
            for p, x, n in docs[k][s:]:
                total, run = total + n, f"{run}\n{x}"
                if total >= words and first.setdefault(run, (k, s)) != (k, s):
                    gone[k].update(q for q, _, _ in docs[k][s:] if q <= p)
    return gone


def check(spark, rows, words=6):
    want = brute(rows, words)
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), words).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None:
            assert r.clean_text is None and r.n_deleted == 0
            continue
        gone = want[(r.doc_id is None, r.doc_id or 0, r.text)]
        assert r.clean_text == "\n".join(x for p, x in enumerate(r.text.split("\n")) if p not in gone), (r.doc_id, gone)
        assert r.n_deleted == len(gone)
        assert r.n_lines == sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in r.text.split("\n"))


def test_against_brute_force(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choice("abcde") * rng.randint(1, 3) for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 7, 8, 20)] + ["", "  "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 12)))) for i in range(120)]
    passage = [f"p{i} q{i} r{i}" for i in range(8)]
    rows += [(200 + i, "\n".join([f"own {i}", *passage[i % 3 : 5 + i % 4], f"end {i}"])) for i in range(12)]
    check(spark, rows)


def test_nulls_copies_long_and_periodic_texts(spark):
    rows = [(1, None), (2, ""), (3, "x y z a b c"), (3, "x y z a b c"), (None, "x y z a b c"), (4, "\n".join(["again and"] * 300)), (5, "w " * 20_000), (6, "w " * 20_000), (0, "k " * 7)]
    check(spark, rows)
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string, clean_text string")).count() == 0


def test_a_tail_that_only_a_later_copy_shares(spark):
    window, tail = "a b c\nd e f", "t"
    rows = [(1, f"{window}\nx1"), (2, f"y\n{window}\n{tail}\nz"), (3, f"{window}\n{tail}\nq"), (4, f"h\n{window}\nx4"), (5, f"h\n{window}")]
    check(spark, rows)
    got = {r.doc_id: r.clean_text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()}
    assert got == {1: f"{window}\nx1", 2: f"y\n{tail}\nz", 3: "q", 4: "h\nx4", 5: ""}


def test_extra_columns_and_blank_lines_within_a_run(spark):
    rows = [(i, "a b c\n\n  \nd e f" + (f"\nown {i}" if i else ""), i, "tk", 7) for i in range(3)]
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, tk string, runs int"), 6)
    assert set(got.columns) == {"doc_id", "text", "n_lines_0", "tk_0", "runs", "n_lines", "n_deleted", "n_words_deleted", "clean_text"}
    assert {r.doc_id: (r.clean_text, r.n_deleted, r.n_words_deleted, r.n_lines) for r in got.collect()} == {0: ("a b c\n\n  \nd e f", 0, 0, 2), 1: ("\n  \nown 1", 2, 6, 3), 2: ("\n  \nown 2", 2, 6, 3)}
