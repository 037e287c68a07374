"""Behaviour of the operators on small inputs; expected values are those of FIXTURES.md or of brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions import decisions, hashing, script
from tandem.functions import text as T
from tandem.operators import align, browse, context, diff, notes, prefilter, rows, segment
from tandem.plans import compare, sinks, store
from tandem.sources import epub, markup, plain
from tandem.streaming import results


def one(spark, column, **values):
    """The column's value over one row of the given values."""
    names = list(values) or ["x"]
    df = spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{n} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values.values() or [""])))
    return df.select(column.alias("v")).first().v


BOM, ZWSP, IDEOGRAPHIC = chr(0xFEFF), chr(0x200B), chr(0x3000)


def test_normal_forms(spark):
    assert one(spark, T.canonical("t"), t=f"{BOM} ３{ZWSP} ") == "3"
    assert one(spark, T.canonical("t"), t=None) == ""
    assert one(spark, T.text_length("t"), t=f"a b{IDEOGRAPHIC}𠮷") == 3
    assert one(spark, T.utf16_length("t"), t="𠮷a") == 3
    assert sorted(one(spark, T.bigrams(F.col("t")), t="abab")) == ["ab", "ba"]
    assert one(spark, T.bigrams(F.col("t")), t="") == [] and one(spark, T.bigrams(F.col("t")), t="x") == ["x"]
    assert one(spark, T.jaccard(T.bigrams(F.col("a")), T.bigrams(F.col("b"))), a="", b="") == 1.0
    assert one(spark, T.jaccard(T.bigrams(F.col("a")), T.bigrams(F.col("b"))), a="abc", b="abd") == pytest.approx(1 / 3)
    assert one(spark, T.comparable_units("t"), t="一。二！」 三") == ["一。", "二！」", "三"]
    assert one(spark, T.protected_tokens(T.canonical("t")), t="第3章 AB") == ["3", "ab"]
    assert one(spark, T.document_text("t"), t=f"{BOM}a \r\n\r\n\r\n\r\n  b ") == "a\n\nb"
    assert one(spark, T.percent_ratio("t"), t="92%") == 0.92 and one(spark, T.percent_ratio("t"), t="x") == 0.92 and one(spark, T.percent_ratio("t"), t="30") == 0.5
    assert one(spark, T.format_percent_ratio("t"), t="0.925") == "92.5%" and one(spark, T.format_percent_ratio("t"), t="1") == "100%"
    assert one(spark, T.clamp_integer("n", 1, 12, 3), n=99) == 12 and one(spark, T.clamp_number("t", 0.5, 1, 0.92), t=None) == 0.5 and one(spark, T.clamp_number("t", 0.5, 1, 0.92), t="x") == 0.92


def test_texts_that_skip_compatibility_forms(spark):
    """No character of the first two blocks that is taken as stable changes, alone or beside others."""
    import re
    import unicodedata

    stable = "".join(c for c in map(chr, range(256)) if not re.search(T.UNSTABLE, c))
    assert len(stable) > 200 and unicodedata.normalize("NFKC", stable) == stable and all(unicodedata.normalize("NFKC", a + b) == a + b for a in stable for b in stable)
    texts = ["ﬁ", "é", "e" + chr(0x301), "½", "Ａ", "a", chr(0xA0) + "x", "ö·©", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.c for r in df.select("i", T.canonical("t").alias("c")).orderBy("i").collect()] == ["fi", "é", "é", "1⁄2", "a", "a", "x", "ö·©", ""]


def test_common_ends(spark):
    rng = random.Random(3)
    rows_ = [(i, "".join(rng.choice("aé𠮷") for _ in range(rng.randint(0, 9))), "".join(rng.choice("aé𠮷") for _ in range(rng.randint(0, 9)))) for i in range(150)] + [(900, "x" * 70_000 + "y", "x" * 70_000 + "z"), (901, "", ""), (902, None, "q")]
    for r in spark.createDataFrame(rows_, "i int, a string, b string").select("a", "b", diff.prefix_suffix(F.col("a"), F.col("b")).alias("p")).collect():
        a, b = r.a or "", r.b or ""
        h = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        t = next((k for k in range(min(len(a), len(b)) - h) if a[-1 - k] != b[-1 - k]), min(len(a), len(b)) - h)
        want = [("same", a[:h]), ("del", a[h : len(a) - t]), ("ins", b[h : len(b) - t]), ("same", a[len(a) - t :])]
        assert [(x["type"], x["value"]) for x in r.p] == [w for w in want if w[1]]


def test_hashes(spark):
    assert one(spark, hashing.short_hash("t"), t="abc") == "7aigaz"

    def fnv(text):
        h = 2166136261
        data = text.encode("utf-16-le")
        for i in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
        out = ""
        while h:
            h, r = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        return out

    for t in ("", "é𠮷z", "中文"):
        assert one(spark, hashing.short_hash("t"), t=t) == fnv(t)


def test_script(spark):
    assert one(spark, script.to_cn("t"), t="第一話") == "第一话"
    assert one(spark, script.to_target_script("t", F.lit("tw")), t=" 话 ") == "話"
    assert one(spark, script.converter({"電腦": "电脑", "電": "电", "x": "y"})("t"), t="電腦電x") == "电脑电y"


PROSE = "今天天气很好我们一起去公园散步看到了许多美丽的花朵和可爱的小鸟大家都非常开心"


def test_classification(spark):
    cases = [
        ("３", "3", "３", 0.28, "rule-equivalent"), ("4", "３", "3", 1.0, "structured-conflict"), ("4", "3", "4", 0.0, "structured-conflict"), ("本文", "", "", 0.0, "rule-empty"), ("", "哇！", "哇。", 1.0, None),
        ("", PROSE + "第3章节", PROSE + "第4章节", 1.0, None), ("", PROSE + "甲", PROSE + "乙", 0.96, "similarity"), ("", None, None, 0.0, "rule-empty"),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "index int, source string, left string, right string, score double")
    got = {r["index"]: r.kind for r in prefilter.classify(df).collect()}
    assert [got[i] for i in range(len(cases))] == [c[4] for c in cases]


def test_prefilter_results_and_counters(spark):
    df = spark.createDataFrame([(i, f"行{i}的正文", f"行{i}的正文", "", "s") for i in range(10)], "index int, jp string, cn string, tw_cn string, signature string").withColumn("score", F.lit(1.0))
    log = prefilter.results(prefilter.classify(prefilter.sides(df, "bilingual")), mode="bilingual")
    assert all(r.note.startswith("[规则预筛]") and r.done and r.status == "rule-prefilter" for r in log.collect())
    c = prefilter.counters(log).first()
    assert (c.processed, c.handled, c.rule_prefiltered, c.model_processed) == (10, 10, 10, 0)
    assert prefilter.pending(df, log).count() == 0


def test_chapters_and_slices(spark):
    docs = spark.createDataFrame([("p", "jp", "第一話\n\n本文です。\n\n第二話 別の事件\n\n続きです。"), ("p", "cn", "第一话\n\n这是正文。\n\n[图片]\n\n***\n\n第2话 后续\n\n这是后续。")], "project string, lang string, text string")
    got = [(r.lang, r.source_index, r.chapter, r.text, r.chars) for r in segment.paragraphs(docs, ["project"]).orderBy("lang", "source_index").collect()]
    assert got == [("cn", 0, "第一话", "这是正文。", 5), ("cn", 1, "第2话 后续", "这是后续。", 5), ("jp", 0, "第一話", "本文です。", 5), ("jp", 1, "第二話 別の事件", "続きです。", 5)]
    body = "これは十分に長い本文の段落です。物語はここから始まります。"
    text = "\n\n".join(["目次", "第一話", body, "あとがき", "作者の言葉。", "第一話 新作", body, "あとがき", "おしまい。"])
    out = segment.slice_document(spark.createDataFrame([("p", "jp", text)], "project string, lang string, text string"), ["project"]).first().text
    assert out.startswith(body) and out.count(body) == 2 and "おしまい" not in out and out.rstrip().endswith(body)
    ranges = segment.block_ranges(spark.createDataFrame([(1, "a\n\nbc\n \n\n\nd")], "id int, text string")).orderBy("block").collect()
    assert [(r.start, r.end, r.block_text) for r in ranges] == [(0, 1, "a"), (3, 5, "bc"), (10, 11, "d")]
    assert one(spark, segment.slice_main(F.col("t"), "S", ["E", "X"]), t="aSbXcE") == "Sb"
    with pytest.raises(Exception, match="Cannot find start marker"):
        one(spark, segment.slice_main(F.col("t"), "S", ["E"]), t="abc")


def test_markup(spark):
    ref = '<a epub:type="noteref" href="#n1">㊟</a>'
    assert one(spark, markup.html_text(F.col("t")), t=f"<p>before {ref} after</p>") == f"before {ref} after"
    assert one(spark, markup.html_text(F.col("t"), {"noteref": False}), t=f"<p>before {ref} after</p>") == "before ㊟ after"
    assert one(spark, markup.html_text(F.col("t")), t='<p>before <a href="chapter.xhtml">link</a> after</p>') == "before link after"
    assert one(spark, markup.html_text(F.col("t")), t="<head><title>x</title></head><p>a<strong>b</strong></p><p><ruby>c<rt>d</rt></ruby></p>") == "a<b>b</b>\n\n<ruby>c<rt>d</rt></ruby>"
    assert one(spark, markup.html_text(F.col("t"), {"bold": False, "ruby": False}), t="<b>x</b><ruby>c<rt>d</rt></ruby>") == "xcd"
    assert one(spark, markup.restore_noterefs(F.col("t"), F.array(F.lit(ref))), t='x <a class="noteref" href="#N1">1</a>') == f"x {ref}"
    assert one(spark, markup.href_key(F.col("t")), t="#A%20b#c") == "a b_c"
    assert one(spark, epub.resolve(F.lit("OEBPS/a.opf"), F.col("t")), t="../x/./y.html") == "x/y.html"


def test_book(spark, tmp_path):
    import io
    import zipfile

    long = "これは本文です。" * 40
    pages = {"cover": "<p>cover</p>", "c1": f"<h1>第一章</h1><p>{long}</p>", "c2": f"<p>{long}</p>", "end": "<p>あとがき</p><p>ありがとう。</p>"}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{k}" href="{k}.xhtml" media-type="application/xhtml+xml"/>' for k in pages) + '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
        z.writestr("OEBPS/b.opf", f"<package><manifest>{items}</manifest><spine>{''.join(f'<itemref idref={chr(34)}{k}{chr(34)}/>' for k in pages)}</spine></package>")
        z.writestr("OEBPS/nav.xhtml", '<nav><a href="c1.xhtml">第一章</a><a href="end.xhtml">あとがき</a></nav>')
        for k, v in pages.items():
            z.writestr(f"OEBPS/{k}.xhtml", f"<html><head/><body>{v}</body></html>")
    books = spark.createDataFrame([("b.epub", bytearray(buffer.getvalue())), ("broken.epub", bytearray(b"no"))], "path string, content binary")
    got = epub.book_texts(books).orderBy("path").collect()
    assert [(r.path, r.text is None) for r in got] == [("b.epub", False), ("broken.epub", True)] and "BadZipFile" in got[1].error and got[0].error is None
    by_mode = {m: {r.path: r for r in epub.read_books(books, m, command="no-such-converter").collect()} for m in ("auto", "pandoc", "internal")}
    assert by_mode["auto"]["b.epub"].text == by_mode["internal"]["b.epub"].text == got[0].text and by_mode["pandoc"]["b.epub"].text is None
    assert "not installed" in by_mode["auto"]["b.epub"].error and "BadZipFile" in by_mode["auto"]["broken.epub"].error
    assert got[0].text.startswith("第一章") and got[0].text.count("これは本文です。") == 80 and "あとがき" not in got[0].text
    (tmp_path / "a_cn.txt").write_text("译文")
    (tmp_path / "b.epub").write_bytes(buffer.getvalue())
    assert {r.path.rsplit("/", 1)[-1]: r.text[:2] for r in plain.read_inputs(spark, str(tmp_path)).collect()} == {"a_cn.txt": "译文", "b.epub": "第一"}
    assert [r.name for r in plain.listing(spark, str(tmp_path)).collect()] == ["a_cn.txt", "b.epub"]
    assert plain.input_mode(plain.listing(spark, str(tmp_path))).first().input_mode == "document"
    with pytest.raises(ValueError, match="3 supported files"):
        plain.scan(spark, str(tmp_path))
    assert {r.name: r.role for r in plain.scan(spark, str(tmp_path), "bilingual").collect()} == {"a_cn.txt": "jp", "b.epub": "cn"}  # an underscore is no border of a word
    assert {r.name: r.role for r in plain.guess_roles(spark.createDataFrame([("學園.txt",), ("学园.txt",), ("ふ.txt",)], "name string")).collect()} == {"學園.txt": "tw", "学园.txt": "cn", "ふ.txt": "jp"}
    asked = lambda saved: {"asked": saved}
    assert plain.resolve_selection({"a": 1}, {"b": 1}, asked) == {"a": 1} and plain.resolve_selection(None, {"b": 1}, asked) == {"b": 1}
    assert plain.resolve_selection(None, {"b": 1}, asked, True) == {"asked": {"b": 1}} and plain.resolve_selection(None, None, asked) == {"asked": None}
    with pytest.raises(ValueError, match="no input"):
        plain.resolve_selection()
    roles = {r.name: r.role for r in plain.guess_roles(spark.createDataFrame([("カナ.txt",), ("x cn.txt",), ("other.txt",)], "name string")).collect()}
    assert roles == {"カナ.txt": "jp", "x cn.txt": "cn", "other.txt": "tw"}


def brute_alignment(n, m, score, empty):
    """Best total over all monotone covers."""
    best = {(0, 0): 0.0}
    for i in range(n + 1):
        for j in range(m + 1):
            for a, b in align.STEPS:
                if i >= a and j >= b and (a or b) and (i - a, j - b) in best and (i, j) != (0, 0):
                    v = best[i - a, j - b] + (score[i - a, j - b, a, b] if a and b else empty)
                    best[i, j] = max(best.get((i, j), -1e9), v)
    return best[n, m]


def test_cover_against_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        n, m = rng.randint(0, 6), rng.randint(0, 6)
        score = {(i, j, a, b): rng.uniform(-0.2, 1) for i in range(n) for j in range(m) for a, b in align.STEPS if a and b}
        out = align.Band(n, m, 60, -0.22, lambda i, a, b, lo, hi: np.array([score[i, j, a, b] for j in range(lo, hi)])).path()  # noqa: B023
        assert sum(x[4] for x in out) == pytest.approx(brute_alignment(n, m, score, -0.22), abs=1e-5)
        assert [i for x in out for i in range(x[0], x[0] + x[2])] == list(range(n)) and [j for x in out for j in range(x[1], x[1] + x[3])] == list(range(m))


def test_scores_of_a_group_are_those_of_the_columns(spark):
    texts = ["", "x", "alpha beta gamma delta", "alpha beta gamma, epsilon", "zz", "alpha"]
    items = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "k string, idx int, text string")
    f = align.features(align.spans(items, ["k"]), align.generic)
    want = {(r.i, r.a, r.j, r.b): r.s for r in f.alias("l").join(f.alias("r"), "k").select(F.col("l.idx").alias("i"), F.col("l.steps").alias("a"), F.col("r.idx").alias("j"), F.col("r.steps").alias("b"), (align.pair_score("l", "r") - align.MERGE * (F.col("l.steps") + F.col("r.steps") - 2)).alias("s")).collect()}
    side = align.spans(items, ["k"]).select("idx", "steps", align.generic("text").alias("normal"), (F.col("text") == "").alias("empty")).toPandas()
    scores = align.text_scorer(side, side)
    for (i, a, j, b), s in want.items():
        assert scores(i, a, b, j, j + 1)[0] == s
        assert scores(i, a, b, 0, 5)[min(j, 4)] == want[i, a, min(j, 4), b]


def brute_gaps(n, m, score, gap):
    best = {}
    for i in range(n + 1):
        for j in range(m + 1):
            ways = [0.0] if not i and not j else []
            ways += [best[i - 1, j - 1] + score[i - 1, j - 1]] if i and j else []
            ways += [best[i - 1, j] + gap] if i else []
            best[i, j] = max(ways + ([best[i, j - 1] + gap] if j else []))
    return best[n, m]


def test_gap_alignment_is_the_best(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel".split()
    left, right = [f"{w} tells of number {w}" for w in words], [f"{w} tells of number {w}" for w in words if w not in ("bravo", "golf")] + ["india is new here"]
    l, r = (spark.createDataFrame([(1, i, t) for i, t in enumerate(x)], "p int, idx int, text string") for x in (left, right))
    got = align.gap_alignment(l, r, ["p"], normal=align.generic).collect()
    pairs = {(x.i, x.j): x.s for x in align.features(l, align.generic).alias("l").join(align.features(r, align.generic).alias("r"), "p").select(F.col("l.idx").alias("i"), F.col("r.idx").alias("j"), align.pair_score("l", "r").alias("s")).collect()}
    total = sum(x.score if x.left_index is not None and x.right_index is not None else -0.18 for x in got)
    assert total == pytest.approx(brute_gaps(len(left), len(right), pairs, -0.18), abs=1e-5)
    assert [x.left_index for x in got if x.left_index is not None] == list(range(8)) and [x.right_index for x in got if x.right_index is not None] == list(range(7))


def test_alignment_covers_and_gaps(spark):
    base = [f"{w} tells a long story about number {i} and the {w} of it" for i, w in enumerate("alpha bravo charlie delta echo foxtrot golf hotel".split())]
    left = [(1, i, t) for i, t in enumerate(base)] + [(2, 0, "only left")]
    right = [(1, i, t) for i, t in enumerate([*base[:3], base[3] + " " + base[4], *base[5:]])] + [(3, 0, "only right")]
    l, r = (spark.createDataFrame(x, "p int, idx int, text string") for x in (left, right))
    got = align.align_versions(l, r, ["p"], normal=align.generic).orderBy("p", "left_start", "right_start").collect()
    for p, rows_, side in ((1, left, "left"), (1, right, "right"), (2, left, "left"), (3, right, "right")):
        covered = [i for g in got if g.p == p for i in range(g[f"{side}_start"], g[f"{side}_end"])]
        assert covered == [i for q, i, _ in rows_ if q == p]
    assert [(g.left_start, g.left_end, g.right_start, g.right_end) for g in got if g.p == 1 and g.left_start == 0] == [(0, 1, 0, 1)]
    nw = align.gap_alignment(l.where("p = 1"), r.where("p = 1"), ["p"], normal=align.generic).collect()
    assert sorted(x.left_index for x in nw if x.left_index is not None) == list(range(8)) and sorted(x.right_index for x in nw if x.right_index is not None) == list(range(7))
    m = align.point_mapping(*(x.where("p = 1").select("p", "idx", F.array(F.lit(1.0), F.col("idx").cast("double")).alias("vector")) for x in (l, r)), ["p"]).collect()
    assert len(m) == 8


def test_rows(spark):
    v = spark.createDataFrame([("p", 0, 2, 1), ("p", 2, 3, 2), ("p", 3, 4, 3), ("p", 6, 7, 4)], "p string, start int, end int, group int")
    s = spark.createDataFrame([("p", 1, 3, 1), ("p", 9, 12, 2)], "p string, start int, end int, group int")
    got = {(r.kind, r.group): r.row for r in rows.admitted(v, s, ["p"]).collect()}
    assert got == {("version", 1): 1, ("version", 2): 1, ("source", 1): 1}
    rng = random.Random(1)
    a, b = ([(rng.randint(0, 300), rng.randint(0, 60)) for _ in range(60)] for _ in range(2))
    f = lambda x: spark.createDataFrame([("k", i, i + n) for i, n in x], "k string, start int, end int")
    want = sum(i < j + m and j < i + n for i, n in a for j, m in b if n and m)
    assert rows.overlap_join(f(a), f(b), ["k"], 16).count() == want


def test_media_blocks_and_long_ones(spark):
    cases = {"[图片]": True, "[ p12 ] [插图]\n[]": True, "[IMG]": True, "": False, "[p1] text": False, "text": False, "[p1234567]": False, "[p1]" * 50_000: True, "[" * 50_000: False, "[" + " " * 50_000 + "x": False, "[p1]" * 50_000 + "x": False}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", T.is_media(F.col("t")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    docs = spark.createDataFrame([("p", "cn", "[p1]" * 50_000 + "\n\n正文在这里。")], "project string, lang string, text string")
    assert [r.text for r in segment.paragraphs(docs, ["project"]).collect()] == ["正文在这里。"]


def test_alignment_artifact_and_build(spark, tmp_path):
    texts = {"jp": ["これは最初の段落です。とても長い文章が続きます。", "次の段落です。別の話が始まります。"], "cn": ["这是最初的段落。很长的文章继续下去。", "下一个段落。另一个故事开始了。"], "tw": ["這是最初的段落。很長的文章繼續下去。", "下一個段落。另一個故事開始了。"]}
    docs = spark.createDataFrame([("p", k, "\n\n".join(v)) for k, v in texts.items()], "project string, lang string, text string")
    found = compare.build(docs, ["project"], str(tmp_path), about={"labels": {"jp": "A"}})
    assert all((tmp_path / a).exists() for a in store.ARTIFACTS) and found.count() > 0
    a = spark.read.parquet(f"{tmp_path}/alignment").first()
    assert (a.pivot, a.search_window, a.source_count, a.pivot_count) == ("cn", align.VECTOR_WINDOW, 2, 2) and [m["index"] for m in a.mapping] == [0, 1]
    assert [i for g in a.groups for i in range(g["start"], g["end"])] == [0, 1] and [i for g in a.groups for i in range(g["pivot_start"], g["pivot_end"])] == [0, 1]
    assert compare.pivot_of("bilingual") == "cn" and compare.pivot_of() == "tw" and compare.pivot_of(stored=spark.read.parquet(f"{tmp_path}/alignment")) == "cn"


def test_small_helpers(spark):
    assert one(spark, T.display_url("t"), t="HTTP://user:pw@Host.COM:80?q#f") == "http://host.com/" and one(spark, T.display_url("t"), t="https://h:8443/a/B?x") == "https://h:8443/a/B" and one(spark, T.display_url("t"), t="no url?x") == "no url"
    assert one(spark, T.expand_path("t", "/home/u"), t=" '~/x' ") == "/home/u/x" and one(spark, T.expand_path("t", "/home/u"), t="/a~b") == "/a~b"
    pieces = spark.createDataFrame([("a", 1, "one\r\ntw"), ("a", 2, "o\nthree"), ("b", 1, "x\n"), ("c", 1, "")], "s string, n int, text string")
    assert sorted((r.s, r.line_no, r.line) for r in T.line_rows(pieces, ["s"], "n").collect()) == [("a", 0, "one"), ("a", 1, "two"), ("a", 2, "three"), ("b", 0, "x")]


def test_compare_bilingual_and_trilingual(spark):
    p = [("b", lang, i, "正文", t, t, len(t)) for lang in ("jp", "cn", "tw") for i, t in enumerate(["第一段文字说明了一些事情。", "第二段文字很不同而且更长一些。", "最后一段。"])]
    df = spark.createDataFrame(p, "project string, lang string, source_index int, chapter string, text string, cn_text string, chars int")
    tri = compare.compare(df, ["project"]).orderBy("index").collect()
    assert [r["index"] for r in tri] == [1, 2, 3] and all(r.score == pytest.approx(1.0) and r.cn == r.tw_cn == r.jp for r in tri) and tri[0].relation == "简台 1:1 / 日文 1:1"
    bi = compare.compare(df.where("lang <> 'tw'"), ["project"], "bilingual").orderBy("index").collect()
    assert [r.relation for r in bi] == ["原文-译文 1:1"] * 3 and all(r.tw == "" for r in bi)


def test_decisions(spark):
    cases = [
        ('{"semanticSame": true, "needsEdit": true, "better": "counterpart", "severity": "致命", "summary": "x", "revisedText": "y"}', (True, True, "counterpart", "critical", "y")),
        ('text {"semanticSame": "相同", "better": "本列"} tail', (True, False, "target", "none", "")),
        ('{"needsEdit": true, "better": "neither", "severity": "none"}', (False, True, "neither", "major", "")),
        ('{"needsEdit": true, "better": "counterpart", "summary": "无需修改，需要修改", "revisedText": "y"}', (False, False, "target", "none", "")),
        ('{"needsEdit": false, "better": "target", "summary": "建议润色"}', (False, True, "unclear", "none", "")),
        ("no json", (False, False, "unclear", "none", "")),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, content string")
    got = decisions.results(decisions.parse(df)).orderBy("i").collect()
    assert [(r.semantic_same, r.needs_edit, r.better, r.severity, r.revised_text) for r in got] == [c[1] for c in cases]
    assert got[0].status == "suggestion" and "严重程度：致命" in got[0].note and got[0].note.endswith("修改结果：y") and got[1].status == "same" and got[1].done


def test_notes(spark):
    n = "[AI校对]\n语义是否相同：不同\n是否需要修改：是\n问题严重程度：高\n分析：甲\n乙\n修改结果：丙\n丁"
    p = one(spark, notes.parse(F.col("t")), t=n)
    assert (p.semantic, p.modify, p.severity, p.analysis, p.revision) == ("不同", "是", "critical", "甲\n乙", "丙\n丁")
    assert one(spark, notes.parse(F.col("t")), t="by hand") is None and one(spark, notes.parse(F.col("t")), t="[AI校对]\n调用失败：x") is None
    s = one(spark, notes.split_stored(F.col("t"), F.lit("m")), t="hand " + n)
    assert s.note == n and s.manual_note == "m\n\nhand"
    schema = "id string, note string, manual_note string, done boolean, manual_done boolean, ai_done boolean, revision_text string, revision_target string"
    old = spark.createDataFrame([("1", "mine", "", False, False, False, None, ""), ("2", n, "", False, True, True, "edited", "tw"), ("3", "", "", False, False, False, None, "")], schema)
    ev = spark.createDataFrame([("1", n, True, "tw"), ("2", n, True, ""), ("4", "[AI校对]\n调用失败：x", True, "")], "id string, new_note string, new_ai_done boolean, new_target string")
    got = {r.id: r for r in notes.upsert(old, ev).collect()}
    assert got["1"].note == n and got["1"].manual_note == "mine" and got["1"].revision_text == "丙\n丁" and got["1"].revision_target == "tw" and got["1"].ai_done
    assert got["2"].revision_text == "edited" and got["2"].manual_done and got["2"].revision_target == "tw"
    assert "3" not in got and not got["4"].ai_done
    assert {r.id for r in notes.confirm(notes.upsert(old, ev), spark.createDataFrame([("1",), ("9",)], "id string")).where("manual_done").collect()} == {"1", "2", "9"}


def test_browsing(spark):
    r = spark.createDataFrame([(i, "c", "1:1", "source", f"Text {i}", "", "", 0.1 * i) for i in range(1, 8)], "index int, chapter string, relation string, jp string, cn string, tw string, tw_cn string, score double")
    n = spark.createDataFrame([("2", "[规则预筛]\n语义是否相同：相同\n是否需要修改：否", "", False, False, True, "", "")], "id string, note string, manual_note string, done boolean, manual_done boolean, ai_done boolean, revision_text string, revision_target string")
    j = browse.with_notes(r, n)
    assert [x["index"] for x in j.where(browse.matches("text 3")).collect()] == [3]
    assert [x["index"] for x in j.where(browse.matches(ai="same", notes_only=True, done="open", band="watch")).collect()] == [2]
    assert j.where("index = 2").first().badge == "规则通过" and browse.confirmable(j).first().prefilter_kind == "rule"
    assert [x["index"] for x in browse.page(r, 99, 50).collect()] == list(range(1, 8))
    st = browse.statistics(r).first()
    assert (st.total, st.review, st.watch, st.ok) == (7, 1, 2, 4) and st.mean_score == pytest.approx(0.4)


def test_differences(spark):
    df = spark.createDataFrame([(1, "abcd", "abXd"), (2, "", ""), (3, "x" * 300 + "1", "x" * 300 + "2"), (4, "a<b", "a<b"), (5, "", "q"), (6, None, "z")], "i int, a string, b string")
    got = {r.i: r.h for r in diff.diff(df, "a", "b").select("i", diff.html(F.col("diff")).alias("h")).collect()}
    assert got == {1: "ab<del>c</del><ins>X</ins>d", 2: "", 3: "x" * 300 + "<del>1</del><ins>2</ins>", 4: "a&lt;b", 5: "<ins>q</ins>", 6: "<ins>z</ins>"}
    assert one(spark, diff.summary(F.col("a"), F.col("b")), a="one two", b="one three").endswith("- two\n+ three")


def test_context_budget(spark):
    df = spark.createDataFrame([("k", i, "s" * (7000 if i == 4 else 100)) for i in range(10)], "k string, index int, source string").withColumns({"target": F.lit(""), "counterpart": F.lit("")})
    got = {r["index"]: [c["index"] for c in r.context] for r in context.context(df, ["k"]).collect()}
    # row 4 passes the budget, but as the first of a round it enters; as the second it does not
    assert 4 in got[5] and 4 not in got[3] and got[9][0] == 3


def test_result_log(spark, tmp_path):
    log = results.with_revision(spark.createDataFrame([("r", i) for i in range(150)], "run string, event_id int"), "run", ["event_id"])
    read, cursor = [], 0
    while chunk := results.page_after(log, cursor).collect():
        read.append([r.revision for r in chunk])
        cursor = chunk[-1].revision
    assert results.page_after(log.withColumn("run", F.lit("now")), 100, 64, "now", "before").first().revision == 1 and results.page_after(log.withColumn("run", F.lit("now")), 100, 64, "now", "now").first().revision == 101
    assert [len(x) for x in read] == [64, 64, 22] and sum(read, []) == list(range(1, 151))
    spark.createDataFrame([("r", 1), ("q", 2)], "run string, event_id int").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    source = spark.readStream.schema("run string, event_id int").parquet(f"{tmp_path}/in/*")
    results.start_log(source, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([("r", 3), ("r", 4)], "run string, event_id int").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    results.start_log(spark.readStream.schema("run string, event_id int").parquet(f"{tmp_path}/in/*"), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/log/batch=*").orderBy("run", "revision").collect()
    assert [(r.run, r.event_id, r.revision) for r in got] == [("q", 2, 1), ("r", 1, 1), ("r", 3, 2), ("r", 4, 3)]


def test_store(spark, tmp_path):
    s, ids = store.Store(spark, str(tmp_path)), []
    for i in range(3):
        at = s.stage()
        for a in store.ARTIFACTS:
            spark.range(1).write.parquet(f"{at}/{a}")
        ids.append(s.publish(at, {"id": "p", "rows_signature": f"sig{i}", "name": "n", "comparison_mode": "bilingual", "input_mode": "txt", "files": {"jp": "a"}, "row_count": 1})["snapshot_id"])
    assert {r.snapshot_id for r in s.manifests().collect()} == set(ids[1:])
    assert s.active().first().snapshot_id == ids[2] and s.artifact("p", "rows").endswith(f"{ids[2]}/rows")
    for bad in (lambda: s.artifact("../outside", "rows"), lambda: s.artifact("p", "secret"), lambda: s.discard(str(tmp_path))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(FileNotFoundError):
        s.publish(s.stage(), {"id": "p", "rows_signature": "x"})


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([(1, "c", "1:1", 0.5, None, 'say "hi"', "x\ny")], "index int, chapter string, relation string, score double, jp_align_score double, jp string, cn string")
    assert sinks.csv_header("bilingual") == "index,chapter,relation,score,jpAlignScore,jp,cn"
    assert sinks.csv_lines(r, "bilingual").first().line == '"1","c","1:1","0.5","","say ""hi""","x\ny"'
    import json

    rows_ = spark.createDataFrame([(i, "c", "1:1", 0.5, None, f"line {i}\nnext", 'q"') for i in range(300)], r.schema).repartition(7)
    sinks.write_csv(rows_, f"{tmp_path}/csv", "bilingual")
    whole = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    import csv
    import io

    assert whole.startswith('index,chapter,relation,score,jpAlignScore,jp,cn\n"0","c"') and [x[0] for x in csv.reader(io.StringIO(whole))] == ["index", *map(str, range(300))]
    sinks.write_document(rows_, f"{tmp_path}/json", {"project": {"key": "p"}, "labels": {"jp": "A"}, "counts": {"jp": 300}})
    told = json.loads("".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*"))))
    assert list(told) == ["project", "files", "labels", "counts", "rowsSignature", "rows"] and [x["index"] for x in told["rows"]] == list(range(300)) and told["rows"][1]["jp"] == "line 1\nnext"
    e = spark.createDataFrame([(2, "b", "c<d"), (1, "a&", "x")], "index int, search string, replace string")
    text = sinks.replace_list(e).first().content
    assert text.index("a&amp;") < text.index("c&lt;d") and text.startswith("<list>") and text.count("<searchtext>") == 2
