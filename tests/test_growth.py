"""What must not grow: columns sent more than once, blocks judged more than once, rows of one task."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tandem.functions import decisions
from tandem.functions import text as T
from tandem.operators import align, notes, rows, segment
from tandem.queries import QUERIES
from tandem.queries_runs import contents


def test_band_sends_a_left_item_once(spark, capsys):
    left = spark.range(100).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("idx"), F.col("id").cast("string").alias("left_text"))
    right = spark.range(90).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("idx"), F.col("id").cast("string").alias("right_text"))
    found = align.band_candidates(left, right, ["k"], 6, F.col("l.left_text"), F.col("r.right_text"))
    found.explain()
    spread = [x for x in capsys.readouterr().out.splitlines() if "Generate explode" in x]
    assert len(spread) == 1 and "right_text" in spread[0] and "left_text" not in spread[0]
    assert {(r.i, r.j) for r in found.collect()} == {(i, j) for i in range(100) for j in range(90) if abs(i - j) <= 6}
    assert found.count() == sum(abs(i - j) <= 6 for i in range(100) for j in range(90))


def test_blocks_are_judged_before_they_are_sorted(spark):
    docs = spark.createDataFrame([(1, "a\n\nbc\n \n\n\nd")], "id int, text string")
    found = segment.block_ranges(docs, told={"long": F.length("block_text") > 1}).orderBy("block").collect()
    assert [(r.start, r.end, r.long) for r in found] == [(0, 1, False), (3, 5, True), (10, 11, False)]
    assert "block_text" not in found[0].asDict()


def test_collapse_and_dropped_by_tables_take_the_same_characters(spark):
    points = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}c{chr(c)}{chr(c)}" for c in points]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.trim(F.regexp_replace("t", rf"[{T.WS}]+", " "))
    assert d.where(T.collapse("t") != plain).count() == 0
    assert d.where(F.regexp_replace("t", T.DROPPED, "") != F.regexp_replace("t", rf"[{T.CJK_DROPPED}{T.WS}]", "")).count() == 0


def test_front_words_in_letters_of_either_case(spark):
    d = spark.createDataFrame([("Read with EPUB3 on any device, please.",), ("Read with it on any device, please now.",), ("本电子书籍，please read it on any device.",)], "t string")
    assert [r[0] for r in d.select(T.is_likely_body(F.col("t"), F.lit("cn"))).collect()] == [False, True, False]


def test_whole_table_of_a_gap_scores_as_its_rows(monkeypatch):
    rng = np.random.default_rng(5)

    def side(n):
        texts = ["".join(rng.choice(list("abcdé中"), rng.integers(0, 9))) for _ in range(n)]
        two = [(i, 2, texts[i] + texts[i + 1]) for i in range(n - 1)]
        return pd.DataFrame([(i, 1, t) for i, t in enumerate(texts)] + two, columns=["idx", "steps", "normal"]).assign(empty=lambda f: f.normal == "")

    left, right = side(30), side(26)
    whole = align.Band(30, 26, 60, align.EMPTY, align.text_scorer(left, right)).path()
    monkeypatch.setattr(align, "WHOLE", 0)
    assert whole == align.Band(30, 26, 60, align.EMPTY, align.text_scorer(left, right)).path()


def test_islands_of_many_intervals_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(rows, "SORTED", 10)
    i = spark.range(200).select((F.col("id") % 20).alias("k"), F.floor(F.col("id") / 20).cast("int").alias("start"), (F.floor(F.col("id") / 20) + 1).cast("int").alias("end"))
    found = rows.islands(i, ["k"], 200)
    assert found.rdd.getNumPartitions() == 20
    plain = rows.islands(i, ["k"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_noted_rows_are_screened_once_and_their_outcomes_written(spark, tmp_path):
    text = "a longer text with é in it, so that it is like its variant"
    docs = spark.createDataFrame([(i, "en", text) for i in range(10)], "doc_id long, lang string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["browse_states"](spark, str(tmp_path))
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.n for r in found.collect()) == 10


def test_decisions_of_one_file_are_dealt_to_all_tasks_and_a_word_is_read_once(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("event_id"), F.lit("x").alias("event_type")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = contents(spark, str(tmp_path))
    assert c.select(F.spark_partition_id()).distinct().count() == 4
    word = decisions.normalize_better(F.col("content"))
    assert c.select(word.alias("w"))._jdf.queryExecution().analyzed().toString().count("lower(") == 1
    d = spark.createDataFrame([(None, " b ", "c"), ("", " ", None)], "x string, y string, z string")
    assert [r[0] for r in d.select(decisions.first_string(F.col("x"), F.col("y"), F.col("z"))).collect()] == ["b", ""]


def test_a_line_of_a_note_is_tested_once_by_each_pattern(spark):
    d = spark.createDataFrame([("[AI校对]\n语义是否相同：相同\n是否需要修改：是\n问题严重程度：致命\n修改结果：a：b\nc\n建议改法：d\n分析：e\nf",), ("[AI校对]\n调用失败：x",), ("x",)], "note string")
    parsed = d.select(notes.parse(F.col("note")).alias("p"))
    assert [r.p and tuple(r.p) for r in parsed.collect()] == [("相同", "是", "critical", "a：b\nc", "e\nf"), None, None]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= len(notes.FIELDS) + 1
