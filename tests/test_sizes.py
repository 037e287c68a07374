"""Queries on odd and on large input: what a larger table or a rare text once broke."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions import text as T
from tandem.operators import diff, prefilter
from tandem.queries import QUERIES, SQL
from tandem.sources import markup


def by_sql(name, **tables):
    """The rows of a query's SQL over Spark DataFrames, sorted."""
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(f"_{table}", df.toPandas())
        con.execute(f"create table {table} as select * from _{table}")
    return sorted(con.execute(SQL[name]).fetchall(), key=str)


def by_spark(spark, name, path, **tables):
    for table, df in tables.items():
        df.write.parquet(f"{path}/{table}.parquet")
    return sorted(map(tuple, QUERIES[name](spark, str(path)).collect()), key=str)


@pytest.mark.parametrize("name", ["page_texts", "protected_noterefs", "spine_features"])
def test_entities_without_a_semicolon_stay_in_pages(spark, tmp_path, name):
    text = "und&amp;&amp; ver&amp"
    pages = spark.createDataFrame([(1, "u", f"<html><head><title>{text}</title></head><body><nav><a href=\"x?a=1&amp;b=2\">n &amp</a></nav><h1>{text}</h1><p><b>{text};</b> a &amp b, &amplify, &lt; &quot</p></body></html>")], "page_id long, url string, html string")
    assert by_spark(spark, name, tmp_path, pages=pages) == by_sql(name, pages=pages)


def test_entities_of_html_need_no_semicolon():
    assert markup.read_html("<p>a &amp b &lt;</p>", True)[0] == "a & b <"
    assert markup.read_html("<p>a &amp b &lt; &#38; &#x26; &</p>", True, ended=True)[0] == "a &amp b < & & &"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_the_outcome_does_not_screen_twice(spark):
    rows = spark.createDataFrame([("", "a b", "a c", 0.5, 1, "")], "source string, left string, right string, score double, index long, signature string")
    assert optimized(prefilter.results(prefilter.classify(rows))).count("array_intersect") == 1


def test_characters_of_the_first_block_are_looked_up():
    assert "-" not in T.UNSTABLE and "-" not in T.NOTHING.split("|")[0]


def test_differences_of_many_pairs_are_those_of_each():
    r = random.Random(5)
    pairs = [tuple(np.array([r.randrange(v) for _ in range(r.choice([0, 1, 2, 5, 12, 30]))], np.int64) for _ in "ab") for v in (1, 2, 3, 8) * 60]
    base = np.arange(3000)
    pairs += [(base, base), (base, np.delete(base, [5, 2000])), (base[:50], base)]
    want = [diff.Edits(*p).script() for p in pairs]
    assert all(diff.every_script(pairs, most) == want for most in (1, 50, 3000, 1 << 22))


def test_pairs_of_a_batch_take_their_edits_together(spark, monkeypatch):
    monkeypatch.setattr(diff, "Edits", None)  # one by one would need it
    assert diff.word_parts_of(["a b", "x", ""], ["a c", "x", "y"]) == [diff.word_parts("a b", "a c"), [{"type": "same", "value": "x"}], [{"type": "ins", "value": "y"}]]


def test_references_are_restored_in_small_batches(spark):
    page = '<a class="noteref" href="#N1">1</a>'
    df = spark.createDataFrame([(page, ['<a class="noteref" href="#n1">*</a>']), (page, None), (None, [])], "page string, given array<string>")
    out = df.select(markup.restore_noterefs(F.col("page"), F.col("given")).alias("p"))
    assert [r.p for r in out.collect()] == ['<a class="noteref" href="#n1">*</a>', page, ""]
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
