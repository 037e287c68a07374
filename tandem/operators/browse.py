"""The interactive query over comparison rows: filters, search, pages, navigation and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import notes as N

PAGE_SIZES = (50, 100, 200, 500)


def row_class(score: Column) -> Column:
    return F.when(score >= 0.35, "ok").when(score >= 0.18, "watch").otherwise("review")


def percent_text(score: Column) -> Column:
    return F.concat(F.floor(F.coalesce(score, F.lit(0.0)) * 100 + 0.5).cast("string"), F.lit("%"))


def with_notes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """rows with their notes and what the filters ask of them: ai_state, issue_state, prefilter_kind, badge."""
    j = rows.join(notes.withColumnRenamed("id", "_id"), F.col("index").cast("string") == F.col("_id").cast("string"), "left").drop("_id")
    j = j.withColumns({"_p": N.parse(F.col("note")), "_m": N.marker(F.col("note")), "_f": N.is_failure(F.col("note"))})
    modify = F.col("_p.modify")
    none = F.col("_p").isNull()
    ai = F.when(none, "none").when(modify == "是", "modify").when(modify == "否", "same").otherwise("unclear")
    kind = F.when(F.col("_m") == "[规则预筛]", "rule").when(F.col("_m") == "[相似度预筛]", "similarity").otherwise("")
    badge = (
        F.when(F.col("_f"), "AI失败").when(none, "AI未跑").when(kind == "rule", F.when(modify == "待人工确认", "规则冲突").otherwise("规则通过"))
        .when(kind == "similarity", "相似跳过").when(modify == "是", "AI需改").when(modify == "否", "AI不改").otherwise("AI待判")
    )
    return j.withColumns({"ai_state": ai, "issue_state": F.coalesce(F.nullif(F.col("_p.severity"), F.lit("")), F.lit("unrated")), "prefilter_kind": kind, "badge": badge}).drop("_p", "_m", "_f")


def search_text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


ROW_TEXT = ("index", "chapter", "relation", "jp", "cn", "tw", "tw_cn", "revision_text")


def matches(query: str = "", band: str = "all", ai: str = "all", issue: str = "all", notes_only: bool = False, done: str = "all") -> Column:
    """The conjunction of the filters that are set, over with_notes' rows."""
    stored = (T.text_of("note") != "") | (T.text_of("manual_note") != "")
    confirmed = F.coalesce("manual_done", F.lit(False))
    out = F.lit(True)
    if query:
        out = out & F.contains(F.concat_ws(" ", search_text(*ROW_TEXT), F.lower(N.combined(T.text_of("note"), T.text_of("manual_note")))), F.lit(query.lower()))
    if band != "all":
        out = out & (row_class(F.col("score")) == band)
    if ai != "all":
        out = out & (F.col("ai_state") == ai)
    if issue != "all":
        out = out & (F.col("issue_state") == issue)
    if notes_only:
        out = out & stored
    if done != "all":
        out = out & (confirmed if done == "done" else ~confirmed)
    return out


def among(rows: DataFrame, ids: DataFrame, key: str = "index") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def page(rows: DataFrame, number: int, size: int = 100, order: str = "index") -> DataFrame:
    """One page; a number beyond the last gives the last, below the first the first."""
    if size not in PAGE_SIZES:
        size = 100
    last = max(1, -(-rows.count() // size))
    return rows.orderBy(order).offset((min(max(1, number), last) - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int = 100, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"), F.count("*").alias("total"))


def neighbours(rows: DataFrame, has: Column, keys: list[str], order: str = "index") -> DataFrame:
    """Rows that has() with prev_index and next_index among themselves."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.where(has).withColumns({"prev_index": F.lag(order).over(w), "next_index": F.lead(order).over(w)})


def statistics(rows: DataFrame, *by: str, score: str = "score", source: str = "jp") -> DataFrame:
    """total, rows by band, rows without source, mean score (0 of none)."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    of = lambda c: F.count_if(row_class(F.col(score)) == c)
    return rows.groupBy(*by).agg(F.count("*").alias("total"), of("review").alias("review"), of("watch").alias("watch"), of("ok").alias("ok"), F.count_if(T.text_of(source) == "").alias("empty_source"), F.coalesce(F.sum(s) / F.count("*"), F.lit(0.0)).alias("mean_score"))


def done_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("manual_done").alias("done"), F.count_if("ai_done").alias("ai_done"))


def confirmable(rows: DataFrame) -> DataFrame:
    """Pre-screened rows that nobody has confirmed, counted by kind."""
    return rows.where((F.col("prefilter_kind") != "") & ~F.coalesce("manual_done", F.lit(False))).groupBy("prefilter_kind").count()


def finite_mean(c: str) -> Column:
    """Aggregate: mean of what is a finite number, null of none."""
    v = F.col(c).cast("double")
    return F.avg(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))


def client_rows(rows: DataFrame, signature: Column) -> DataFrame:
    """Rows with signature, band and scores as text, as a page shows them."""
    return rows.withColumns({"signature": signature, "cls": row_class(F.coalesce("score", F.lit(0.0))), "score_text": percent_text(F.col("score")), "jp_align_score_text": F.when(F.col("jp_align_score").isNull(), "").otherwise(percent_text(F.col("jp_align_score")))})
