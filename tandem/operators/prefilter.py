"""Pre-screening of rows by rules and similarity, before any model is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

THRESHOLD = 0.92
#: Reasons by outcome.
REASONS = {
    "rule-empty": "两份非原文均为空，无可校对内容。",
    "rule-equivalent": "繁简、全半角、空白或不可见字符归一化后完全一致。",
    "structured-differs": "结构化内容与原文不一致，需要人工确认。",
    "structured-conflict": "两份非原文的结构化内容不一致，需要人工确认。",
    "similarity": "两份非原文通过受保护的正文相似度预筛选。",
}


def with_canonical(rows: DataFrame, columns=("source", "left", "right"), compatibility: bool = True) -> DataFrame:
    """rows with `<column>_canon`, computed once for all tests."""
    return rows.withColumns({f"{c}_canon": T.canonical(c, compatibility) for c in columns})


def may_compare(left: Column, right: Column) -> Column:
    """Whether similarity may decide: no structured text, 8 characters at least, lengths within a tenth, equal protected tokens."""
    a, b = F.length(T.similarity_text(left)), F.length(T.similarity_text(right))
    shorter, longer = F.least(a, b), F.greatest(a, b)
    return ~T.is_structured(left) & ~T.is_structured(right) & (shorter >= 8) & (shorter / longer >= 0.9) & (T.protected_tokens(left) == T.protected_tokens(right))


def similarity(left: Column, right: Column) -> Column:
    return T.jaccard(T.bigrams(T.similarity_text(left)), T.bigrams(T.similarity_text(right)))


def classify(rows: DataFrame, threshold: float = THRESHOLD, compatibility: bool = True) -> DataFrame:
    """rows (source, left, right, score) with kind, reason and similarity; kind is null where a model is needed.

    The outcomes are tried in order, and the bigram sets are built only where everything before them has passed.
    """
    kept = rows.columns
    out = with_canonical(rows, compatibility=compatibility)
    source, left, right = (F.col(f"{c}_canon") for c in ("source", "left", "right"))
    structured = lambda c: T.is_structured(c) | (c == "")
    step = (
        F.when((left == "") & (right == ""), "rule-empty")
        .when((left != "") & (left == right) & T.is_structured(source) & T.is_structured(left) & (source != left), "structured-differs")
        .when((left != "") & (left == right), "rule-equivalent")
        .when(structured(left) & structured(right), "structured-conflict")
        .when(may_compare(left, right), "similarity")
    )
    out = out.withColumn("_step", step)
    score = F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(0.0))
    out = out.withColumn("similarity", F.when(F.col("_step") == "similarity", F.greatest(score, similarity(left, right))))
    fails = (F.col("_step") == "similarity") & (F.col("similarity") < threshold)
    out = out.withColumn("_step", F.when(~fails, F.col("_step"))).withColumn("similarity", F.when(~fails, F.col("similarity")))
    reason = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    kind = F.when(F.col("_step") == "structured-differs", "structured-conflict").otherwise(F.col("_step"))
    found = F.struct(kind.alias("kind"), F.element_at(reason, F.col("_step")).alias("reason"), "similarity")
    # as an element of an array the outcome is worked out once; a filter on plain columns would be pushed below them and work them out again
    return out.select(*kept, F.explode_outer(F.array(found)).alias("_found")).select(*kept, "_found.*")


def sides(rows: DataFrame, mode: str = "trilingual") -> DataFrame:
    """Compare rows with source, left and right: A and B in bilingual mode, B and C in simplified script else."""
    left, right = ("jp", "cn") if mode == "bilingual" else ("cn", "tw_cn")
    return rows.withColumns({"source": F.col("jp"), "left": F.col(left), "right": F.col(right)})


def pending(rows: DataFrame, done: DataFrame, key: str | list[str] = "index") -> DataFrame:
    """Rows that are not done yet."""
    by = [key] if isinstance(key, str) else list(key)
    return rows.join(done.select(*by).distinct(), by, "left_anti")


def results(classified: DataFrame, labels: dict[str, str] | None = None, mode: str = "trilingual", keys: tuple[str, ...] = ()) -> DataFrame:
    """Result events (keys, index, signature, status, done, note) of the rows that the pre-screening decided."""
    labels = labels or {}
    a = labels.get("jp") or "原文 A"
    left = a if mode == "bilingual" else labels.get("cn") or "非原文 B"
    right = (labels.get("cn") or "译文 B") if mode == "bilingual" else labels.get("tw") or "非原文 C"
    conflict, similar = F.col("kind") == "structured-conflict", F.col("kind") == "similarity"
    percent = F.floor(F.col("similarity") * 100 + 0.5).cast("int").cast("string")
    analysis = F.when(similar, F.concat(F.lit(f"{left} 与 {right} 的受保护正文相似度为 "), percent, F.lit("%。"))).otherwise(F.col("reason"))
    note = F.concat_ws(
        "\n",
        F.when(similar, "[相似度预筛]").otherwise("[规则预筛]"),
        F.concat(F.lit("语义是否相同："), F.when(conflict, "待人工确认").otherwise("相同")),
        F.concat(F.lit("是否需要修改："), F.when(conflict, "待人工确认").otherwise("否")),
        F.concat(F.lit("分析："), analysis, F.when(T.text_of("source") != "", f" 参照列：{a}。").otherwise("")),
    )
    status = F.when(conflict, "rule-conflict").when(similar, "similarity-prefilter").otherwise("rule-prefilter")
    return classified.where("kind is not null").select(*keys, "index", "signature", status.alias("status"), (~conflict).alias("done"), note.alias("note"))


def counters(log: DataFrame, *by: str) -> DataFrame:
    """Counts over result events (status, done)."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    screened = ["rule-prefilter", "similarity-prefilter", "rule-conflict"]
    return log.groupBy(*by).agg(
        F.count("*").alias("processed"), F.count_if("done").alias("handled"), of(*screened).alias("prefiltered"), of("rule-prefilter").alias("rule_prefiltered"),
        of("similarity-prefilter").alias("similarity_prefiltered"), of("rule-conflict").alias("structured_conflicts"), of("suggestion").alias("suggested"), of("error").alias("errors"),
        F.count_if(~F.col("status").isin(*screened)).alias("model_processed"),
    )
