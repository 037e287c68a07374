"""Model decisions: from the model's text to a normal form, and from that to a result event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import script
from . import text as T

#: Names under which models give a field, words for its values.
SUMMARY = ["summary", "analysis", "reason", "explanation", "分析", "分析过程"]
REVISED = ["revisedText", "revision", "result", "modifiedText", "correctedText", "replacement", "修改结果", "修改后文本", "完整修改结果"]
SEVERITY = ["severity", "issueSeverity", "严重程度", "严重性"]
TRUE = ["true", "1", "yes", "y", "是", "需要", "相同"]
FALSE = ["false", "0", "no", "n", "否", "不需要", "不同"]
BETTER = {
    "target": ["target", "目标", "目标列", "当前列", "本列", "原目标"],
    "counterpart": ["counterpart", "other", "另一列", "对照列", "对方", "另一版本", "参考列"],
    "neither": ["neither", "none", "都不", "都不好", "两者都不", "均不"],
    "unclear": ["unclear", "unknown", "不确定", "无法判断", "待确认"],
}
LEVELS = {"critical": ["critical", "致命", "高", "high"], "major": ["major", "严重", "重大", "主要", "中", "medium"], "minor": ["minor", "轻微", "次要", "低", "low"]}
LEVEL_NAMES = {"minor": "轻微", "major": "严重", "critical": "致命"}
NO_EDIT = r"(无需|无须|不需|不需要|不用|不必)(修改|改写|修订|调整|优化)|无需改|不用改|保持目标列|目标列更(准确|自然|合适|好)|目标列已经"
EDIT = r"(需要|需|应|应该|建议)(修改|改写|修订|调整|优化|润色)|改为|修正为|以.+为基准|参考.+修订|进行局部优化|局部优化|作为修改结果|修改结果"
MARK = "[AI校对]"


def first_string(*values: Column) -> Column:
    given = F.filter(F.transform(F.array(*values), T.strip), lambda x: x != "")
    return F.coalesce(F.get(given, F.lit(0)), F.lit(""))


def lowered(c: Column) -> Column:
    return F.lower(T.strip(c))


def parse_boolean(c: Column, fallback: bool = False) -> Column:
    """JSON booleans, numbers (0 is false) and words; the fallback for anything else."""

    def read(t: Column) -> Column:
        number = F.when(t.rlike(r"^-?\d+(\.\d+)?$"), t.try_cast("double"))
        return F.when(t.isin(TRUE), True).when(t.isin(FALSE), False).when(number.isNotNull(), number != 0).otherwise(fallback)

    return T.let(lowered(c), read)


def words(c: Column, table: dict[str, list[str]], otherwise) -> Column:
    def read(t: Column) -> Column:
        out = F.lit(otherwise)
        for name, known in reversed(table.items()):
            out = F.when(t.isin(known), name).otherwise(out)
        return out

    return T.let(lowered(c), read)


def normalize_better(c: Column) -> Column:
    return words(c, BETTER, "unclear")


def needs_edit(given: Column, semantic_same: Column, better: Column) -> Column:
    return F.when(T.strip(given) != "", parse_boolean(given)).otherwise(better.isin("counterpart", "neither"))


def normalize_severity(c: Column, edit: Column) -> Column:
    return F.when(~edit, "none").otherwise(words(c, LEVELS, "major"))


def issue_severity(c: Column) -> Column:
    return words(c, LEVELS, "")


def summary_intent(c: Column) -> Column:
    """no-edit, edit or empty; a text that says both says no-edit."""
    t = F.regexp_replace(T.text_of(c), rf"[{T.WS}]+", "")
    return F.when(t.rlike(NO_EDIT), "no-edit").when(t.rlike(EDIT), "edit").otherwise("")


def normalize(d: DataFrame) -> DataFrame:
    """d (semantic_same, needs_edit, needs_context, better, severity, summary, suggestion, revised_text) after its summary's intent is applied."""
    intent = summary_intent(F.col("summary"))
    dropped, raised = (intent == "no-edit") & F.col("needs_edit"), (intent == "edit") & ~F.col("needs_edit")
    out = d.withColumns({"_dropped": dropped, "_raised": raised})
    out = out.withColumns({
        "needs_edit": F.when(F.col("_dropped"), False).when(F.col("_raised"), True).otherwise(F.col("needs_edit")),
        "better": F.when(F.col("_dropped"), F.when(F.col("semantic_same"), "neither").otherwise("target")).when(F.col("_raised") & (F.col("better") == "target"), "unclear").otherwise(F.col("better")),
        "suggestion": F.when(F.col("_dropped"), "").otherwise(F.col("suggestion")),
    })
    definite = F.col("needs_edit") & ~F.col("needs_context") & (F.col("better") != "unclear")
    return out.withColumns({"revised_text": F.when(F.col("needs_edit"), F.col("revised_text")).otherwise(""), "severity": F.when(definite, normalize_severity(F.col("severity"), F.lit(True))).otherwise("none")}).drop("_dropped", "_raised")


def parse(d: DataFrame, content: str = "content") -> DataFrame:
    """d with a decision's columns from the model's text: JSON, or the widest braces in it. `valid` is false where that is no JSON object."""
    kept = d.columns
    t = T.strip(content)
    found = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    body = F.when(t.startswith("{"), t).when(found != "", found).otherwise("{}")
    data = F.from_json(F.col("_json"), "map<string,string>")
    get = lambda name: F.get(F.array(F.col("_data")[name]), F.lit(0))
    out = d.withColumn("_json", body).withColumn("_data", data)
    out = out.withColumn("valid", F.try_parse_json("_json").isNotNull() & F.col("_data").isNotNull())
    better, same = normalize_better(get("better")), parse_boolean(get("semanticSame"))
    edit = needs_edit(get("needsEdit"), same, better)
    out = out.withColumns({
        "semantic_same": same, "needs_edit": edit, "needs_context": parse_boolean(get("needsContext")), "better": better,
        "severity": normalize_severity(first_string(*map(get, SEVERITY)), edit), "summary": first_string(*map(get, SUMMARY)),
        "suggestion": T.strip(get("suggestion")), "replacement": T.strip(get("replacement")), "revised_text": first_string(*map(get, REVISED)),
    })
    return normalize(out).select(*kept, "valid", "semantic_same", "needs_edit", "needs_context", "better", "severity", "summary", "suggestion", "replacement", "revised_text")


def ensure_revised(d: DataFrame, target: str, counterpart_text: str, mode: str = "trilingual") -> DataFrame:
    """Where an edit by the counterpart comes without text, the counterpart in the target's script is the text (trilingual mode)."""
    lacks = F.col("needs_edit") & ~F.col("better").isin("target", "unclear") & (T.text_of("revised_text") == "")
    fallback = F.when(F.lit(mode != "bilingual") & lacks & (F.col("better") == "counterpart"), script.to_target_script(counterpart_text, F.lit(target))).otherwise("")
    said = F.when(fallback != "", "模型未给出 revisedText，已使用另一版本转换为目标列字形作为完整修改结果。")
    summary = F.concat_ws(" ", F.nullif(F.col("summary"), F.lit("")), said)
    return d.withColumns({"revised_text": F.when(lacks, fallback).otherwise(F.col("revised_text")), "summary": F.when(lacks, summary).otherwise(F.col("summary"))})


def analysis_line(fallback: Column | None = None) -> Column:
    text = F.concat_ws(" ", F.nullif(F.col("summary"), F.lit("")), F.nullif(fallback, F.lit("")) if fallback is not None else F.lit(None).cast("string"))
    return F.when(text != "", F.concat(F.lit("分析："), text))


def severity_line() -> Column:
    names = F.create_map(*[F.lit(x) for p in LEVEL_NAMES.items() for x in p])
    return F.concat(F.lit("严重程度："), F.element_at(names, normalize_severity(F.col("severity"), F.lit(True))))


def results(d: DataFrame, target_label: str = "目标", counterpart_label: str = "参照") -> DataFrame:
    """d with status, done and note."""
    open_ = F.col("needs_context") | (F.col("better") == "unclear")
    same = F.concat(F.lit("语义是否相同："), F.when(F.col("semantic_same"), "相同").otherwise("不同"))
    line = lambda text: F.lit(f"是否需要修改：{text}")
    given = F.col("revised_text") != ""
    revised = F.when(given, F.concat(F.lit("修改结果："), F.col("revised_text")))
    edit = lambda words: F.concat_ws("\n", F.lit(MARK), same, line("是"), severity_line(), analysis_line(F.when(given, "").otherwise(first_string(F.col("suggestion"), F.lit(words)))), revised)
    unsure = F.concat_ws("\n", F.lit(MARK), same, line("待人工确认"), analysis_line())
    note = (
        F.when(open_, unsure)
        .when(~F.col("needs_edit"), F.concat_ws("\n", F.lit(MARK), same, line("否"), analysis_line()))
        .when(F.col("better") == "counterpart", edit(f"参考{counterpart_label}修订{target_label}。"))
        .when(F.col("better") == "neither", edit("按原文重新整理译文。"))
        .otherwise(unsure)
    )
    settled = ~open_ & ~F.col("needs_edit")
    return d.withColumns({"status": F.when(settled, F.when(F.col("semantic_same"), "same").otherwise("target-better")).otherwise("suggestion"), "done": settled, "note": note})
