"""Notes of rows: parsing, splitting and merging automated and manual notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decisions
from ..functions import text as T

#: What an automated note begins with.
MARKERS = ["[AI校对]", "[规则预筛]", "[相似度预筛]"]
FIELDS = [("semantic", r"^语义是否相同："), ("modify", r"^是否需要修改："), ("severity", r"^(?:问题)?严重程度："), ("revision", r"^(?:修改结果|修改后|修改后文本)："), ("advice", r"^建议改法："), ("reason", r"^(?:分析|原因|问题|分析过程)：")]
FAILED = r"^(调用失败：|校对已终止：|校对已终止。$)"


def lines(note: Column) -> Column:
    return F.filter(F.transform(F.split(T.text_of(note), r"\n+"), T.strip), lambda x: x != "")


def marker(note: Column) -> Column:
    def test(t: Column) -> Column:
        out = F.lit("")
        for m in reversed(MARKERS):
            out = F.when(t.startswith(m), m).otherwise(out)
        return out

    return T.let(F.regexp_replace(T.text_of(note), rf"^[{T.WS}]+", ""), test)


def failed(x: Column) -> Column:
    """is_failure of a note's lines."""
    return (F.size(x) > 0) & F.coalesce(F.get(x, F.lit(0)).startswith(MARKERS[0]), F.lit(False)) & F.exists(F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1))), lambda y: y.rlike(FAILED))


def is_failure(note: Column) -> Column:
    """An automated note that tells of a failed call or a stopped run."""
    return T.let(lines(note), failed)


def field_of(line: Column) -> Column:
    """struct(name, value) of a line: each pattern is tested once, and all end with the first colon; a line without a name is its own value."""
    name = F.lit("")
    for known, pattern in reversed(FIELDS):
        name = F.when(line.rlike(pattern), known).otherwise(name)
    value = lambda n: F.when(n == "", line).otherwise(T.strip(F.substr(line, F.locate("：", line) + 1)))
    return T.let(name, lambda n: F.struct(n.alias("name"), value(n).alias("value")))


def parse(note: Column) -> Column:
    """struct(semantic, modify, severity, revision, analysis) of an automated note; null for others, failures and empty ones.

    A line without a name goes on with the field above if that is the revision, else with the analysis.
    """
    empty = F.struct(*[F.lit("").alias(c) for c in ("semantic", "modify", "severity", "revision", "analysis", "field")])

    def more(old, line):
        return F.concat_ws("\n", F.nullif(old, F.lit("")), F.nullif(line, F.lit("")))

    def step(s, line):
        name, value = line["name"], line["value"]
        more_revision = (name == "") & (s["field"] == "revision")
        analysis = F.when(name == "reason", value).when(name == "advice", more(s["analysis"], F.concat(F.lit("建议改法："), value))).when((name == "") & ~more_revision, more(s["analysis"], value)).otherwise(s["analysis"])
        revision = F.when(name == "revision", value).when(more_revision, more(s["revision"], value)).otherwise(s["revision"])
        field = F.when(name.isin("semantic", "modify", "severity"), "").when((name == "revision") | more_revision, "revision").otherwise("analysis")
        return F.struct(
            F.when(name == "semantic", value).otherwise(s["semantic"]).alias("semantic"), F.when(name == "modify", value).otherwise(s["modify"]).alias("modify"),
            F.when(name == "severity", decisions.issue_severity(value)).otherwise(s["severity"]).alias("severity"), revision.alias("revision"), analysis.alias("analysis"), field.alias("field"),
        )

    def out(s):
        some = F.concat(s["semantic"], s["modify"], s["severity"], s["revision"], s["analysis"]) != ""
        return F.when(some, F.struct(*[s[c].alias(c) for c in ("semantic", "modify", "severity", "revision", "analysis")]))

    body = lambda x: F.aggregate(F.transform(F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1))), field_of), empty, step, out)
    return F.when(marker(note) != "", T.let(lines(note), lambda x: F.when(~failed(x), body(x))))


def split_stored(note: Column, manual: Column) -> Column:
    """struct(note, manual_note): what stands before an automated note's marker is manual."""
    t, m = T.text_of(note), T.strip(manual)
    at = F.array_min(F.array_compact(F.array(*[F.nullif(F.locate(k, t), F.lit(0)) for k in MARKERS])))
    whole = F.struct(t.alias("note"), m.alias("manual_note"))
    cut = F.struct(T.strip(F.substr(t, at)).alias("note"), F.concat_ws("\n\n", F.nullif(m, F.lit("")), F.nullif(T.strip(F.left(t, at - 1)), F.lit(""))).alias("manual_note"))
    return F.when((marker(t) != "") | at.isNull(), whole).otherwise(cut)


def combined(note: Column, manual: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(note, F.lit("")), F.nullif(manual, F.lit("")))


NOTE = ["note", "manual_note", "done", "manual_done", "ai_done", "revision_text", "revision_target"]


def normalize_stored(notes: DataFrame) -> DataFrame:
    """notes (id and NOTE columns) as they are read back: automated and manual parts apart, failures without flags."""
    n = notes.withColumn("_s", split_stored(F.col("note"), F.col("manual_note"))).withColumns({"note": F.col("_s.note"), "manual_note": F.col("_s.manual_note")}).drop("_s")
    n = n.withColumns({"_p": parse(F.col("note")), "_f": is_failure(F.col("note"))})
    flag = lambda c: F.coalesce(c, F.lit(False)) & ~F.col("_f")
    target = F.when(F.col("revision_target").isin("cn", "tw"), F.col("revision_target")).otherwise("")
    return n.withColumns({"done": F.lit(False), "manual_done": flag(F.col("manual_done")), "ai_done": flag(F.coalesce("ai_done", F.lit(False)) | F.col("_p").isNotNull()), "revision_text": F.coalesce(F.col("revision_text"), F.col("_p.revision"), F.lit("")), "revision_target": target}).drop("_p", "_f")


def upsert(notes: DataFrame, events: DataFrame) -> DataFrame:
    """notes after events (id, new_note, new_ai_done, new_target), one for each id at most.

    An automated note replaces an automated one; a manual note before it is kept aside; manual text is appended once. A new revision replaces an edited one, a
    repeated note does not; an automated note without revision clears it; a failure clears the flags. Notes with nothing in them go.
    """
    j = notes.join(events, "id", "full_outer")
    old, new = T.text_of("note"), T.text_of("new_note")
    auto_old, auto_new = marker(old) != "", marker(new) != ""
    replace = (old == "") | auto_old
    note = F.when(replace, F.when(new != "", new).otherwise(old)).when(auto_new, new).when((new != "") & ~F.contains(old, new), F.concat_ws("\n\n", old, new)).otherwise(old)
    manual = F.when(~replace & auto_new, combined(F.col("manual_note"), old)).otherwise(T.text_of("manual_note"))
    touched = F.col("new_note").isNotNull()
    j = j.withColumns({"_note": F.when(touched, note).otherwise(old), "_manual": F.when(touched, manual).otherwise(T.text_of("manual_note")), "_auto": auto_new & touched, "_same": auto_new & (new == old)})
    j = j.withColumns({"_p": parse(F.col("_note")), "_new_p": parse(new), "_fail": is_failure(F.col("_note"))})
    revision = T.text_of(F.col("_p.revision"))
    keep_text = F.col("_same") & F.col("revision_text").isNotNull()
    text = F.when(touched & (revision != "") & ~keep_text, revision).when(touched & (revision == "") & F.col("_auto"), "").otherwise(T.text_of("revision_text"))
    valid = F.when(F.col("new_target").isin("cn", "tw"), F.col("new_target"))
    target = F.when(touched & (revision != ""), F.coalesce(valid, F.nullif(F.col("revision_target"), F.lit("")), F.lit("cn"))).when(touched & F.col("_auto"), "").otherwise(T.text_of("revision_target"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    failed = touched & F.col("_fail")
    out = j.select(
        "id", F.col("_note").alias("note"), F.col("_manual").alias("manual_note"), (F.when(touched, flag(F.col("manual_done"))).otherwise(flag(F.col("done"))) & ~failed).alias("done"), (flag(F.col("manual_done")) & ~failed).alias("manual_done"),
        ((flag(F.col("ai_done")) | flag(F.col("new_ai_done")) | F.col("_new_p").isNotNull()) & ~failed).alias("ai_done"), text.alias("revision_text"), target.alias("revision_target"),
    )
    return out.where("note <> '' or manual_note <> '' or done or manual_done or ai_done")


def confirm(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """notes with the given ids confirmed by hand; ids without a note get one."""
    marked = ids.select("id").distinct().withColumn("_c", F.lit(True))
    j = notes.join(marked, "id", "full_outer")
    flag = lambda c: F.coalesce(F.col("_c"), F.col(c), F.lit(False)).alias(c)
    return j.select("id", *[flag(c) if c in ("done", "manual_done") else F.coalesce(c, F.lit(False)).alias(c) if c == "ai_done" else T.text_of(c).alias(c) for c in NOTE])
