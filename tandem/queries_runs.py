"""Registered queries of model decisions, notes, contexts, differences, progress and signatures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import decisions, hashing, script
from .functions import text as T
from .operators import align, browse, context, diff, notes, prefilter, rows
from .plans import sinks
from .queries import _BASE36, _FNV
from .registry import GRAMS, JACCARD, PAIRS, pairs, query, table
from .sources import plain

# ---- decisions: contents of six forms, fields under several names, summaries that decide ----

_BETTER = ["target", "另一列", "都不好", "unclear", "本列", "weird"]
_BETTER_OF = ["target", "counterpart", "neither", "unclear", "target", "unclear"]
_SEVERITY, _SEVERITY_OF = ["high", "轻微", "major", "", "致命"], ["critical", "minor", "major", "major", "critical"]
_SUMMARY, _INTENT = ["", "无需修改", "建议润色", "以原文为基准，不用改"], ["", "no-edit", "edit", "no-edit"]
_SEVERITY_KEY, _REVISED_KEY, _SUMMARY_KEY = ["severity", "issueSeverity", "严重性"], ["revisedText", "修改结果", "replacement"], ["summary", "分析", "reason"]


def contents(spark, sf_dir) -> DataFrame:
    # dealt by number, as an event is few bytes and much work, and a file may be one row group
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = table(spark, sf_dir, "events").select("event_id", "event_type").repartition(parts, "event_id")
    i = F.col("event_id")
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))
    said = lambda key, value: F.concat(F.lit(', "'), key, F.lit('": "'), value, F.lit('"'))
    text = lambda condition: F.when(condition, "true").otherwise("false")
    body = F.concat(
        F.lit('{"semanticSame": '), text(i % 2 == 0), F.when(i % 5 != 0, F.concat(F.lit(', "needsEdit": '), text(i % 3 == 0))).otherwise(""), F.lit(', "needsContext": '), text(i % 7 == 0), said(F.lit("better"), pick(_BETTER, F.floor(i / 6))),
        said(pick(_SEVERITY_KEY, i), pick(_SEVERITY, i)), said(pick(_REVISED_KEY, F.floor(i / 2)), F.when(i % 4 == 1, "").otherwise("x")), said(pick(_SUMMARY_KEY, F.floor(i / 4)), pick(_SUMMARY, F.floor(i / 3))), F.lit("}"),
    )
    form = F.when(i % 6 == 1, F.concat(F.lit("Answer: "), body, F.lit(" end"))).when(i % 6 == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 6 == 3, F.concat(F.lit("{oops "), body)).when(i % 6 == 4, "no answer").otherwise(body)
    return e.withColumn("content", form)


def _case(at: str, values: list) -> str:
    return f"{values!r}[(({at}) % {len(values)})::int + 1]"


_DECISIONS = f"""d as (select event_id as i, event_id, event_type, event_id % 6 <> 3 as valid, event_id % 6 not in (3, 4) as known, event_id % 2 = 0 as same, event_id % 7 = 0 as context, {_case('event_id // 6', _BETTER_OF)} as better, {_case('event_id', _SEVERITY_OF)} as sev,
  {_case('event_id // 3', _SUMMARY)} as summary, {_case('event_id // 3', _INTENT)} as intent, case when event_id % 4 = 1 then '' else 'x' end as revised from events),
e as (select event_id, event_type, valid, known and same as same, known and context as context, case when known then better else 'unclear' end as better, case when known then sev end as sev, case when known then summary else '' end as summary, case when known then intent else '' end as intent, revised,
  known and case when i % 5 <> 0 then i % 3 = 0 else better in ('counterpart', 'neither') end as edit from d),
f as (select *, intent = 'no-edit' and edit as dropped, intent = 'edit' and not edit as raised, case when edit then sev else 'major' end as given from e),
n as (select event_id, event_type, valid, same, context, (edit or raised) and not dropped as edit, case when dropped then case when same then 'neither' else 'target' end when raised and better = 'target' then 'unclear' else better end as better, given, revised, summary from f),
o as (select *, context or better = 'unclear' as open, case when edit then revised else '' end as revision, case when edit and not context and better <> 'unclear' then given else 'none' end as severity from n)"""


@query(f"with {_DECISIONS} select event_id, valid, same as semantic_same, edit as needs_edit, context as needs_context, better, severity, summary, revision as revised_text from o")
def parsed_decisions(spark, sf_dir):
    return decisions.parse(contents(spark, sf_dir)).select("event_id", "valid", "semantic_same", "needs_edit", "needs_context", "better", "severity", "summary", "revised_text")


@query(f"with {_DECISIONS} select case when open or edit then 'suggestion' when same then 'same' else 'target-better' end as status, not open and not edit as done, count(*) as n from o group by all")
def decision_results(spark, sf_dir):
    return decisions.results(decisions.parse(contents(spark, sf_dir))).groupBy("status", "done").agg(F.count("*").alias("n"))


@query(f"""with {_DECISIONS}, m as (select *, case when open then '待人工确认' when not edit then '否' when better in ('counterpart', 'neither') then '是' else '待人工确认' end as modify from o)
select better, modify, case when same then '相同' else '不同' end as semantic, case when modify = '是' then severity else '' end as severity, case when modify = '是' then revision else '' end as revision, count(*) as n from m group by all""")
def note_round_trip(spark, sf_dir):
    """Notes of decisions, parsed again: what the note says of each decision."""
    p = notes.parse(F.col("note"))
    r = decisions.results(decisions.parse(contents(spark, sf_dir))).select("better", p.alias("p"))
    return r.select("better", "p.modify", "p.semantic", "p.severity", "p.revision").groupBy("better", "modify", "semantic", "severity", "revision").agg(F.count("*").alias("n"))


@query(f"""with {_DECISIONS}, l as (select *, edit and better in ('counterpart', 'neither') and revision = '' as lacks from o)
select event_id, case when lacks and better = 'counterpart' then event_type else revision end as revised_text,
  case when lacks and better = 'counterpart' then concat_ws(' ', nullif(summary, ''), '模型未给出 revisedText，已使用另一版本转换为目标列字形作为完整修改结果。') else summary end as summary from l""")
def ensured_revisions(spark, sf_dir):
    d = decisions.ensure_revised(decisions.parse(contents(spark, sf_dir)), "cn", "event_type")
    return d.select("event_id", "revised_text", "summary")


@query(f"""with {_DECISIONS}, m as (select *, case when open then '待人工确认' when not edit then '否' when better in ('counterpart', 'neither') then '是' else '待人工确认' end as modify from o)
select event_id, '[AI校对]' || chr(10) || '语义是否相同：' || case when same then '相同' else '不同' end || chr(10) || '是否需要修改：' || modify
  || case when modify = '是' then chr(10) || '严重程度：' || case severity when 'critical' then '致命' when 'minor' then '轻微' else '严重' end else '' end
  || coalesce(chr(10) || '分析：' || nullif(concat_ws(' ', nullif(summary, ''), case when modify = '是' and revision = '' then case better when 'counterpart' then '参考乙修订甲。' else '按原文重新整理译文。' end end), ''), '')
  || case when modify = '是' and revision <> '' then chr(10) || '修改结果：' || revision else '' end as note from m""")
def decision_notes(spark, sf_dir):
    return decisions.results(decisions.parse(contents(spark, sf_dir)), "甲", "乙").select("event_id", "note")


# ---- contexts and differences ----

_LIMIT = 900


@query(f"""with recursive t as (select conv_id, turn, len(coalesce(text, '')) as size, row_number() over (partition by conv_id order by turn) as pos from conversations),
c as (select a.conv_id, a.pos, k, k // 2 + 1 as round, b.turn, b.size from t a, unnest(range(0, 12)) as u(k) left join t b on b.conv_id = a.conv_id and b.pos = a.pos + case when k % 2 = 0 then -(k // 2 + 1) else k // 2 + 1 end),
r as (select conv_id, pos, -1 as k, [-1]::bigint[] as items, 0::bigint as chars, 0::bigint as round, 0 as added, false as ended from t
  union all
  select conv_id, pos, k, case when take then list_append(items, turn) else items end, case when take then chars + size else chars end, round, case when take then added + 1 else added end, turn is not null and not take or ended from (
    select *, turn is not null and not ended and len(items) <= 12 and not (chars + size > {_LIMIT} and added > 0) as take from (
      select r.conv_id, r.pos, c.k, r.items, r.chars, c.turn, c.size, case when c.turn is null then r.round else c.round end as round, case when c.turn is not null and c.round <> r.round then 0 else r.added end as added,
        case when c.turn is not null and c.round <> r.round then false else r.ended end as ended from r join c on c.conv_id = r.conv_id and c.pos = r.pos and c.k = r.k + 1)))
select r.conv_id, t.turn as index, (len(items) - 1)::bigint as n, chars, array_to_string(list_sort(items[2:]), ' ') as near from r join t using (conv_id, pos) where k = 11""")
def context_under_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("index"), F.col("text").alias("source"), F.lit("").alias("target"), F.lit("").alias("counterpart"))
    x = context.context(c, ["conv_id"], chars=_LIMIT)
    return x.select("conv_id", "index", F.size("context").cast("long").alias("n"), F.aggregate("context", F.lit(0).cast("long"), lambda a, x: a + F.length(x["source"])).alias("chars"), F.array_join(F.transform("context", lambda x: x["index"].cast("string")), " ").alias("near"))


@query(f"""with recursive {PAIRS}, s as (select pair, l, r, string_split(l, '') as a, string_split(r, '') as b from p),
rec as (select pair, a, b, 0 as i, [0 for _ in range(0, len(b) + 1)] as best from s where len(a) * len(b) <= 50000 and l <> r
  union all
  select pair, a, b, i + 1, [0] || [list_max(base[1:j]) for j in range(1, len(b) + 1)] from (select *, [greatest(best[j + 1], case when b[j] = a[i + 1] then best[j] + 1 else 0 end) for j in range(1, len(b) + 1)] as base from rec where i < len(a))),
x as (select pair, best[-1] as same from rec where i = len(a)),
h as (select *, coalesce(list_position([a[i] = b[i] for i in range(1, least(len(a), len(b)) + 1)], false) - 1, least(len(a), len(b))) as head from s),
t as (select *, least(len(a), len(b)) - head as most from h),
e as (select *, head + coalesce(list_position([a[len(a) - i + 1] = b[len(b) - i + 1] for i in range(1, most + 1)], false) - 1, most) as ends from t)
select pair, coalesce(x.same, ends)::bigint as same, (len(a) - coalesce(x.same, ends))::bigint as deleted, (len(b) - coalesce(x.same, ends))::bigint as inserted, md5(l) as old, md5(r) as new from e left join x using (pair)""")
def character_differences(spark, sf_dir):
    """Lengths of what stays, goes and comes, and both texts put together again from the parts."""
    d = diff.diff(pairs(spark, sf_dir), "left", "right")
    size = lambda kind: F.aggregate(F.filter("diff", lambda x: x["type"] == kind), F.lit(0).cast("long"), lambda a, x: a + F.length(x["value"]))
    whole = lambda kind: F.md5(F.array_join(F.transform(F.filter("diff", lambda x: x["type"].isin("same", kind)), lambda x: x["value"]), ""))
    return d.select("pair", size("same").alias("same"), size("del").alias("deleted"), size("ins").alias("inserted"), whole("del").alias("old"), whole("ins").alias("new"))


@query("""with m as (select *, coalesce((role <> lag(role) over (partition by conv_id order by turn))::int, 0) as new from conversations), r as (select *, sum(new) over (partition by conv_id order by turn) as run from m)
select conv_id, run::bigint as run, role as type, md5(string_agg(text, '' order by turn)) as value from r group by conv_id, run, role""")
def compacted_runs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("type"), F.col("text").alias("value"))
    return diff.compact(c, ["conv_id"]).select("conv_id", F.col("run").cast("long").alias("run"), "type", F.md5("value").alias("value"))


# ---- rows ----


@query("select conv_id, md5(string_agg(text, chr(10) || chr(10) order by turn) filter (where text <> '')) as text from conversations group by conv_id")
def joined_texts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(rows.joined("text", "turn")).alias("text"))


@query("select l_orderkey as key, case when count(*) = 1 then max(l_linenumber::varchar || ':' || l_suppkey::varchar) else sum(l_linenumber)::bigint::varchar || ':' || sum(l_suppkey)::bigint::varchar end as relation from lineitem group by l_orderkey")
def relation_sums(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("relation", F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")))
    return li.groupBy(F.col("l_orderkey").alias("key")).agg(rows.relation_summary("relation", "l_linenumber", "l_suppkey").alias("relation"))


@query("select event_type, round(avg(value) filter (where event_id % 10 <> 0 and event_id % 11 <> 0), 6) as mean from events group by event_type")
def finite_means(spark, sf_dir):
    """Means over numbers among which some are none."""
    v = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").withColumn("v", v).groupBy("event_type").agg(F.round(browse.finite_mean("v"), 6).alias("mean"))


@query("""select doc_id as index, '{"index":' || doc_id::varchar || ',"lang":' || to_json(lang)::varchar || ',"source":' || to_json(source)::varchar || ',"cn":null}' as json from documents""")
def json_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), "lang", "source", F.lit(None).cast("string").alias("cn"))
    return sinks.json_rows(d)


# ---- progress, times, names ----


@query("""select event_id, case when event_id % 2 = 0 then floor((2 + 82 * greatest(0.0::double, least(100.0::double, round(value * 3 - 20, 3))) / 100) * 10 + 0.5) / 10 end as percent, case when event_id % 2 = 0 then event_type end as label from events""")
def progress_lines(spark, sf_dir):
    """Lines of a program's output: every other one tells of its progress."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('@@x@@{"percent": '), F.round(F.col("value") * 3 - 20, 3).cast("string"), F.lit(', "label": "'), "event_type", F.lit('", "current": 1, "total": 9}'))).otherwise(F.concat(F.lit("reading "), "event_type"))
    p = e.select("event_id", T.progress(line, "@@x@@", 2.0, 84.0).alias("p"))
    return p.select("event_id", "p.percent", "p.label")


@query(r"""with w as (select conv_id, replace(replace(string_agg(text, '' order by turn), chr(13) || chr(10), chr(10)), chr(13), chr(10)) as t from conversations group by conv_id), l as (select conv_id, string_split(regexp_replace(t, '\n$', ''), chr(10)) as l from w where t <> '')
select conv_id, unnest(range(len(l)))::bigint as line_no, md5(unnest(l)) as line from l""")
def reassembled_lines(spark, sf_dir):
    """Turns as pieces of one output, whose lines go on from piece to piece."""
    found = T.line_rows(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")
    return found.select("conv_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line"))


@query("""select event_id, strftime(ts, '%m%d-%H%M') as stamp, case when floor(greatest(value, 0)) < 60 then floor(greatest(value, 0))::bigint::varchar || ' 秒' else (floor(greatest(value, 0))::bigint // 60)::varchar || ' 分 ' || lpad((floor(greatest(value, 0))::bigint % 60)::varchar, 2, '0') || ' 秒' end as duration,
  case when event_id % 2 = 0 then '/home/u/' || event_type else event_type end as path from events""")
def stamps(spark, sf_dir):
    path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(' "~/'), "event_type", F.lit('" '))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.short_timestamp("ts").alias("stamp"), T.duration(F.col("value") * 1000).alias("duration"), T.expand_path(path, "/home/u").alias("path"))


@query(f"""with x as (select c_custkey, c_name || chr(31) || c_mktsegment || chr(31) || case when c_custkey % 2 = 0 then '' else 'tw' end || case when c_custkey % 2 = 0 then chr(31) || 'bilingual' else '' end || chr(31) || 'txt' || chr(31) || '{{}}' || chr(31) || '{{"ruby":true}}' as x from customer),
h as (select c_custkey, {_FNV.format('x')} as h from x) select c_custkey, {_BASE36.format('h')} as signature from h""")
def project_signatures(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    two = F.col("c_custkey") % 2 == 0
    of = lambda tw, mode: hashing.project_signature({"jp": F.col("c_name"), "cn": F.col("c_mktsegment"), "tw": tw}, "txt", "{}", '{"ruby":true}', mode)
    return c.select("c_custkey", F.when(two, of("", "bilingual")).otherwise(of("tw", "trilingual")).alias("signature"))


# ---- script ----

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_TRAD, _SIMP = script.TRADITIONAL[: len(_LETTERS)], script.SIMPLIFIED[: len(_LETTERS)]
_AS_TRADITIONAL, _AS_SIMPLIFIED = f"translate({{0}}, '{_LETTERS}', '{_TRAD}')", f"translate({{0}}, '{_LETTERS}', '{_SIMP}')"


@query(f"select doc_id, md5({_AS_SIMPLIFIED.format('text')}) as converted, md5(trim({_AS_TRADITIONAL.format('text')}, ' ' || chr(10) || chr(9))) as back from documents")
def converted_script(spark, sf_dir):
    """Documents whose small letters are written as traditional characters, in simplified script and back."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_AS_TRADITIONAL.format("text")).alias("t"))
    return d.select("doc_id", F.md5(script.to_cn("t")).alias("converted"), F.md5(script.to_target_script(script.to_cn("t"), F.lit("tw"))).alias("back"))


_ZH = f"regexp_replace(lower({_AS_SIMPLIFIED}), '[{T.CJK_DROPPED}\\s]', '', 'g')"


@query(f"""with {PAIRS}, s as (select pair, {_ZH.format('l')} as a, {_ZH.format('r')} as b from p), g as (select *, {GRAMS.format('a')} as ga, {GRAMS.format('b')} as gb from s)
select pair, md5(a) as normal, round({JACCARD}, 6) as similarity, round({JACCARD} * 0.72::double + least(greatest(len(a), 1), greatest(len(b), 1))::double / greatest(len(a), len(b), 1) * 0.28::double, 6) as score from g""")
def script_similarity(spark, sf_dir):
    """The version score of texts in the two scripts, by the normal form that drops all but characters."""
    p = pairs(spark, sf_dir).select("pair", align.cjk(F.expr(_AS_TRADITIONAL.format("`left`"))).alias("a"), align.cjk(F.expr(_AS_SIMPLIFIED.format("`right`"))).alias("b"))
    g = p.select("pair", F.md5("a").alias("normal"), T.bigrams(F.col("a")).alias("ga"), T.bigrams(F.col("b")).alias("gb"), F.length("a").alias("x"), F.length("b").alias("y"))
    return g.select("pair", "normal", F.round(T.jaccard(F.col("ga"), F.col("gb")), 6).alias("similarity"), F.round(T.paragraph_score(F.col("ga"), F.col("gb"), F.col("x"), F.col("y"), F.lit(False)), 6).alias("score"))


# ---- normal texts, counters, rows as a page shows them ----


@query(r"""with t as (select doc_id, chr(65279) || replace(replace(replace(text, '. ', '.' || chr(160) || ' ' || chr(13) || chr(10)), ', ', ',' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10) || '  '), chr(10), chr(10)) as t from documents),
a as (select doc_id, replace(replace(replace(replace(t, chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' ') as t from t),
b as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') as t from a)
select doc_id, md5(trim(t, ' ' || chr(9) || chr(10))) as text from b""")
def document_texts(spark, sf_dir):
    """Documents with a byte order mark, hard blanks, line ends of two kinds and too many empty lines, in normal form."""
    t = F.replace("text", F.lit(". "), F.lit(".  \r\n"))
    t = F.concat(F.lit("﻿"), F.replace(t, F.lit(", "), F.lit(",\t\n\n\n\n  ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.document_text(t)).alias("text"))


_STATUS = ["rule-prefilter", "similarity-prefilter", "rule-conflict", "suggestion", "error", "same", "target-better"]


@query(f"""with s as (select event_type, {_STATUS!r}[(event_id % 7)::int + 1] as status from events)
select event_type, count(*) as processed, count(*) filter (where status not in ('rule-conflict', 'suggestion', 'error')) as handled, count(*) filter (where status in ('rule-prefilter', 'similarity-prefilter', 'rule-conflict')) as prefiltered,
  count(*) filter (where status = 'rule-prefilter') as rule_prefiltered, count(*) filter (where status = 'similarity-prefilter') as similarity_prefiltered, count(*) filter (where status = 'rule-conflict') as structured_conflicts,
  count(*) filter (where status = 'suggestion') as suggested, count(*) filter (where status = 'error') as errors, count(*) filter (where status not in ('rule-prefilter', 'similarity-prefilter', 'rule-conflict')) as model_processed from s group by event_type""")
def all_counters(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("event_id") % 7 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_type", status.alias("status")).withColumn("done", ~F.col("status").isin("rule-conflict", "suggestion", "error"))
    return prefilter.counters(e, "event_type")


@query("""with r as (select doc_id, 0.05::double * (doc_id * 7 % 20) as score, case when doc_id % 3 > 0 then 0.031::double * (doc_id % 30) end as jp from documents)
select doc_id as index, case when score >= 0.35 then 'ok' when score >= 0.18 then 'watch' else 'review' end as cls, floor(score * 100 + 0.5)::bigint::varchar || '%' as score_text, case when jp is null then '' else floor(jp * 100 + 0.5)::bigint::varchar || '%' end as jp_align_score_text, doc_id::varchar as signature from r""")
def client_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), (F.col("doc_id") * 7 % 20 * 0.05).alias("score"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 30 * 0.031).alias("jp_align_score"))
    return browse.client_rows(d, F.col("index").cast("string")).select("index", "cls", "score_text", "jp_align_score_text", "signature")


@query("""with f as (select page_id // 25 as g, case page_id // 25 % 3 when 0 then 'txt' when 1 then 'EPUB' else case page_id % 2 when 0 then 'txt' else 'md' end end as ext from pages)
select g as folder, case when bool_and(lower(ext) = 'txt') then 'txt' when bool_and(lower(ext) = 'epub') then 'epub' else 'document' end as input_mode from f group by g""")
def input_modes(spark, sf_dir):
    folder = F.floor(F.col("page_id") / 25)
    ext = F.when(folder % 3 == 0, "txt").when(folder % 3 == 1, "EPUB").when(F.col("page_id") % 2 == 0, "txt").otherwise("md")
    return plain.input_mode(table(spark, sf_dir, "pages").select(folder.alias("folder"), F.concat(F.lit("in/x."), ext).alias("path")), "path", "folder")
