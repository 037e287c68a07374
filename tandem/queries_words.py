"""Registered queries of word differences, of phrase-wise conversion and of written files, with SQL; the differences are worked out there by recursion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import script
from .operators import diff
from .plans import sinks, store
from .registry import query, table

_WORD = r"a-zA-Z0-9_\x{00AD}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02C6}\x{02C8}-\x{02D7}\x{02DE}-\x{02FF}\x{1E00}-\x{1EFF}"
_BLANK = r"\t\x0B\f \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _tokens(c: str) -> str:
    return rf"regexp_extract_all({c}, '\r?\n|[{_WORD}]+|[{_BLANK}]+|[^{_WORD}]')"


# the place that a front reaches on diagonal k from place s: as far as both sides are equal
_ALONG = "s + coalesce(list_position([x[s + i + 1] = y[s - k + i + 1] for i in range(0, least(n - s, m - s + k))], false) - 1, least(n - s, m - s + k))"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(65279)"


@query(rf"""with recursive t as (select conv_id, turn, coalesce(text, '') as b, coalesce(lag(text) over (partition by conv_id order by turn), '') as a from conversations),
tok as (select conv_id, turn, {_tokens('a')} as x, {_tokens('b')} as y from t),
sized as (select *, len(x)::int as n, len(y)::int as m from tok),
front(conv_id, turn, x, y, n, m, d, v) as (
  select conv_id, turn, x, y, n, m, 0, [case when i = m + 2 then list_reduce([0, 0], lambda s, k: {_ALONG}) end for i in range(1, n + m + 4)] from sized
  union all
  select conv_id, turn, x, y, n, m, d + 1, [case when (i - m - 2 + d) % 2 = 0 or abs(i - m - 2) > d + 1 then v[i] when c[i] is null then null else list_reduce([c[i], (i - m - 2)::int], lambda s, k: {_ALONG}) end for i in range(1, n + m + 4)]
  from (select *, [case when v[i + 1] - (i - m - 2) <= m and v[i + 1] is not null and not coalesce(v[i - 1] + 1 <= n and v[i - 1] + 1 > v[i + 1], false) then v[i + 1] when v[i - 1] + 1 <= n then v[i - 1] + 1 end::int for i in range(1, n + m + 4)] as c
    from front where coalesce(v[n + 2], -1) < n)),
walk(conv_id, turn, d, k, kind, place) as (
  select conv_id, turn, max(d), any_value(n - m), null::varchar, null::int from front group by conv_id, turn
  union all
  select conv_id, turn, d - 1, case when ins then k + 1 else k - 1 end, case when ins then 'ins' else 'del' end, case when ins then up - k - 1 else down - 1 end from (
    select w.conv_id, w.turn, w.d, w.k, up, down, coalesce(up - k <= m, false) and not coalesce(down <= n and down > up, false) as ins from (
      select w.conv_id, w.turn, w.d, w.k, f.n, f.m, f.v[w.k + f.m + 3] as up, f.v[w.k + f.m + 1] + 1 as down from walk w join front f on f.conv_id = w.conv_id and f.turn = w.turn and f.d = w.d - 1) w)),
e as (select *, count(*) filter (where kind = 'del') over w - (kind = 'del')::int as dels, count(*) filter (where kind = 'ins') over w - (kind = 'ins')::int as inss from walk where kind is not null window w as (partition by conv_id, turn order by d)),
xs as (select conv_id, turn, unnest(x) as value, unnest(range(n)) as i from sized), ys as (select conv_id, turn, unnest(y) as value, unnest(range(m)) as j from sized),
sx as (select *, row_number() over (partition by conv_id, turn order by i) as r from xs where not exists (select 1 from e where e.conv_id = xs.conv_id and e.turn = xs.turn and kind = 'del' and place = i)),
sy as (select *, row_number() over (partition by conv_id, turn order by j) as r from ys where not exists (select 1 from e where e.conv_id = ys.conv_id and e.turn = ys.turn and kind = 'ins' and place = j)),
every as (select sx.conv_id, sx.turn, 'same' as type, sx.value, i + j as spot from sx join sy using (conv_id, turn, r)
  union all select conv_id, turn, 'del', xs.value, 2 * place - dels + inss from e join xs using (conv_id, turn) where kind = 'del' and i = place
  union all select conv_id, turn, 'ins', ys.value, 2 * place - inss + dels from e join ys using (conv_id, turn) where kind = 'ins' and j = place),
runs as (select *, sum(new) over (partition by conv_id, turn order by spot) as run from (select *, case when type = lag(type) over (partition by conv_id, turn order by spot) then 0 else 1 end as new from every)),
parts as (select conv_id, turn, run, type, string_agg(value, '' order by spot) as value from runs group by conv_id, turn, run, type),
lines as (select conv_id, turn, run, case when type = 'del' then '- ' else '+ ' end || trim(value, {_TRIM}) as line from parts where type <> 'same' and trim(value, {_TRIM}) <> ''),
changes as (select conv_id, turn, string_agg(line, chr(10) order by run) as changes, count(*) as n_lines from (select *, row_number() over (partition by conv_id, turn order by run) as p from lines) where p <= 24 group by conv_id, turn)
select conv_id, turn, count(parts.run) as n_parts, md5(coalesce(string_agg(type || ':' || value, chr(31) order by parts.run), '')) as parts, coalesce(any_value(n_lines), 0) as n_lines, md5(coalesce(any_value(changes), '')) as changes
from sized left join parts using (conv_id, turn) left join changes using (conv_id, turn) group by conv_id, turn""")
def word_differences(spark, sf_dir):
    """Each turn of a conversation beside the turn before: all parts of the difference by words, and its lines as a model is told them."""
    # dealt by number, as little data that is much work would else come to few tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = table(spark, sf_dir, "conversations").repartition(parts, "conv_id").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    d = c.select("conv_id", "turn", diff.word_diff(F.col("before"), F.col("text")).alias("parts"))
    lines = diff.word_changes(F.col("parts"))
    joined = F.array_join(F.transform("parts", lambda p: F.concat(p["type"], F.lit(":"), p["value"])), "\x1f")
    return d.select("conv_id", "turn", F.size("parts").cast("long").alias("n_parts"), F.md5(joined).alias("parts"), F.size(lines).cast("long").alias("n_lines"), F.md5(F.array_join(lines, "\n")).alias("changes"))


_PHRASES = r"""w as (select regexp_extract_all(text, '[a-z]+') as w from benchmark),
phrases as (select distinct unnest([w[i] || case when i % 3 = 0 then '' else ' ' || w[i + 1] end for i in range(1, len(w)) if len(w[i]) > 3]) as phrase from w),
pattern as (select '(' || string_agg(phrase, '|' order by len(phrase) desc, phrase) || ')' as pattern from phrases)"""


@query(f"with {_PHRASES} select doc_id, md5(c) as converted, len(c)::bigint as n from (select doc_id, regexp_replace(text, (select pattern from pattern), '<\\1>', 'g') as c from documents)")
def converted_phrases(spark, sf_dir):
    """Documents converted by a dictionary of words and pairs of words that the benchmark's texts give."""
    words = F.regexp_extract_all("text", F.lit("([a-z]+)"))
    b = table(spark, sf_dir, "benchmark").select(F.posexplode(words).alias("i", "word"), words.alias("w")).where("i < size(w) - 1 and length(word) > 3")
    phrase = F.when((F.col("i") + 1) % 3 == 0, F.col("word")).otherwise(F.concat("word", F.lit(" "), F.get("w", F.col("i") + 1)))
    pairs = script.dictionary(b.select(phrase.alias("phrase")).distinct().select("phrase", F.concat(F.lit("<"), "phrase", F.lit(">")).alias("to")), "phrase", "to")
    d = table(spark, sf_dir, "documents").select("doc_id", script.converter(pairs)("text").alias("c"))
    return d.select("doc_id", F.md5("c").alias("converted"), F.length("c").cast("long").alias("n"))


# ---- files of projects, written and read back ----


@query("""select lang, md5('index,chapter,relation,score,jpAlignScore,jp,cn' || chr(10) || string_agg('"' || doc_id::varchar || '","' || replace(lang, '"', '""') || '","' || source || '","","","' || replace(text, '"', '""') || '",""' || chr(10), '' order by doc_id)) as content from documents group by lang""")
def csv_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("index"), F.col("lang").alias("chapter"), F.col("source").alias("relation"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("jp_align_score"), F.col("text").alias("jp"), F.lit(None).cast("string").alias("cn"))
    sinks.write_csv(d, path := f"{store.scratch(spark)}/csv", "bilingual", ("lang",))
    return sinks.digests(spark, path, ("lang",)).select("lang", F.col("md5").alias("content"))


@query("""select conv_id, count(*) as n, md5(string_agg(turn::varchar || ':' || coalesce(role, '-') || ':' || coalesce(text, '-'), chr(31) order by turn)) as rows from conversations group by conv_id""")
def document_files(spark, sf_dir):
    """A JSON document for each conversation, read back as JSON."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("index"), "role", "text")
    sinks.write_documents(c, path := f"{store.scratch(spark)}/json", ("conv_id",))
    read = sinks.read_files(spark, path, ("conv_id",), {"conv_id": "long"})
    rows = F.from_json("content", "project string, files string, labels string, counts string, rowsSignature string, rows array<struct<index:bigint,role:string,text:string>>")["rows"]
    line = lambda r: F.concat_ws(":", r["index"].cast("string"), F.coalesce(r["role"], F.lit("-")), F.coalesce(r["text"], F.lit("-")))
    return read.select("conv_id", rows.alias("r")).select("conv_id", F.size("r").cast("long").alias("n"), F.md5(F.array_join(F.transform("r", line), "\x1f")).alias("rows"))
