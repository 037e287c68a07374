"""The registered queries over the given tables and, where SQL says the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import hashing
from .functions import text as T
from .operators import align, browse, context, diff, notes, prefilter, rows, segment
from .plans import compare, sinks, store
from .registry import GRAMS, JACCARD, PAIRS, QUERIES, SQL, STRUCTURED, TOKENS, canon, pairs, query, simil, table
from .sources import epub, markup
from .streaming import results

__all__ = ["QUERIES", "SQL"]

# ---- text functions ----


@query(f"select doc_id, md5(c) as canonical, md5({simil('c')}) as similarity_text, len(c)::bigint as n, {STRUCTURED.format('c')} as structured from (select doc_id, {canon('text')} as c from documents)")
def canonical_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.canonical("text").alias("c"))
    return d.select("doc_id", F.md5("c").alias("canonical"), F.md5(T.similarity_text(F.col("c"))).alias("similarity_text"), F.length("c").cast("long").alias("n"), T.is_structured(F.col("c")).alias("structured"))


@query(f"select item_id, len(t)::bigint as n, array_to_string(t, ' ') as tokens from (select item_id, {TOKENS.format('c')} as t from (select item_id, {canon('text')} as c from benchmark))")
def protected_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").select("item_id", T.protected_tokens(T.canonical("text")).alias("t"))
    return d.select("item_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query(rf"""select doc_id, len(regexp_replace(text, '\s+', '', 'g'))::bigint as n, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as collapsed,
  md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as escaped,
  md5(case when len(text) <= 1200 then text else left(text, 1200) || chr(10) || '...（已截断，完整内容已发送给模型）' end) as preview from documents""")
def text_forms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.text_length("text").cast("long").alias("n"), F.md5(T.collapse("text")).alias("collapsed"), F.md5(T.escape_html("text")).alias("escaped"), F.md5(T.preview("text")).alias("preview"))


@query(f"""with {PAIRS}, s as (select pair, {simil(canon('l'))} as a, {simil(canon('r'))} as b from p),
g as (select *, {GRAMS.format('a')} as ga, {GRAMS.format('b')} as gb from s),
j as (select *, {JACCARD} as jaccard, least(greatest(len(a), 1), greatest(len(b), 1))::double / greatest(len(a), len(b), 1) as length_ratio from g)
select pair, round(jaccard, 6) as jaccard, round(length_ratio, 6) as length_ratio, round(jaccard * 0.72::double + length_ratio * 0.28::double, 6) as score, len(ga)::bigint as n_left, len(gb)::bigint as n_right from j""")
def bigram_similarity(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumns({"a": align.generic("left"), "b": align.generic("right")})
    g = p.select("pair", T.bigrams(F.col("a")).alias("ga"), T.bigrams(F.col("b")).alias("gb"), F.length("a").alias("x"), F.length("b").alias("y"))
    j = g.withColumns({"j": T.jaccard(F.col("ga"), F.col("gb")), "r": T.length_ratio(F.col("x"), F.col("y"))})
    return j.select("pair", F.round("j", 6).alias("jaccard"), F.round("r", 6).alias("length_ratio"), F.round(F.col("j") * 0.72 + F.col("r") * 0.28, 6).alias("score"), F.size("ga").cast("long").alias("n_left"), F.size("gb").cast("long").alias("n_right"))


@query(r"""with m as (select doc_id, regexp_replace(replace(text, chr(13), chr(10)), '([。！？!?][。！？!?」』）)】]*)', '\1' || chr(1), 'g') as t from documents),
u as (select doc_id, [trim(x, ' ' || chr(10) || chr(9)) for x in string_split(t, chr(1))] as u from m), f as (select doc_id, [x for x in u if x <> ''] as u from u)
select doc_id, len(u)::bigint as n, md5(array_to_string(u, '|')) as units from f""")
def sentence_units(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.comparable_units("text").alias("u"))
    return d.select("doc_id", F.size("u").cast("long").alias("n"), F.md5(F.array_join("u", "|")).alias("units"))


_FNV = "list_reduce(list_prepend(2166136261::bigint, [unicode(c)::bigint for c in string_split({0}, '') if c <> '']), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"
_BASE36 = "ltrim(array_to_string([substr('0123456789abcdefghijklmnopqrstuvwxyz', (({0} // (36 ** k)::bigint) % 36)::int + 1, 1) for k in [6, 5, 4, 3, 2, 1, 0]], ''), '0')"
_SIGNED = f"s as (select conv_id, turn, {_FNV.format('x')} as h from (select conv_id, turn, array_to_string([coalesce(text, ''), coalesce(role, ''), '', '', ''], chr(31)) as x from conversations)), g as (select conv_id, turn, {_BASE36.format('h')} as signature from s)"


@query(f"with {_SIGNED} select conv_id, turn, signature from g")
def row_signature(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", hashing.row_signature("text", "role", F.lit(""), F.lit(""), F.lit("")).alias("signature"))


@query(f"with {_SIGNED}, t as (select conv_id, count(*) as row_count, string_agg(turn::varchar || ':' || signature, chr(30) order by turn, signature) as x from g group by conv_id), h as (select conv_id, row_count, {_FNV.format('x')} as h from t) select conv_id, {_BASE36.format('h')} as rows_signature, row_count from h")
def table_signature(spark, sf_dir):
    signed = row_signature(spark, sf_dir).withColumnRenamed("turn", "index")
    return compare.signatures(signed, ["conv_id"])


@query(r"""select event_id, case when v > 1 then least(greatest(v / 100, 0.5), 1.0) else greatest(v, 0.5) end as ratio, greatest(1, least(12, floor(v + 0.5)::int)) as workers from (select event_id, value as v from events where value is not null)""")
def clamped_settings(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select("event_id", T.percent_ratio(F.col("value").cast("string")).alias("ratio"), T.clamp_integer("value", 1, 12, 3).alias("workers"))


@query(r"""with u as (select page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as scheme, lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) as host, regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?[^/?#:@]+(?::(\d*))?', 1) as port,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path from pages)
select page_id, case when scheme in ('http', 'https') and host <> '' then scheme || '://' || host || case when port = '' or (scheme = 'http' and port = '80') or (scheme = 'https' and port = '443') then '' else ':' || port end || case when path = '' then '/' else path end
  else regexp_replace(url, '[?#].*$', '') end as shown, regexp_replace(url, '/+$', '') || '/models' as endpoint from u""")
def request_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.display_url("url").alias("shown"), T.api_url(F.col("url"), "/models").alias("endpoint"))


# ---- pre-screening ----

_WIDE = "translate({0}, '0123456789', '０１２３４５６７８９')"
#: Each document beside a variant of itself, of ten kinds by doc_id: (source, left, right) in SQL that Spark and the oracle read alike.
VARIANTS = [
    ("''", "text", "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"), ("''", "text", "replace(text, ' ', '  ')"), ("''", "text", "replace(text, ',', ';')"), ("''", "text", "translate(text, 'éêèöäüñó', 'èéêöäüóñ')"), ("''", "concat(text, ' 7')", "concat(text, ' 8')"),
    ("''", "cast(doc_id as varchar(20))", "cast(doc_id + 1 as varchar(20))"), ("cast(doc_id + 1 as varchar(20))", "cast(doc_id as varchar(20))", "cast(doc_id as varchar(20))"), ("text", "''", "' '"),
    ("''", "cast(doc_id as varchar(20))", _WIDE.format("cast(doc_id as varchar(20))")), ("text", "text", "translate(text, 'éêèöäüñó', 'zzzzzzzz')"),
]
_PICK = lambda part: "case doc_id % 10 " + " ".join(f"when {n} then {v[part]}" for n, v in enumerate(VARIANTS)) + " end"
_NARROW = "translate({0}, '０１２３４５６７８９', '0123456789')"
_CLASSIFY = f"""p as (select doc_id as pair, lang, {_PICK(0)} as s, {_PICK(1)} as l, {_PICK(2)} as r from documents), c as (select pair, lang, s <> '' as has_source, {canon(_NARROW.format('s'))} as o, {canon(_NARROW.format('l'))} as a, {canon(_NARROW.format('r'))} as b from p),
s as (select *, {simil('a')} as x, {simil('b')} as y, {STRUCTURED.format('o')} as so, {STRUCTURED.format('a')} as sa, {STRUCTURED.format('b')} as sb from c),
g as (select *, {GRAMS.format('x')} as ga, {GRAMS.format('y')} as gb from s),
h as (select *, case when a = '' and b = '' then 'rule-empty' when a <> '' and a = b and so and sa and o <> a then 'structured-differs' when a <> '' and a = b then 'rule-equivalent' when (sa or a = '') and (sb or b = '') then 'structured-conflict'
  when not sa and not sb and least(len(x), len(y)) >= 8 and least(len(x), len(y))::double / greatest(len(x), len(y)) >= 0.9 and {TOKENS.format('a')} = {TOKENS.format('b')} and {JACCARD} >= 0.92 then 'similarity' end as step, {JACCARD} as j from g),
k as (select *, case when step = 'structured-differs' then 'structured-conflict' else step end as kind from h)"""


def variants(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pair"), "lang", F.expr(_PICK(0)).alias("source"), F.expr(_PICK(1)).alias("left"), F.expr(_PICK(2)).alias("right"), F.lit(0.0).alias("score"))


def classified(spark, sf_dir):
    return prefilter.classify(variants(spark, sf_dir))


@query(f"with {_CLASSIFY} select pair, kind, round(case when kind = 'similarity' then j end, 6) as similarity from k")
def prefilter_kind(spark, sf_dir):
    return classified(spark, sf_dir).select("pair", "kind", F.round("similarity", 6).alias("similarity"))


@query(f"with {_CLASSIFY} select lang, coalesce(kind, 'model') as kind, count(*) as n from k group by all")
def prefilter_counts(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("lang", F.coalesce("kind", F.lit("model")).alias("kind")).agg(F.count("*").alias("n"))


_REASON = " ".join(f"when '{k}' then '{v}'" for k, v in prefilter.REASONS.items())


@query(f"""with {_CLASSIFY} select pair as index, case kind when 'structured-conflict' then 'rule-conflict' when 'similarity' then 'similarity-prefilter' else 'rule-prefilter' end as status, kind <> 'structured-conflict' as done,
  case when kind = 'similarity' then '[相似度预筛]' else '[规则预筛]' end || chr(10) || '语义是否相同：' || case when kind = 'structured-conflict' then '待人工确认' else '相同' end || chr(10) || '是否需要修改：' || case when kind = 'structured-conflict' then '待人工确认' else '否' end || chr(10)
  || '分析：' || case when kind = 'similarity' then '非原文 B 与 非原文 C 的受保护正文相似度为 ' || floor(j * 100 + 0.5)::int::varchar || '%。' else case step {_REASON} end end || case when has_source then ' 参照列：原文 A。' else '' end as note from k where kind is not null""")
def prefilter_results(spark, sf_dir):
    c = classified(spark, sf_dir).withColumns({"index": F.col("pair"), "signature": F.lit("")})
    return prefilter.results(c).select("index", "status", "done", "note")


@query("select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def pending_rows(spark, sf_dir):
    return prefilter.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("select d.doc_id from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)")
def selected_rows(spark, sf_dir):
    return browse.among(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


# ---- segmentation and sources ----


@query(r"""with b as (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as block from documents),
o as (select *, (sum(len(t) + 2) over (partition by doc_id order by block) - 2)::bigint as e from b)
select doc_id, block, e - len(t) as start, e as end, md5(t) as block_text from o""")
def block_offsets(spark, sf_dir):
    """Lines as blocks: line breaks are doubled, as the texts have no blank lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return segment.block_ranges(d).select("doc_id", F.col("block").cast("long").alias("block"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("block_text").alias("block_text"))


_PARAGRAPHS = r"""b as (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as n from documents), c as (select doc_id, n, trim(regexp_replace(t, '\s+', ' ', 'g')) as text from b),
q as (select doc_id, (row_number() over (partition by doc_id order by n) - 1)::bigint as source_index, text from c where text <> '' and not regexp_matches(text, '^[\-─－—＊*☆★\s]+$'))"""


def paragraphs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("cn").alias("lang"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return segment.paragraphs(d, ["doc_id"])


@query(f"with {_PARAGRAPHS} select doc_id, source_index, '正文' as chapter, len(text)::bigint as chars, md5(text) as text from q")
def document_paragraphs(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", F.col("source_index").cast("long").alias("source_index"), "chapter", F.col("chars").cast("long").alias("chars"), F.md5("text").alias("text"))


@query(f"with {_PARAGRAPHS} select doc_id, count(*) as n, sum(len(text))::bigint as chars from q group by doc_id")
def paragraph_counts(spark, sf_dir):
    return paragraphs(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("chars").cast("long").alias("chars"))


@query(r"""with t as (select conv_id, turn, trim(regexp_replace(case when role = 'user' then '第' || (turn + 1)::varchar || '章 ' || replace(text, chr(10), ' ') else replace(text, chr(10), ' ') end, '\s+', ' ', 'g')) as x, role = 'user' as title from conversations),
f as (select *, last_value(case when title then x end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as chapter from t)
select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::bigint as source_index, md5(coalesce(chapter, '正文')) as chapter, md5(x) as text from f where not title and x <> ''""")
def chapter_forward_fill(spark, sf_dir):
    """Conversations as texts: what users say is a heading, and the chapter of what follows."""
    said = F.regexp_replace("text", "\n", " ")
    block = F.when(F.col("role") == "user", F.concat(F.lit("第"), (F.col("turn") + 1).cast("string"), F.lit("章 "), said)).otherwise(said)
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", block.alias("b")).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "b"))), lambda x: x["b"]), "\n\n").alias("text"))
    p = segment.paragraphs(docs.withColumn("lang", F.lit("cn")), ["conv_id"])
    return p.select("conv_id", F.col("source_index").cast("long").alias("source_index"), F.md5("chapter").alias("chapter"), F.md5("text").alias("text"))


@query(r"select page_id, len(regexp_extract_all(html, '(?i)<\s*a\b'))::bigint as links, len(regexp_extract_all(html, '(?i)<\s*img\b|<\s*image\b'))::bigint as images, regexp_matches(html, '(?i)<\s*nav\b') as has_nav from pages")
def page_markup(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", markup.link_count(F.col("html")).cast("long").alias("links"), markup.image_count(F.col("html")).cast("long").alias("images"), F.col("html").rlike(epub.NAV_MARK).alias("has_nav"))


# ---- joins by interval and band, alignment ----

_SPANS = "i as (select l_suppkey as k, l_partkey as s, l_partkey + l_quantity::bigint as e, l_returnflag as f, l_orderkey, l_linenumber from lineitem)"


def intervals(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), F.col("l_returnflag").alias("f"))


@query(f"""with {_SPANS}, m as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as reach from i),
n as (select k, s, e, sum(case when reach is null or s >= reach then 1 else 0 end) over (partition by k order by s, e rows between unbounded preceding and current row) as island from m)
select k, island::bigint as island, min(s) as start, max(e) as end, count(*) as n from n group by k, island""")
def interval_islands(spark, sf_dir):
    i = intervals(spark, sf_dir)
    marked = rows.islands(i, ["k"], i.count())
    return marked.groupBy("k", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


@query(f"with {_SPANS} select a.k, count(*) as n, sum(least(a.e, b.e) - greatest(a.s, b.s))::bigint as shared from i a join i b on a.k = b.k and a.f = 'A' and b.f = 'R' and a.s < b.e and b.s < a.e group by a.k")
def interval_overlaps(spark, sf_dir):
    i = intervals(spark, sf_dir)
    j = rows.overlap_join(i.where("f = 'A'"), i.where("f = 'R'"), ["k"])
    return j.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("shared"))


@query(f"""with {_SPANS}, m as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as reach from i where e > s and f in ('A', 'R')),
n as (select *, sum(case when reach is null or s >= reach then 1 else 0 end) over (partition by k order by s, e rows between unbounded preceding and current row) as island from m),
b as (select k, island, count(*) filter (where f = 'A') as v, count(*) filter (where f = 'R') as s from n group by k, island having count(*) filter (where f = 'A') > 0 and count(*) filter (where f = 'R') > 0)
select k, row_number() over (partition by k order by island) as row, v as versions, s as sources from b""")
def admitted_rows(spark, sf_dir):
    i = intervals(spark, sf_dir).withColumn("group", F.lit(0))
    at = rows.admitted(i.where("f = 'A'"), i.where("f = 'R'"), ["k"])
    return at.groupBy("k", F.col("row").cast("long").alias("row")).agg(F.count_if(F.col("kind") == "version").alias("versions"), F.count_if(F.col("kind") == "source").alias("sources"))


def vectors(spark, sf_dir, odd: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == odd)
    idx = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select("label", idx.alias("idx"), F.col("embedding").alias("vector"))


_VECTORS = "a as (select label, row_number() over (partition by label order by vec_id) - 1 as i, embedding as x from embeddings where vec_id % 2 = 0), b as (select label, row_number() over (partition by label order by vec_id) - 1 as j, embedding as y from embeddings where vec_id % 2 = 1), d as (select a.label, i, j, round(list_sum([x[k]::double * y[k]::double for k in range(1, len(x) + 1)]), 6) as score from a join b on a.label = b.label and abs(i - j) <= 6)"


@query(f"with {_VECTORS}, r as (select *, row_number() over (partition by label, i order by score desc, j) as p, row_number() over (partition by label, j order by score desc, i) as q from d) select label, i, j, score from r where p = 1 and q = 1")
def mutual_best_vectors(spark, sf_dir):
    a, b = vectors(spark, sf_dir, 0), vectors(spark, sf_dir, 1)
    p = align.band_candidates(a, b, ["label"], align.RADIUS, F.round(align.dot(F.col("l.vector"), F.col("r.vector")), 6).alias("score"))
    return align.mutual_best(p, ["label"]).select("label", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "score")


@query()
def comparison_rows(spark, sf_dir):
    """Documents 3n, 3n + 1 and 3n + 2 as source and two versions, through the whole plan."""
    p = paragraphs(spark, sf_dir).withColumns({"project": F.floor(F.col("doc_id") / 3), "lang": F.element_at(F.array(F.lit("jp"), F.lit("cn"), F.lit("tw")), (F.col("doc_id") % 3 + 1).cast("int"))}).drop("doc_id")
    r = compare.compare(p, ["project"], normal=align.generic)
    return r.select("project", "index", "relation", F.round("score", 6).alias("score"), F.round("jp_align_score", 6).alias("jp_align_score"), "cn_chars", "tw_chars", "jp_chars", "signature")


# ---- browsing ----

_BANDS = f"{PAIRS}, s as (select pair, lang, {simil(canon('l'))} as a, {simil(canon('r'))} as b, l from p), g as (select *, {GRAMS.format('a')} as ga, {GRAMS.format('b')} as gb from s), j as (select pair, lang, l, {JACCARD} * 0.72::double + least(greatest(len(a), 1), greatest(len(b), 1))::double / greatest(len(a), len(b), 1) * 0.28::double as score from g)"


@query(f"with {_BANDS} select lang, count(*) as total, count(*) filter (where score < 0.18) as review, count(*) filter (where score >= 0.18 and score < 0.35) as watch, count(*) filter (where score >= 0.35) as ok, count(*) filter (where l = '') as empty_source, round(sum(score) / count(*), 6) as mean_score from j group by lang")
def band_statistics(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumns({"a": align.generic("left"), "b": align.generic("right")})
    s = T.paragraph_score(T.bigrams(F.col("a")), T.bigrams(F.col("b")), F.length("a"), F.length("b"), F.lit(False))
    st = browse.statistics(p.select("lang", F.col("left").alias("jp"), s.alias("score")), "lang")
    return st.withColumn("mean_score", F.round("mean_score", 6))


@query("select conv_id, turn, role from conversations where contains(lower(concat_ws(' ', conv_id::varchar, role, text)), 'the') and role = 'user'")
def search_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.contains(browse.search_text("conv_id", "role", "text"), F.lit("the")) & (F.col("role") == "user"))
    return c.select("conv_id", "turn", "role")


@query("select event_id, user_id from (select *, row_number() over (order by event_id) as n from events) where n between 101 and 200")
def event_page(spark, sf_dir):
    """The second page of a hundred events."""
    return browse.page(table(spark, sf_dir, "events").select("event_id", "user_id"), 2, 100, "event_id")


@query("select role, greatest(1, ceil(count(*) / 50.0))::bigint as pages, count(*) as total from conversations group by role")
def page_counts(spark, sf_dir):
    return browse.page_count(table(spark, sf_dir, "conversations"), 50, "role")


@query("select conv_id, turn as index, lag(turn) over w as prev_index, lead(turn) over w as next_index from conversations where role = 'assistant' window w as (partition by conv_id order by turn)")
def revision_navigation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("index"), "role")
    return browse.neighbours(c, F.col("role") == "assistant", ["conv_id"]).select("conv_id", "index", "prev_index", "next_index")


_STATES = f"""{_CLASSIFY}, st as (select *, case when kind is null then 'none' when kind = 'structured-conflict' then 'unclear' else 'same' end as ai_state, case when kind is null then '' when kind = 'similarity' then 'similarity' else 'rule' end as prefilter_kind,
  case when kind is null then 'AI未跑' when kind = 'structured-conflict' then '规则冲突' when kind = 'similarity' then '相似跳过' else '规则通过' end as badge, pair % 3 = 0 and kind is not null as confirmed, 0.05::double * (pair * 7 % 10) as score from k)"""


def noted(spark, sf_dir):
    """Rows with the notes of their pre-screening, every third one confirmed by hand. The outcomes are written once; the rows, whose texts are cheap, come from the table."""
    c = classified(spark, sf_dir).withColumns({"index": F.col("pair"), "signature": F.lit("")})
    ev = prefilter.results(c).select(F.col("index").cast("string").alias("id"), F.col("note").alias("new_note"), F.lit(True).alias("new_ai_done"), F.lit("").alias("new_target"))
    ev = store.kept(ev)
    empty = spark.createDataFrame([], "id string, note string, manual_note string, done boolean, manual_done boolean, ai_done boolean, revision_text string, revision_target string")
    stored = notes.upsert(empty, ev)
    stored = notes.confirm(stored, stored.where("cast(id as long) % 3 = 0").select("id"))
    rows_ = variants(spark, sf_dir).withColumn("index", F.col("pair")).select("index", "lang", F.lit("c").alias("chapter"), F.lit("1:1").alias("relation"), F.col("source").alias("jp"), F.col("left").alias("cn"), F.col("right").alias("tw"), F.lit("").alias("tw_cn"), (F.col("index") * 7 % 10 * 0.05).alias("score"))
    return browse.with_notes(rows_, stored)


@query(f"with {_STATES} select lang, ai_state, 'unrated' as issue_state, prefilter_kind, badge, count(*) as n from st group by all")
def browse_states(spark, sf_dir):
    """Pre-screening notes merged into an empty set of notes, then counted by what the filters ask."""
    return noted(spark, sf_dir).groupBy("lang", "ai_state", "issue_state", "prefilter_kind", "badge").agg(F.count("*").alias("n"))


@query(f"with {_STATES} select pair as index from st join p using (pair) where ai_state = 'same' and score >= 0.18 and score < 0.35 and not confirmed and contains(lower(concat_ws(' ', pair::varchar, 'c', '1:1', s, l, r)), 'th') and kind is not null")
def filtered_rows(spark, sf_dir):
    """Rows that match a query, a band, an answer, with notes, not confirmed."""
    return noted(spark, sf_dir).where(browse.matches("TH", band="watch", ai="same", issue="unrated", notes_only=True, done="open")).select("index")


@query(f"with {_STATES} select lang, count(*) as total, count(*) filter (where confirmed) as done, count(*) filter (where kind is not null) as ai_done from st group by lang")
def done_counts(spark, sf_dir):
    return browse.done_counts(noted(spark, sf_dir), "lang")


@query(f"with {_STATES} select prefilter_kind, count(*) as count from st where prefilter_kind <> '' and not confirmed group by all")
def confirmable_rows(spark, sf_dir):
    return browse.confirmable(noted(spark, sf_dir))


@query("select conv_id, turn, list_sort([b.turn for b in bs if b.turn <> turn and abs(b.turn - turn) <= 6]) as near from conversations join (select conv_id as c, list({'turn': turn}) as bs from conversations group by conv_id) on c = conv_id")
def context_rings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("index"), F.col("text").alias("source"), F.lit("").alias("target"), F.lit("").alias("counterpart"))
    out = context.context(c, ["conv_id"], chars=1 << 40)
    return out.select("conv_id", F.col("index").alias("turn"), F.transform("context", lambda x: x["index"]).alias("near"))


# ---- differences ----


@query(f"""with {PAIRS}, c as (select pair, string_split(l, '') as a, string_split(r, '') as b from p),
h as (select *, coalesce(list_position([a[i] = b[i] for i in range(1, least(len(a), len(b)) + 1)], false) - 1, least(len(a), len(b))) as head from c),
t as (select *, least(len(a), len(b)) - head as most from h),
e as (select *, coalesce(list_position([a[len(a) - i + 1] = b[len(b) - i + 1] for i in range(1, most + 1)], false) - 1, most) as tail from t)
select pair, head::bigint as head, tail::bigint as tail, (len(a) - head - tail)::bigint as deleted, (len(b) - head - tail)::bigint as inserted from e""")
def common_ends(spark, sf_dir):
    parts = pairs(spark, sf_dir).select("pair", F.length("left").alias("n"), diff.prefix_suffix(F.col("left"), F.col("right")).alias("p"))
    size = lambda kind: F.aggregate(F.filter("p", lambda x: x["type"] == kind), F.lit(0).cast("long"), lambda a, x: a + F.length(x["value"]))
    first = F.coalesce(F.when(F.get("p", F.lit(0))["type"] == "same", F.length(F.get("p", F.lit(0))["value"])), F.lit(0)).cast("long")
    return parts.select("pair", F.when(F.size("p") == 0, 0).otherwise(first).alias("head"), (size("same") - first).alias("tail"), size("del").alias("deleted"), size("ins").alias("inserted"))


# ---- result log ----


@query("select user_id, event_id, round(avg(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id rows between 19 preceding and current row), 6) as error_rate from events")
def rolling_error_rate(spark, sf_dir):
    r = context.rolling_rate(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), F.col("event_type") == "error", ["user_id"], ["event_id"])
    return r.select("user_id", "event_id", F.round("error_rate", 6).alias("error_rate"))


@query("with r as (select user_id, row_number() over w as seen, avg(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id rows between 19 preceding and current row) as rate from events window w as (partition by user_id order by event_id)) select user_id, min(seen) as trip_at from r where seen >= 10 and rate >= 0.5 group by user_id")
def breaker_trips(spark, sf_dir):
    t = context.trip_point(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), F.col("event_type") == "error", ["user_id"], ["event_id"])
    return t.select("user_id", F.col("trip_at").cast("long").alias("trip_at"))


@query("select user_id, event_id, row_number() over w as revision, ((row_number() over w - 1) // 64 + 1)::bigint as page from events window w as (partition by user_id order by event_id)")
def cursor_pages(spark, sf_dir):
    log = results.with_revision(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"])
    return results.pages(log, "user_id")


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def latest_results(spark, sf_dir):
    return results.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", "event_type", "event_id")


@query("select distinct user_id, event_type from events")
def applied_once(spark, sf_dir):
    return results.once(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("with l as (select user_id, arg_max(event_type, event_id) as t from events group by user_id) select e.user_id, count(*) filter (where e.event_type = l.t) as fresh, count(*) filter (where e.event_type <> l.t) as stale from events e join l using (user_id) group by e.user_id")
def stale_results(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("signature"), "event_id")
    now = results.latest(e, ["user_id"], "event_id").select("user_id", "signature")
    both = results.current(e, now, ["user_id"]).select("user_id", F.lit(1).alias("f")).unionAll(results.stale(e, now, ["user_id"]).select("user_id", F.lit(0)))
    return both.groupBy("user_id").agg(F.sum("f").alias("fresh"), F.sum(1 - F.col("f")).alias("stale"))


@query("select event_type, count(*) as processed, count(*) filter (where event_type <> 'error') as handled, count(*) filter (where event_type = 'error') as errors from events group by event_type")
def run_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("event_type").alias("status"), (F.col("event_type") != "error").alias("done"))
    return prefilter.counters(e, "event_type").select("event_type", "processed", "handled", "errors")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 8")
def recent_requests(spark, sf_dir):
    return context.newest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 8).select("user_id", "event_id")


def stream(spark, sf_dir) -> DataFrame:
    """events as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events*.parquet")


@query("select user_id::varchar as run, event_id, row_number() over (partition by user_id order by event_id) as revision from events")
def streamed_log(spark, sf_dir):
    at = store.scratch(spark)
    e = stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("run"), "event_id")
    results.start_log(e, f"{at}/log", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("run string, event_id long, revision long").parquet(f"{at}/log/batch=*")


@query("with r as (select user_id::varchar as run, row_number() over w as seen, avg(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id rows between 19 preceding and current row) as rate from events window w as (partition by user_id order by event_id)) select run, count(*) as events, min(case when seen >= 10 and rate >= 0.5 then seen end) as trip_at from r group by run")
def streamed_breaker(spark, sf_dir):
    """The breaker over a live log; its state is kept in RocksDB, as list state needs."""
    at, spark = store.scratch(spark), spark.newSession()  # a session of its own, so that others keep their state store
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("run"), "event_id", (F.col("event_type") == "error").alias("failed"))
    results.watch(e).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    return out.groupBy("run").agg(F.count("*").alias("events"), F.min(F.when(F.col("tripped"), F.col("seen"))).alias("trip_at"))


# ---- storage and sinks ----


def manifests(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("generated_at"), F.col("o_orderstatus").alias("status"))


_ORDERED = "o as (select o_custkey as id, o_orderkey as snapshot_id, o_orderstatus as status, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders)"


@query(f"with {_ORDERED} select id, snapshot_id from o where n <= 2 or status = 'P'")
def retained_snapshots(spark, sf_dir):
    m = manifests(spark, sf_dir)
    return store.retained(m, m.where("status = 'P'")).select("id", "snapshot_id")


@query(f"with {_ORDERED} select id, snapshot_id, id in (select id from o where status = 'P') as active from o where n = 1")
def project_list(spark, sf_dir):
    m = manifests(spark, sf_dir)
    return store.projects(m, m.where("status = 'P'")).select("id", "snapshot_id", "active")


@query("""select doc_id as index, md5('"' || doc_id::varchar || '","' || replace(lang, '"', '""') || '","' || source || '","","","' || replace(text, '"', '""') || '",""') as line from documents""")
def csv_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.col("lang").alias("chapter"), F.col("source").alias("relation"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("jp_align_score"), F.col("text").alias("jp"), F.lit(None).cast("string").alias("cn"))
    return sinks.csv_lines(d, "bilingual").select("index", F.md5("line").alias("line"))


@query("""select conv_id, '<list>' || chr(10) || string_agg('  <searchtext>' || replace(replace(role, '&', '&amp;'), '<', '&lt;') || '</searchtext>' || chr(10) || '  <replacetext>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</replacetext>', chr(10) order by turn) || chr(10) || '</list>' || chr(10) as content from conversations group by conv_id""")
def replace_lists(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("index"), F.col("role").alias("search"), F.col("text").alias("replace"))
    return sinks.replace_list(c, keys=("conv_id",))


# the queries of further modules register themselves
from . import queries_align, queries_books, queries_runs, queries_words  # noqa: E402, F401
