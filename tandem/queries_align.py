"""Registered queries of the alignments: anchors, covers, point mappings and rows, with SQL that works them out by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import align, rows
from .plans import compare, crosslingual
from .queries import _PARAGRAPHS, _VECTORS, mutual_best_vectors, paragraphs, vectors
from .registry import GRAMS, JACCARD, canon, query, simil, table

_A, _B = "[2, 2, 1, 1, 1, 0]", "[2, 1, 2, 1, 0, 1]"


def cover_sql(band: int, empty: float, half_even: bool) -> str:
    """CTEs that give `path` (key, i, j, a, b, score), the best cover of each key, from sz (key, n, m) and sc (key, i, a, b, s: scores by j).

    A row of totals follows from the two before it: the steps from there in order, then the step within the row from left to right.
    """
    half = "round_even({0}::double / greatest(n, 1) * m, 0)" if half_even else "floor({0}::double / greatest(n, 1) * m + 0.5)"
    mid = lambda x: f"({half.format(x)})::int"
    inside = lambda x, y: f"{y} between greatest(0, {mid(x)} - {band}) and least(m, {mid(x)} + {band})"
    cells = "[{'b': b[y + 1], 'k': k[y + 1], 'ok': ok[y + 1]} for y in range(0, m + 1)]"
    across = f"list_reduce([[cell] for cell in {cells}], lambda acc, z: list_append(acc, case when z[1].ok and acc[-1].b is not null and acc[-1].b + ({empty}::double) > coalesce(z[1].b, -1e9) then {{'b': (acc[-1].b + ({empty}::double))::float::double, 'k': 5, 'ok': true}} else z[1] end))"
    # what each step offers at y, in order; later ones must be better than what stands there
    offers = [f"case when ok[y + 1] and y >= {b} then {past}[y - {b} + 1] + {scores} end" for past, scores, b in (("prev", "s22[y - 1]", 2), ("prev", "s21[y]", 1), ("cur", "s12[y - 1]", 2), ("cur", "s11[y]", 1), ("cur", f"({empty}::double)", 0))]
    fold = "select key, n, m, x, cur, prev, s11, s12, s21, s22, [null::double for y in range(0, m + 1)] as b, [-1 for y in range(0, m + 1)] as k, ["+inside("(x + 1)", "y")+" for y in range(0, m + 1)] as ok from d"
    for k, offer in enumerate(offers):
        better = "o[y + 1] is not null and o[y + 1] > coalesce(b[y + 1], -1e9)"
        fold = f"select * exclude (o, b, k), [case when {better} then o[y + 1]::float::double else b[y + 1] end for y in range(0, m + 1)] as b, [case when {better} then {k} else k[y + 1] end for y in range(0, m + 1)] as k from (select *, [{offer} for y in range(0, m + 1)] as o from ({fold}))"
    return f"""
bands as (select key, n, m, 0 as x, {across} as cells, null::double[] as former from (select key, n, m, [case when y = 0 then 0.0::double end for y in range(0, m + 1)] as b, [-1 for y in range(0, m + 1)] as k, [{inside('0', 'y')} for y in range(0, m + 1)] as ok from sz)
  union all
  select key, n, m, x + 1, {across}, cur from (with d as (
    select r.key, r.n, r.m, r.x, [cell.b for cell in r.cells] as cur, r.former as prev, a.s as s11, b.s as s12, c.s as s21, d.s as s22 from bands r
      left join sc a on a.key = r.key and a.i = r.x and a.a = 1 and a.b = 1 left join sc b on b.key = r.key and b.i = r.x and b.a = 1 and b.b = 2
      left join sc c on c.key = r.key and c.i = r.x - 1 and c.a = 2 and c.b = 1 left join sc d on d.key = r.key and d.i = r.x - 1 and d.a = 2 and d.b = 2 where r.x < r.n) {fold})),
walk as (select key, n, m, n as x, m as y, null::int as a, null::int as b from sz
  union all
  select w.key, w.n, w.m, w.x - t.a, w.y - t.b, t.a, t.b from walk w join (
    select key, x, generate_subscripts(cells, 1) - 1 as y, unnest(cells).k as k from bands) s on s.key = w.key and s.x = w.x and s.y = w.y,
    lateral (select case when s.k >= 0 then {_A}[s.k + 1] else least(w.x, 1) end as a, case when s.k >= 0 then {_B}[s.k + 1] else least(w.y, 1) end as b) t where w.x > 0 or w.y > 0),
path as (select w.key, w.x as i, w.y as j, w.a, w.b, case when w.a > 0 and w.b > 0 and {inside('w.x', 'w.y')} then sc.s[w.y + 1] else {empty}::double end as score
  from walk w left join sc on sc.key = w.key and sc.i = w.x and sc.a = w.a and sc.b = w.b where w.a is not null)"""


# ---- vectors ----


@query(f"with {_VECTORS}, r as (select *, row_number() over (partition by label, i order by score desc, j) as p, row_number() over (partition by label, j order by score desc, i) as q from d), best as (select label, i, j, score from r where p = 1 and q = 1) select label, i, j, score from (select *, max(j) over (partition by label order by i rows between unbounded preceding and 1 preceding) as reach from best) where reach is null or j > reach")
def vector_anchors(spark, sf_dir):
    return align.increasing(mutual_best_vectors(spark, sf_dir), ["label"])


_UNIT = "case when list_sum([x * x for x in {0}]) = 0 then {0} else [x / sqrt(list_sum([x * x for x in {0}])) for x in {0}] end"
_VECTOR_SPANS = f"""v as (select label as key, vec_id % 2 as side, row_number() over (partition by label, vec_id % 2 order by vec_id) - 1 as idx, [x::double for x in embedding] as e from embeddings),
w as (select *, lead(e) over (partition by key, side order by idx) as f from v),
u as (select key, side, idx, 1 as steps, {_UNIT.format('e')} as u from w union all select key, side, idx, 2, {_UNIT.format('h')} from (select *, [(e[k] + f[k]) / 2 for k in range(1, len(e) + 1)] as h from w where f is not null)),
sz as (select key, count(*) filter (where side = 0)::int as n, count(*) filter (where side = 1)::int as m from v group by key),
sc as (select key, i, a, b, list(s order by j) as s from (select l.key, l.idx as i, r.idx as j, l.steps as a, r.steps as b, list_sum([l.u[k] * r.u[k] for k in range(1, len(l.u) + 1)]) - 0.035::double * (l.steps + r.steps - 2) as s from u l join u r on l.key = r.key and l.side = 0 and r.side = 1) group by key, i, a, b)"""


@query(f"with recursive {_VECTOR_SPANS}, {cover_sql(align.VECTOR_WINDOW, align.VECTOR_EMPTY, True)} select key as label, i::bigint as left_start, (i + a)::bigint as left_end, j::bigint as right_start, (j + b)::bigint as right_end, round(score, 4) as score, a::varchar || ':' || b::varchar as relation from path")
def vector_groups(spark, sf_dir):
    return align.align_vectors(vectors(spark, sf_dir, 0), vectors(spark, sf_dir, 1), ["label"])


@query(f"""with recursive v as (select label, vec_id % 2 as side, row_number() over (partition by label, vec_id % 2 order by vec_id) - 1 as idx, embedding as e from embeddings),
s as (select label, i, list(s order by j) as s from (select l.label, l.idx as i, r.idx as j, list_sum([l.e[k]::double * r.e[k]::double for k in range(1, len(l.e) + 1)]) as s from v l join v r on l.label = r.label and l.side = 0 and r.side = 1) group by label, i),
z as (select label, count(*)::int as n, any_value(len(s))::int as m from s group by label),
r as (select z.label, n, m, -1 as i, 0 as furthest, null::int as j, null::double as score from z
  union all
  select label, n, m, i, greatest(furthest, j), j, s[j + 1] from (select *, lo + list_position(worth, list_max(worth)) - 1 as j from (
    select *, [s[y + 1] - ({align.BACK}::double * greatest(0, furthest - y) + {align.AWAY}::double * abs(y - e)) for y in range(lo, hi + 1)] as worth from (
      select *, greatest(0, greatest(e, furthest) - {align.VECTOR_WINDOW}) as lo, least(m - 1, greatest(e, furthest) + {align.VECTOR_WINDOW}) as hi from (
        select r.label, r.n, r.m, r.i + 1 as i, r.furthest, s.s, round_even((r.i + 1)::double / greatest(1, r.n - 1) * (r.m - 1), 0)::int as e from r join s on s.label = r.label and s.i = r.i + 1)))))
select label, i::bigint as left_index, j::bigint as right_index, round(score, 4) as score from r where i >= 0""")
def vector_mapping(spark, sf_dir):
    return align.point_mapping(vectors(spark, sf_dir, 0), vectors(spark, sf_dir, 1), ["label"])


@query("""with p as (select a.embedding as x, b.embedding as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 and a.vec_id % 2 = 0),
c as (select i - 1 as row, j - 1 as col, sum(x[i]::double * y[j]::double) as value, count(*) as n from p, range(1, 65) r(i), range(1, 65) s(j) group by i, j) select row::int as row, col::int as col, round(value, 4) as value, n from c""")
def vector_covariance(spark, sf_dir):
    """Cross-covariance of embeddings 2n and 2n + 1, as a mapping is learnt from."""
    e = table(spark, sf_dir, "embeddings")
    even = e.where("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("left"))
    found, n = crosslingual.cross_covariance(even.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("right")), "vec_id"))
    rows = [(i, j, float(v), n) for i, row in enumerate(found) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "row int, col int, value double, n long").withColumn("value", F.round("value", 4))


# ---- versions ----


def versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lines of documents 2n and 2n + 1 as two versions of one text."""
    p = paragraphs(spark, sf_dir).select(F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).alias("side"), F.col("source_index").alias("idx"), "text")
    return p.where("side = 0").drop("side"), p.where("side = 1").drop("side")


_RATIO = "least(greatest(len(l.g), 1), greatest(len(r.g), 1))::double / greatest(len(l.g), len(r.g), 1)"
_PAIR = f"({JACCARD}) * 0.72::double + {_RATIO} * 0.28::double".replace("ga", "l.grams").replace("gb", "r.grams")
_ITEMS = f"{_PARAGRAPHS}, t as (select doc_id // 2 as pair, doc_id % 2 as side, source_index as idx, text, {simil(canon('text'))} as g from q), f as (select *, {GRAMS.format('g')} as grams from t)"
_ANCHORS = f"""{_ITEMS}, cand as (select l.pair, l.idx as i, r.idx as j, {_PAIR} as score, len(l.g) >= {align.ANCHOR_LENGTH} and len(r.g) >= {align.ANCHOR_LENGTH} as long from f l join f r on l.pair = r.pair and l.side = 0 and r.side = 1 and abs(l.idx - r.idx) <= {align.RADIUS}),
o as (select *, row_number() over (partition by pair, i order by score desc, j) as p, row_number() over (partition by pair, j order by score desc, i) as q from cand),
h as (select *, max(j) over (partition by pair order by i rows between unbounded preceding and 1 preceding) as reach from o where p = 1 and q = 1 and long and score >= {align.ANCHOR_SCORE}),
anchors as (select pair, i, j, score from h where reach is null or j > reach)"""


@query(f"with {_ANCHORS} select pair, i, j, round(score, 6) as score from anchors")
def version_anchors(spark, sf_dir):
    a = align.local_anchors(*versions(spark, sf_dir), ["pair"], align.generic)
    return a.select("pair", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("score", 6).alias("score"))


_GAPS = f"""{_ANCHORS}, gapped as (select f.pair, f.side, f.idx, f.text, f.g, (select count(*) from anchors a where a.pair = f.pair and case when f.side = 0 then a.i else a.j end < f.idx) as gap from f
  where not exists (select 1 from anchors a where a.pair = f.pair and case when f.side = 0 then a.i else a.j end = f.idx)),
gi as (select *, pair::varchar || ':' || gap::varchar as key, min(idx) over (partition by pair, gap, side) as base, lead(g) over (partition by pair, gap, side order by idx) as next from gapped),
w as (select key, side, idx - base as idx, 1 as steps, g from gi union all select key, side, idx - base, 2, g || next from gi where next is not null),
u as (select *, {GRAMS.format('g')} as grams from w),
sz as (select key, count(*) filter (where side = 0)::int as n, count(*) filter (where side = 1)::int as m from gi group by key),
sc as (select key, i, a, b, list(s order by j) as s from (select l.key, l.idx as i, r.idx as j, l.steps as a, r.steps as b, {_PAIR} - 0.03::double * (l.steps + r.steps - 2) as s from u l join u r on l.key = r.key and l.side = 0 and r.side = 1) group by key, i, a, b)"""


@query(f"""with recursive {_GAPS}, {cover_sql(align.BAND, align.EMPTY, False)}, bounds as (select pair, row_number() over (partition by pair order by i) as gap, i, j from anchors),
g as (select split_part(key, ':', 1)::bigint as pair, split_part(key, ':', 2)::bigint as gap, i, j, a, b, score from path),
p as (select g.pair, g.i + coalesce(x.i + 1, 0) as left_start, g.j + coalesce(x.j + 1, 0) as right_start, g.a, g.b, g.score from g left join bounds x on x.pair = g.pair and x.gap = g.gap
  union all select pair, i, j, 1, 1, score from anchors)
select pair, left_start::bigint as left_start, (left_start + a)::bigint as left_end, right_start::bigint as right_start, (right_start + b)::bigint as right_end, round(score, 6) as score, a::varchar || ':' || b::varchar as relation from p""")
def version_groups(spark, sf_dir):
    g = align.align_versions(*versions(spark, sf_dir), ["pair"], normal=align.generic)
    return g.select("pair", *[F.col(c).cast("long").alias(c) for c in ("left_start", "left_end", "right_start", "right_end")], F.round("score", 6).alias("score"), "relation")


# ---- rows ----

_ROWS = rf"""{_PARAGRAPHS}, t as (select doc_id // 3 as project, doc_id % 3 as lang, source_index as idx, text, {simil(canon('text'))} as g from q),
z as (select project, count(*) filter (where lang = 0) as p, count(*) filter (where lang = 1) as n, count(*) filter (where lang = 2) as m from t group by project),
vg as (select project, k, least(2 * k, n) as ls, least(2 * k + 2, n) as le, least(2 * k, m) as rs, least(2 * k + 2, m) as re from z, unnest(range(0, greatest((n + 1) // 2, (m + 1) // 2))) as u(k)),
sg as (select project, k, 3 * k as ls, least(3 * k + 3, p) as le, 3 * k as rs, least(3 * k + 3, n) as re, round(1.0::double / (k + 2), 4) as score from z, unnest(range(0, (least(p, n) + 2) // 3)) as u(k)),
iv as (select project, 'v' as kind, k, ls as s, le as e from vg where le > ls union all select project, 's', k, rs, re from sg),
reach as (select *, max(e) over (partition by project order by s, e rows between unbounded preceding and 1 preceding) as reach from iv),
isl as (select *, sum((reach is null or s >= reach)::int) over (partition by project order by s, e) as island from reach),
adm as (select *, bool_or(kind = 'v') over (partition by project, island) and bool_or(kind = 's') over (partition by project, island) as kept from isl),
places as (select project, kind, k, dense_rank() over (partition by project order by island) as row from adm where kept),
v as (select vg.*, row from vg join places using (project, k) where kind = 'v'), s as (select sg.*, row from sg join places using (project, k) where kind = 's'),
vr as (select project, row, case when count(*) = 1 then any_value((le - ls)::varchar || ':' || (re - rs)::varchar) else sum(le - ls)::bigint::varchar || ':' || sum(re - rs)::bigint::varchar end as relation from v group by all),
sr as (select project, row, case when count(*) = 1 then any_value((le - ls)::varchar || ':' || (re - rs)::varchar) else sum(le - ls)::bigint::varchar || ':' || sum(re - rs)::bigint::varchar end as relation, avg(score) as score from s group by all),
cn as (select v.project, row, idx, text, g from v join t on t.project = v.project and lang = 1 and idx >= ls and idx < le), tw as (select v.project, row, idx, text, g from v join t on t.project = v.project and lang = 2 and idx >= rs and idx < re),
jp as (select s.project, row, idx, text from s join t on t.project = s.project and lang = 0 and idx >= ls and idx < le),
sides as (select project, row, vr.relation as v, sr.relation as s, sr.score as jp_align_score, c.text as cn, w.text as tw, j.text as jp, coalesce(c.g, '') as a, coalesce(w.g, '') as b, coalesce(c.chars, 0) as cn_chars, coalesce(w.chars, 0) as tw_chars, coalesce(j.chars, 0) as jp_chars, c.n as cn_n, w.n as tw_n
  from vr join sr using (project, row) left join (select project, row, string_agg(text, chr(10) || chr(10) order by idx) as text, string_agg(g, '' order by idx) as g, sum(len(text)) as chars, count(*) as n from cn group by all) c using (project, row)
  left join (select project, row, string_agg(text, chr(10) || chr(10) order by idx) as text, string_agg(g, '' order by idx) as g, sum(len(text)) as chars, count(*) as n from tw group by all) w using (project, row)
  left join (select project, row, string_agg(text, chr(10) || chr(10) order by idx) as text, sum(len(text)) as chars from jp group by all) j using (project, row)),
scored as (select *, case when coalesce(cn, '') = '' or coalesce(tw, '') = '' then 0.0::double else ({JACCARD}) * 0.72::double + least(greatest(len(a), 1), greatest(len(b), 1))::double / greatest(len(a), len(b), 1) * 0.28::double end as score
  from (select *, {GRAMS.format('a')} as ga, {GRAMS.format('b')} as gb from sides)),
fr as (select project, row, side, idx, unnest(case when len(u) > 1 then u else [text] end) as text, unnest(range(greatest(len(u), 1))) as p from (
    select *, [x for x in [trim(y, ' ' || chr(9) || chr(10)) for y in string_split(regexp_replace(text, '([。！？!?][。！？!?」』）)】]*)', '\1' || chr(1), 'g'), chr(1))] if x <> ''] as u from (
      select project, row, 0 as side, idx, text from cn union all select project, row, 1, idx, text from tw) join (select project, row from scored where score < 0.22) using (project, row))),
able as (select project, row from fr join scored using (project, row) group by project, row having count(*) filter (where side = 0) between 1 and 8 and count(*) filter (where side = 1) between 1 and 8 and (count(*) filter (where side = 0) > any_value(cn_n) or count(*) filter (where side = 1) > any_value(tw_n))),
fi as (select project::varchar || ':' || row::varchar as key, side, row_number() over (partition by project, row, side order by idx, p) - 1 as idx, {simil(canon('text'))} as g from fr join able using (project, row)),
fw as (select *, lead(g) over (partition by key, side order by idx) as next from fi),
u as (select *, {GRAMS.format('g')} as grams from (select key, side, idx, 1 as steps, g from fw union all select key, side, idx, 2, g || next from fw where next is not null)),
sz as (select key, count(*) filter (where side = 0)::int as n, count(*) filter (where side = 1)::int as m from fi group by key),
sc as (select key, i, a, b, list(s order by j) as s from (select l.key, l.idx as i, r.idx as j, l.steps as a, r.steps as b, {_PAIR} - 0.03::double * (l.steps + r.steps - 2) as s from u l join u r on l.key = r.key and l.side = 0 and r.side = 1) group by key, i, a, b),
{cover_sql(rows.REFINE_BAND, align.EMPTY, False)},
found as (select split_part(key, ':', 1)::bigint as project, split_part(key, ':', 2)::bigint as row, case when count(*) = 1 then any_value(a::varchar || ':' || b::varchar) else sum(a)::bigint::varchar || ':' || sum(b)::bigint::varchar end as relation, coalesce(avg(score + 0.03::double * (a + b - 2)) filter (where a > 0 and b > 0), 0.0::double) as refined from path group by key),
refined as (select f.* from found f join scored c using (project, row) where f.refined >= greatest({rows.ACCEPT}::double, c.score + {rows.GAIN}::double))"""


@query(f"""with recursive {_ROWS} select c.project, c.row::bigint as index, '简台 ' || coalesce('细分 ' || r.relation, c.v) || ' / 日文 ' || c.s as relation, round(c.score, 6) as score, round(c.jp_align_score, 6) as jp_align_score, round(r.refined, 6) as refined_score,
  md5(coalesce(cn, '')) as cn, md5(coalesce(tw, '')) as tw, md5(coalesce(jp, '')) as jp, cn_chars::bigint as cn_chars, tw_chars::bigint as tw_chars, jp_chars::bigint as jp_chars from scored c left join refined r using (project, row)""")
def rows_from_groups(spark, sf_dir):
    """Rows of documents 3n, 3n + 1 and 3n + 2 from groups of two lines of the versions and of three lines of the source."""
    lang = F.element_at(F.array(F.lit("jp"), F.lit("cn"), F.lit("tw")), (F.col("doc_id") % 3 + 1).cast("int"))
    p = paragraphs(spark, sf_dir).withColumns({"project": F.floor(F.col("doc_id") / 3), "lang": lang}).drop("doc_id")
    count = lambda x: F.count_if(F.col("lang") == x).cast("long")
    z = p.groupBy("project").agg(count("jp").alias("p"), count("cn").alias("n"), count("tw").alias("m"))
    half = lambda c: F.floor((F.col(c) + 1) / 2)
    each = lambda most: z.where(most > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), most - 1)))
    ends = lambda c, size: [F.least(F.col("k") * size, F.col(c)), F.least(F.col("k") * size + size, F.col(c))]
    names = ["left_start", "left_end", "right_start", "right_end"]
    v = each(F.greatest(half("n"), half("m"))).select("project", *[c.alias(x) for x, c in zip(names, ends("n", 2) + ends("m", 2))], F.lit(0.0).alias("score"))
    s = each(F.floor((F.least("p", "n") + 2) / 3)).select("project", *[c.alias(x) for x, c in zip(names, ends("p", 3) + ends("n", 3))], F.round(1 / (F.col("k") + 2), 4).alias("score"))
    r = rows.compare_rows(p, align.relation(v), align.relation(s), ["project"], normal=align.generic, keep=compare.kept_in(spark))
    six = lambda c: F.round(c, 6).alias(c)
    return r.select("project", F.col("index").cast("long").alias("index"), "relation", six("score"), six("jp_align_score"), six("refined_score"), *[F.md5(c).alias(c) for c in ("cn", "tw", "jp")], *[F.col(f"{c}_chars").cast("long").alias(f"{c}_chars") for c in ("cn", "tw", "jp")])
