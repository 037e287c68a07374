"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, its source's target divided by its source's size.
Documents stand in order of size; the prefix sums of their expected copies, shifted by one random offset for each source,
cross some integers, and a document is emitted once for each integer crossed. As neighbours in this order have nearly equal
sizes, the words taken differ from the target by about one large document at most.

Null texts and texts without words have size 0 and take nothing. Null sources form one source, the last. Ties in size are
broken by doc_id, null last; mix() breaks further ties by a hash of the text. Texts of any length count whole. The table of targets has one row for each source and is sorted in one
task, which holds for some ten million sources; documents are never dealt by source alone. Every row counts for itself, also repeated ones and those without doc_id. Extra columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, free_name, positions, text_size

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2.0, 17


def offset(source: Column, seed: int) -> Column:
    """A number from 0 to below 1 that depends on source and seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Targets share `share` times all sizes by weight; none exceeds `most` times its source's size, and what they leave goes
    to the others by weight. In order of the factor at which a source reaches its limit, the limited ones come first: a
    source is limited if, with all before it limited, an equal factor for the rest would carry it past its limit.
    """
    if share > most:
        raise ValueError("share exceeds what all sources together may give")
    everything = Window.partitionBy()
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = table.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    table = table.withColumn("_limit", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    table = table.withColumn("_factor", left / F.sum("_w").over(rest))
    table = table.withColumn("_level", F.max(F.when(F.col("_factor") * F.col("_w") <= F.col("_limit"), F.col("_factor"))).over(everything))
    target = F.least(F.col("_limit"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_limit")))
    return table.select("source", "source_size", target.alias("target"))


def mix_plan(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """One slim row for each document: doc_id, source, size, source_size, target, copies, taken."""
    slim = documents.select("doc_id", "source", text_size(F.col("text")).alias("size"))
    return _planned(slim, [], Workspace(documents.sparkSession, "mix"), weights, share, most, seed)


def _planned(slim: DataFrame, ties: list[str], ws: Workspace, weights, share: float, most: float, seed: int) -> DataFrame:
    """The plan of slim rows (doc_id, source, size and the columns of ties, by which rows of equal size and doc_id stand)."""
    ranked, kept = positions(slim.withColumn("_no_id", F.col("doc_id").isNull()), ["source"], ["size", "_no_id", "doc_id", *ties], ws)
    targets = source_targets(kept, weights, share, most).withColumn("_offset", offset(F.col("source"), seed)).withColumnRenamed("source", "_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor((F.col("pos") + 1) * F.col("_e") + F.col("_offset")) - F.floor(F.col("pos") * F.col("_e") + F.col("_offset"))
    joined = ranked.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_e", expected)
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *ties)


def mix(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: documents with their columns, each row as often as the plan says."""
    ws = Workspace(documents.sparkSession, "mix")
    row, copies, copy = (free_name(documents, name) for name in ("_mix_row", "_mix_copies", "_mix_copy"))
    kept = ws.keep(documents.withColumn(row, F.monotonically_increasing_id()))
    slim = kept.select("doc_id", "source", text_size(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie_text"), F.col(row).alias("_tie_row"))
    plan = _planned(slim, ["_tie_text", "_tie_row"], ws, weights, share, most, seed).where("copies > 0").select(F.col("_tie_row").alias(row), F.col("copies").cast("int").alias(copies))
    return kept.join(plan, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*documents.columns)


def op3_source_mix(spark, sf_dir):
    from .common import read

    return mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, ([3.0, 1.0, 2.0]::double[])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w, 2.0::double * source_size as lim from s0),
s2 as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(lim) over (order by lim / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
  / sum(w) over (order by lim / w, source nulls last rows between current row and unbounded following) as factor from s1),
s3 as (select *, max(case when factor * w <= lim then factor end) over () as level from s2),
t as (select source, source_size, least(lim, coalesce(level * w, lim)) as target,
  (('0x' || substr(md5('17:' || coalesce('s' || source, 'null')), 1, 8))::bigint)::double / 4294967296.0::double as u from s3),
r as (select d.*, row_number() over (partition by source order by size, doc_id) - 1 as pos from d),
j as (select r.*, t.source_size, t.target, t.u, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as e
  from r join t on r.source is not distinct from t.source)
select doc_id, size, source_size, target, ((floor((pos + 1) * e + u) - floor(pos * e + u)) * size)::bigint as taken from j
"""
