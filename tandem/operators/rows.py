"""Comparison rows from two sets of groups: overlapping intervals on the pivot version become one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import script
from ..functions import text as T
from . import align, segment

LOW, FRAGMENTS, REFINE_BAND, ACCEPT, GAIN = 0.22, 8, 8, 0.26, 0.12


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Pairs of half-open intervals (keys, start, end) that overlap, as columns of a and of b with the prefix b_.

    Both sides are spread over buckets of the given width, so the join is by equality; a pair is given in the first bucket that it shares.
    """
    buckets = lambda s, e: F.sequence(F.floor(s / width), F.floor((e - 1) / width))
    other = b.select([F.col(c).alias(f"b_{c}") for c in b.columns]).where("b_end > b_start").withColumn("_b", F.explode(buckets(F.col("b_start"), F.col("b_end"))))
    mine = a.where("`end` > `start`").withColumn("_a", F.explode(buckets(F.col("start"), F.col("end"))))
    on = F.col("_a") == F.col("_b")
    for k in keys:
        on = on & (F.col(k) == F.col(f"b_{k}"))
    found = mine.join(other, on).where(overlaps(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")))
    return found.where(F.col("_a") == F.floor(F.greatest("start", "b_start") / width)).drop("_a", "_b")


#: Intervals that a task sorts, where their number is told.
SORTED = 1 << 20


def islands(intervals: DataFrame, keys: list[str], size: int | None = None) -> DataFrame:
    """intervals (keys, start, end) with island: its number, from 1, among runs of intervals that overlap directly or through others.

    size, the number of intervals where it is known, makes the partitions as many as they have to be for a task to sort about SORTED at most.
    """
    if size is not None:
        intervals = intervals.repartition(max(int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SORTED)), *keys)
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("start") >= reach)).cast("int")
    # rows that tie in the window's order start and end together, so the default frame, which takes ties as one, is right for the sum
    return intervals.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def admitted(version_groups: DataFrame, source_groups: DataFrame, keys: list[str]) -> DataFrame:
    """Both sets (keys, start, end on the pivot, group) as one, with kind and row, the number of their island among those that hold both kinds.

    The source is the boundary of admission: an island without a source group, or without a version group, is no row.
    """
    both = version_groups.select(*keys, "start", "end", "group", F.lit("version").alias("kind")).unionByName(source_groups.select(*keys, "start", "end", "group", F.lit("source").alias("kind")))
    marked = islands(both.where("`start` is not null and `end` > `start`"), keys)
    of = Window.partitionBy(*keys, "island")
    kept = marked.withColumns({"_v": F.max((F.col("kind") == "version").cast("int")).over(of), "_s": F.max((F.col("kind") == "source").cast("int")).over(of)}).where("_v = 1 and _s = 1")
    return kept.withColumn("row", F.dense_rank().over(Window.partitionBy(*keys).orderBy("island"))).drop("_v", "_s", "island")


def relation_summary(relation: str, left: str, right: str) -> Column:
    """Aggregate: one group's own relation, else the sums of both sides."""
    return F.when(F.count(relation) == 1, F.max(relation)).otherwise(F.concat_ws(":", F.coalesce(F.sum(left), F.lit(0)).cast("string"), F.coalesce(F.sum(right), F.lit(0)).cast("string")))


def joined(column: str, index: str = "source_index", between: str = "\n\n") -> Column:
    """Aggregate: texts that are not empty, in order, with a blank line between."""
    rows = F.sort_array(F.collect_list(F.when(T.text_of(column) != "", F.struct(F.col(index).alias("i"), F.col(column).alias("t")))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), between)


def side_texts(members: DataFrame, keys: list[str], side: str, index: str = "source_index") -> DataFrame:
    """For each row of members (keys, row and paragraph columns) the joined texts and, of a version, normal forms, characters and first chapter of a side; a paragraph counts once."""
    once = members.dropDuplicates([*keys, "row", "source_index"])
    texts = [joined("text", index).alias(side)]
    if side == "tw":
        texts.append(joined("cn_text", index).alias("tw_cn"))
    if side != "jp":
        texts.append(joined("normal", index, "").alias(f"{side}_normal"))
    return once.groupBy(*keys, "row").agg(*texts, F.sum("chars").alias(f"{side}_chars"), F.min_by("chapter", index).alias(f"{side}_chapter"), F.count("*").alias(f"{side}_items"))


def refinable(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, score of rows (keys, row, score, and of both versions the text and _items) with a low score that may have sentences to align. An item has one sentence at
    least, and no more where it has no mark that ends one, so most rows are told by their items and texts before any is cut.
    """
    few = (F.col("cn_items") <= FRAGMENTS) & (F.col("tw_items") <= FRAGMENTS)
    return rows.where(F.col("score") < LOW).where(few & (F.col("cn").rlike(T.UNIT_ENDS) | F.col("tw").rlike(T.UNIT_ENDS))).select(*keys, "row", "score")


def refine(low: DataFrame, cn_items: DataFrame, tw_items: DataFrame, keys: list[str], normal=align.cjk) -> DataFrame:
    """keys, row, refined_relation, refined_score of refinable rows whose sentences align better.

    items are those of these rows (keys, row, source_index, lang, text, ...). Rows whose sides are at most so many sentences, and more than their items on one side, are aligned again.
    """
    by = [*keys, "row"]
    cn, tw = (segment.fragments(items, by) for items in (cn_items, tw_items))
    count = lambda f, items, c: f.groupBy(*by).agg(F.count("*").alias(f"{c}_f")).join(items.groupBy(*by).agg(F.count("*").alias(f"{c}_n")), by)
    able = count(cn, cn_items, "cn").join(count(tw, tw_items, "tw"), by).where((F.col("cn_f") <= FRAGMENTS) & (F.col("tw_f") <= FRAGMENTS) & ((F.col("cn_f") > F.col("cn_n")) | (F.col("tw_f") > F.col("tw_n")))).select(*by)
    side = lambda f, c: f.join(able, by).select(*by, F.col("frag").alias("idx"), F.col(c).alias("text"))
    groups = align.align_core(side(cn, "text"), side(tw, "cn_text"), by, REFINE_BAND, normal)
    plain = F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("score") + align.MERGE * (F.col("a") + F.col("b") - 2))
    found = groups.withColumn("_own", F.concat_ws(":", "a", "b")).groupBy(*by).agg(relation_summary("_own", "a", "b").alias("refined_relation"), F.coalesce(F.avg(plain), F.lit(0.0)).alias("refined_score"))
    return found.join(low, by).where(F.col("refined_score") >= F.greatest(F.lit(ACCEPT), F.col("score") + GAIN)).drop("score")


def kept_without_copies(df: DataFrame, copy: str, of: str, keep) -> DataFrame:
    """keep(df), without the values of a column that are those of another; they are put back where they are read."""
    same = df.withColumn("_same", F.col(copy).eqNullSafe(F.col(of)))
    return keep(same.withColumn(copy, F.when(~F.col("_same"), F.col(copy)))).withColumn(copy, F.when(F.col("_same"), F.col(of)).otherwise(F.col(copy))).drop("_same")


def compared(normal) -> Column:
    """The form in which a version's paragraph is compared: of its text in simplified script."""
    return normal(F.when(F.col("lang") == "tw", F.col("cn_text")).otherwise(F.col("text")))


def compare_rows(paragraphs: DataFrame, version_groups: DataFrame, source_groups: DataFrame, keys: list[str], mode: str = "trilingual", pivot: str = "cn", normal=align.cjk, keep=lambda df: df) -> DataFrame:
    """Rows: keys, index, chapter, relation, jp, jp_align_score, cn, tw, tw_cn, score, refined_score and characters.

    version_groups are align_versions of cn and tw, source_groups align of jp and the pivot (left is the source). A source group with an empty side says nothing.
    paragraphs may have `normal`, the form in which versions are compared; where they have none, it is worked out here, once for each paragraph of a row.
    keep(df) may write a stage and read it back, which restarts and plans are the shorter for.
    """
    bilingual = mode == "bilingual"
    v = version_groups.withColumn("group", F.row_number().over(Window.partitionBy(*keys).orderBy("left_start", "right_start", "left_end", "right_end")))
    s = source_groups.where("left_end > left_start and right_end > right_start").withColumn("group", F.row_number().over(Window.partitionBy(*keys).orderBy("left_start")))
    side = "left" if pivot == "cn" else "right"
    at = admitted(v.select(*keys, F.col(f"{side}_start").alias("start"), F.col(f"{side}_end").alias("end"), "group"), s.select(*keys, F.col("right_start").alias("start"), F.col("right_end").alias("end"), "group"), keys)
    at = keep(at)
    v = keep(v.join(at.where("kind = 'version'").select(*keys, "group", "row"), [*keys, "group"]))
    s = keep(s.join(at.where("kind = 'source'").select(*keys, "group", "row"), [*keys, "group"]))

    def members(groups: DataFrame, side: str, lang: str, keep=lambda df: df) -> DataFrame:
        spread = keep(groups.where(F.col(f"{side}_end") > F.col(f"{side}_start")).select(*keys, "row", F.explode(F.sequence(F.col(f"{side}_start"), F.col(f"{side}_end") - 1)).alias("source_index")))
        found = spread.join(paragraphs.where(F.col("lang") == lang), [*keys, "source_index"])
        return found if lang == "jp" or "normal" in found.columns else found.withColumn("normal", compared(normal))

    by, versions = [*keys, "row"], (("left", "cn"), ("right", "tw"))
    size = lambda c: F.col(f"{c}_end") - F.col(f"{c}_start")
    rel = lambda g, name: g.withColumns({"_l": size("left"), "_r": size("right")}).groupBy(*by).agg(relation_summary("relation", "_l", "_r").alias(name))
    out = rel(v, "_v").join(rel(s, "_s"), by).join(s.groupBy(*by).agg(F.avg("score").alias("jp_align_score")), by)
    for groups, side, name in ((v, "left", "cn"), (v, "right", "tw"), (s, "left", "jp")):
        out = out.join(side_texts(members(groups, side, name), keys, name), by, "left")
    out = out.withColumns({c: T.text_of(c) for c in ("cn", "tw", "tw_cn", "jp")})
    # a normal form is worked out piece by piece, so that of a row is what its paragraphs have
    score = T.row_score(T.text_of("cn_normal"), T.text_of("tw_normal"), (F.col("cn") == "") | (F.col("tw_cn") == ""))
    out = out.withColumn("score", F.col("jp_align_score") if bilingual else score).drop("cn_normal", "tw_normal")
    if bilingual:
        out = out.withColumns({"refined_score": F.lit(None).cast("double"), "relation": F.concat(F.lit("原文-译文 "), "_s")})
    else:
        out = kept_without_copies(out, "tw_cn", "tw", keep)
        low = keep(refinable(out, keys))
        # written before they are cut: Spark infers from the cut that there is something to cut and would test that on the items of all rows
        # and their places are written too, as Spark sends few of them to the paragraphs where it knows how many there are
        items = [keep(members(v.join(low.select(*by), by), side, name, keep)) for side, name in versions]
        out = out.join(keep(refine(low, *items, keys, normal)), by, "left")
        version = F.coalesce(F.concat(F.lit("细分 "), F.col("refined_relation")), F.col("_v"))
        out = out.withColumn("relation", F.concat(F.lit("简台 "), version, F.lit(" / 日文 "), F.col("_s")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*keys, F.col("row").alias("index"), F.coalesce("cn_chapter", "tw_chapter", "jp_chapter", F.lit("")).alias("chapter"), "relation", "jp", "jp_align_score", "cn", "tw", "tw_cn", "score", "refined_score", zero("cn_chars"), zero("tw_chars"), zero("jp_chars"))
