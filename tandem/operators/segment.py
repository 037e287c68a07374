"""From texts to paragraphs: blocks with offsets, body slices, chapters carried forward, sentence units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import script
from ..functions import text as T

BREAK = r"\n\s*\n+"
#: What ends the body, by role, as a block of its own.
END_MARKS = {
    "tw": r"第一卷\s*後記|後記|電子書特典|特典|版權頁|版權|版权|colophon|copyright",
    "cn": r"后记|後記|特典|版权页|版权|版權|译注|譯注|colophon|copyright",
    "jp": r"あとがき|後書き|特典|奥付|発行|発行者|colophon|copyright",
}
#: What ends a plain text whose start is given.
PLAIN_ENDS = {"tw": ["第一卷 後記", "\n後記\n", "\n後記\r\n"], "cn": ["后记"], "jp": ["あとがき"]}
NO_CHAPTER = "正文"


def block_ranges(docs: DataFrame, text: str = "text", told: dict[str, Column] | None = None) -> DataFrame:
    """docs with one row for each block between blank lines: block (its number), start, end, block_text.

    The separators themselves are extracted, so offsets are sums of lengths of what precedes. told are columns of block_text and of docs that are worked out before
    blocks are dealt and sorted, in place of block_text.
    """
    keys = [c for c in docs.columns if c != text]
    parts = F.split(T.text_of(text), BREAK, -1)
    gaps = F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all(T.text_of(text), F.lit(f"({BREAK})"), F.lit(1)), lambda s: F.length(s)))
    rows = docs.select(*keys, F.posexplode(F.arrays_zip(parts.alias("t"), gaps.alias("g"))).alias("block", "_p"))
    sizes = rows.select(*keys, "block", F.col("_p.t").alias("block_text"), F.coalesce(F.col("_p.g"), F.lit(0)).alias("_g"), F.length(F.col("_p.t")).alias("_n"))
    names = ["block_text"] if told is None else list(told)
    if told is not None:
        sizes = sizes.select(*keys, "block", "_g", "_n", *[c.alias(n) for n, c in told.items()])
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("_g") + F.col("_n")).over(before)
    return sizes.select(*keys, "block", (end - F.col("_n")).alias("start"), end.alias("end"), *names)


def slice_main(text: Column, start_marker: str, end_markers: list[str], require_start: bool = True, trim_end: bool = True) -> Column:
    """From the start marker to the earliest end marker after it; without a start an error or the whole text."""
    start = F.locate(start_marker, text)
    tail = F.substr(text, start)
    ends = F.array_compact(F.array(*[F.nullif(F.locate(m, tail), F.lit(0)) for m in end_markers])) if end_markers else F.array().cast("array<int>")
    cut = F.when(F.size(ends) > 0, F.left(tail, F.array_min(ends) - 1)).otherwise(tail) if trim_end else tail
    missing = F.raise_error(F.lit(f"Cannot find start marker: {start_marker}")).cast("string") if require_start else text
    return F.when(start > 0, cut).otherwise(missing)


def body_start(docs: DataFrame, keys: list[str], markers: dict[str, str] | None = None) -> DataFrame:
    """docs (keys, lang, text) with body_start, the offset of the first likely body block or of the role's marker; -1 if there is none.

    A synopsis hides what follows it up to a picture or heading. Whether a block is hidden depends on the last block that
    opens or closes one, so the last such block decides; a picture block that closes is itself no body.
    """
    lang = F.col("lang")
    state = T.let(T.collapse("block_text"), lambda t: F.when(t.rlike(T.SYNOPSIS), True).when(T.is_media(t) | (T.heading(t, lang) != ""), False))
    rows = block_ranges(docs.select(*keys, "lang", "text"), told={"_state": state, "_body": T.is_likely_body(F.col("block_text"), lang)})
    up_to = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    hidden = F.coalesce(F.last("_state", ignorenulls=True).over(up_to), F.lit(False))
    first = rows.withColumn("_body", ~hidden & F.col("_body")).groupBy(*keys).agg(F.min(F.when(F.col("_body"), F.col("start"))).alias("_first"))
    marker = F.lit(None).cast("int")
    for role, m in (markers or {}).items():
        if m:
            marker = F.when(F.col("lang") == role, F.nullif(F.locate(m, F.col("text")), F.lit(0)) - 1).otherwise(marker)
    return docs.join(first, keys).withColumn("body_start", F.coalesce(marker, F.col("_first"), F.lit(-1)).cast("int")).drop("_first")


def slice_document(docs: DataFrame, keys: list[str], markers: dict[str, str] | None = None) -> DataFrame:
    """docs with text cut to its body.

    The end is the first end mark after the start with no chapter heading between it and the next mark, so an afterword between two works is kept.
    """
    started = body_start(docs, keys, markers)
    body = started.withColumn("text", F.when(F.col("body_start") >= 0, F.substr("text", F.col("body_start") + 1)).otherwise(F.col("text")))
    marked = T.by_role(F.col("lang"), END_MARKS, lambda p: T.strip("block_text").rlike(rf"(?i)^(?:{p})(?:\s|$|[：:])"))
    order = Window.partitionBy(*keys).orderBy("block")
    # a section goes from a mark's block to the next mark; headings within it belong to its mark
    rows = block_ranges(body.where("body_start >= 0").select(*keys, "lang", "text"), told={"_mark": F.coalesce(marked, F.lit(False)), "_title": T.heading(F.col("block_text"), F.col("lang")) != ""})
    rows = rows.withColumn("_section", F.sum(F.col("_mark").cast("int")).over(order))
    ends = rows.where("_section > 0").groupBy(*keys, "_section").agg(F.min("start").alias("_end"), F.bool_or(F.col("_title") & ~F.col("_mark")).alias("_later"))
    cut = ends.where("not _later").groupBy(*keys).agg(F.min("_end").alias("_end"))
    out = body.join(cut, keys, "left")
    kept = F.regexp_replace(F.left("text", F.col("_end")), r"\n\s*\n\s*$", "")
    return out.withColumn("text", F.when(F.col("_end").isNotNull(), kept).otherwise(F.col("text"))).drop("_end", "body_start")


def slice_for_input(docs: DataFrame, keys: list[str], input_mode: str = "document", markers: dict[str, str] | None = None) -> DataFrame:
    """Plain texts whose role has a start marker are cut between markers, all others as documents."""
    given = {r: m for r, m in (markers or {}).items() if m} if input_mode == "txt" else {}
    out = slice_document(docs.where(~F.col("lang").isin(list(given))) if given else docs, keys, markers)
    for role, m in given.items():
        out = out.unionByName(docs.where(F.col("lang") == role).withColumn("text", slice_main(F.col("text"), m, PLAIN_ENDS[role])))
    return out


def paragraphs(docs: DataFrame, keys: list[str], to_cn=script.to_cn) -> DataFrame:
    """keys, lang, source_index (from 0 without gaps), chapter, text, cn_text, chars of each paragraph; headings become the chapter of what follows."""
    # blocks are collapsed before they become rows, so the tests below read a column and not the expression
    rows = docs.select(*keys, "lang", F.posexplode(F.transform(T.blocks("text"), T.collapse)).alias("_at", "text"))
    rows = rows.where((F.col("text") != "") & ~F.col("text").rlike(T.SEPARATOR) & ~T.is_media(F.col("text")))
    order = Window.partitionBy(*keys, "lang").orderBy("_at")
    rows = rows.withColumn("_title", F.nullif(T.heading(F.col("text"), F.col("lang")), F.lit("")))
    rows = rows.withColumn("chapter", F.coalesce(F.last("_title", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(NO_CHAPTER)))
    rows = rows.where("_title is null").withColumn("source_index", F.row_number().over(order) - 1)
    cn_text = F.when(F.col("lang") == "tw", to_cn("text")).otherwise(F.col("text"))
    return rows.select(*keys, "lang", "source_index", "chapter", "text", cn_text.alias("cn_text"), F.length("text").alias("chars"))


def load_paragraphs(docs: DataFrame, keys: list[str], mode: str = "trilingual", input_mode: str = "document", markers: dict[str, str] | None = None) -> DataFrame:
    """Paragraphs of all roles in one pass; bilingual mode has no third version."""
    roles = docs.where(F.col("lang").isin("jp", "cn") | (F.lit(mode != "bilingual") & (F.col("lang") == "tw")))
    return paragraphs(slice_for_input(roles, [*keys, "lang"] if "lang" not in keys else keys, input_mode, markers), keys)


def fragments(items: DataFrame, keys: list[str], to_cn=script.to_cn) -> DataFrame:
    """Items split into sentences where they have more than one, with the item's other columns; frag numbers them within keys."""
    units = T.comparable_units("text")
    rows = items.withColumn("_u", T.let(units, lambda u: F.when(F.size(u) > 1, u).otherwise(F.array(F.col("text"))))).select(*[c for c in items.columns if c not in ("text", "cn_text", "chars")], F.posexplode("_u").alias("_p", "text"))
    order = Window.partitionBy(*keys).orderBy("source_index", "_p")
    return rows.withColumns({"cn_text": F.when(F.col("lang") == "tw", to_cn("text")).otherwise(F.col("text")), "chars": F.length("text"), "frag": F.row_number().over(order) - 1}).drop("_p")
