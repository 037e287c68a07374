"""Written results: CSV with fixed quoting, JSON documents, replace lists."""

from __future__ import annotations

import contextlib
import functools
import json
import operator
import re

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as T
from . import folders

#: Columns of a result by mode, and the part of a replace list that is filled.
CSV_COLUMNS = {"bilingual": ["index", "chapter", "relation", "score", "jpAlignScore", "jp", "cn"], "trilingual": ["index", "chapter", "relation", "score", "jpAlignScore", "jp", "cn", "tw", "twCn"]}
NAMES = {"jpAlignScore": "jp_align_score", "twCn": "tw_cn"}
PAIR = re.compile(r"(^[ \t]*)<searchtext>[\s\S]*?</searchtext>(\r?\n)\1<replacetext>[\s\S]*?</replacetext>", re.M)
#: Bytes of a project's lines beyond which its CSV file is written as several parts.
PART = 64 << 20
TEMPLATE = "<list>\n  <searchtext></searchtext>\n  <replacetext></replacetext>\n</list>\n"


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(rows: DataFrame, mode: str = "trilingual") -> DataFrame:
    """index, line of each row: every value quoted, quotes doubled, null as empty."""
    return rows.select("index", F.concat_ws(",", *[quoted(F.col(NAMES.get(c, c))) for c in CSV_COLUMNS[mode]]).alias("line"))


def csv_header(mode: str = "trilingual") -> str:
    return ",".join(CSV_COLUMNS[mode])


def in_order(head: list[str], rows: DataFrame, tail: list[str] = ()) -> DataFrame:
    """(value) of single lines, of rows (index, line) in order of index, and of lines after them, so that the written parts one after the other are one file."""
    spark = rows.sparkSession
    fixed = lambda at, lines: spark.createDataFrame([(at, n, x) for n, x in enumerate(lines)], "_at int, index long, line string")
    every = fixed(0, head).unionByName(rows.select(F.lit(1).alias("_at"), F.col("index").cast("long").alias("index"), "line")).unionByName(fixed(2, tail))
    return every.repartitionByRange("_at", "index").sortWithinPartitions("_at", "index").select(F.col("line").alias("value"))


def write_csv(rows: DataFrame, path: str, mode: str = "trilingual", keys: tuple[str, ...] = ()) -> None:
    """Parts in order of index that are one file together: the header once and without quotes, then every value in quotes. A value's line breaks stay.

    With keys each project gets one file, see write_files, or more than one where its lines have over PART bytes: cut by index, in order of the numbers of the files.
    """
    if not keys:
        return in_order([csv_header(mode)], csv_lines(rows, mode)).write.mode("overwrite").text(path)
    lines = rows.select(*keys, "index", F.concat_ws(",", *[quoted(F.col(NAMES.get(c, c))) for c in CSV_COLUMNS[mode]]).alias("line"))
    first = F.concat(F.lit(csv_header(mode) + "\n"), "line")
    sizes = lines.groupBy(*keys).agg(F.sum(F.octet_length("line")).alias("bytes"))
    # as few as the bytes of all lines hold PART
    large = sizes.where(F.col("bytes") > PART).collect()
    if not large:
        return write_files(lines, path, keys, first)
    small = in_files(lines.where(~among(large, keys)), keys, first).select(*keys, F.lit(1).alias("_at"), F.col("_row").cast("long").alias("index"), "value")
    every = small.unionByName(in_parts(lines.where(among(large, keys)), keys, csv_header(mode), large))
    # the writer asks for rows sorted by keys and would sort them anew, were they not
    put_files(every.sortWithinPartitions(*keys, "_at", "index", "value").select(*keys, "value"), path, keys)


def among(projects: list[Row], keys: tuple[str, ...]) -> Column:
    """Whether a row is of one of a few projects; a null key is one."""
    return functools.reduce(operator.or_, [functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.lit(p[k])) for k in keys]) for p in projects])


def in_parts(lines: DataFrame, keys: tuple[str, ...], head: str, sizes: list[Row]) -> DataFrame:
    """(keys, _at, index, value): lines of large projects (keys, bytes) and the head before each, dealt to one task for each PART of a project by quantiles of index; tasks of a project follow its order."""
    spark = lines.sparkSession
    parts = [-(-p["bytes"] // PART) for p in sizes]
    most = max(parts)
    quantiles = lines.groupBy(*keys).agg(F.percentile_approx(F.col("index").cast("long"), [n / most for n in range(1, most)], 20 * most).alias("_cuts"))
    found = {tuple(r[k] for k in keys): r["_cuts"] for r in quantiles.collect()}
    told, start = [], 0
    for p, n in zip(sizes, parts):
        key = tuple(p[k] for k in keys)
        told.append((*key, start, [found[key][i * most // n - 1] for i in range(1, n)]))
        start += n
    schema = ", ".join(f"`_{k}` {lines.schema[k].dataType.simpleString()}" for k in keys) + ", _start int, _cuts array<long>"
    cuts = spark.createDataFrame(told, schema)
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    index = F.col("index").cast("long")
    rows = lines.join(F.broadcast(cuts), same).select(*keys, F.lit(1).alias("_at"), index.alias("index"), F.col("line").alias("value"), (F.col("_start") + F.size(F.filter("_cuts", lambda c: c < index))).alias("_part"))
    heads = cuts.select(*[F.col(f"_{k}").alias(k) for k in keys], F.lit(0).alias("_at"), F.lit(0).cast("long").alias("index"), F.lit(head).alias("value"), F.col("_start").alias("_part"))
    return rows.unionByName(heads).repartitionById(start, "_part").drop("_part")


def write_files(lines: DataFrame, path: str, keys: tuple[str, ...], first: Column, other: Column | None = None, tail: str = "") -> None:
    """One file for each project, in <path>/<key>=<value>/: its lines (keys, index, line) in order of index, the first one as `first` says, the rest as `other`, then the tail.

    A project is one task's, which sorts it, on disk where it has to, and writes it line by line. Files appear when all tasks are done; a task that fails leaves nothing.
    """
    put_files(in_files(lines, keys, first, other, tail).drop("_row"), path, keys)


def put_files(rows: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """Writes rows (keys, value), which each task has sorted by keys, as a file for each project and task. On a local or mounted file system tasks write the files themselves, see folders; elsewhere Spark's writer does."""
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    if uri.getScheme() != "file":
        return rows.write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy(*keys).text(path)
    spark.dataSource.register(folders.Folders)
    rows.select(*[F.col(k).cast("string").alias(k) for k in keys], "value").write.format(folders.Folders.name()).mode("overwrite").save(uri.getPath())


@contextlib.contextmanager
def many_folders(spark: SparkSession):
    """Within it, tasks that list folders take many each; Spark would start one for each folder, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_files(lines: DataFrame, keys: tuple[str, ...], first: Column, other: Column | None = None, tail: str = "") -> DataFrame:
    """(keys, _row, value): what write_files writes, a project in one task and in order, its rows numbered."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy(*keys).orderBy("index", "line")
    last = F.lead(F.lit(1)).over(order).isNull() if tail else F.lit(False)
    row = F.row_number().over(order)
    text = F.when(row == 1, first).otherwise(F.col("line") if other is None else other)
    # dealt by number, so that no project is cut in two and no two tasks write one
    return lines.repartition(parts, *keys).select(*keys, row.alias("_row"), F.when(last, F.concat(text, F.lit(tail))).otherwise(text).alias("value"))


def json_rows(rows: DataFrame) -> DataFrame:
    """index, json of each row; a document of all rows is these under a header, so it is written as lines."""
    return rows.select("index", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("index").sortWithinPartitions("index").write.mode("overwrite").json(path)


#: What a result document says before its rows.
DOCUMENT = ("project", "files", "labels", "counts", "rowsSignature")


def document_head(about: dict) -> str:
    return json.dumps({k: about.get(k) for k in DOCUMENT}, ensure_ascii=False)[:-1] + ', "rows": ['


def write_document(rows: DataFrame, path: str, about: dict) -> None:
    """One JSON document, {project, files, labels, counts, rowsSignature, rows}, as parts that make it one after the other. about holds all but the rows, which never meet on the driver.

    Of the rows only the least one does; it and its like stand in the line of the head, so every other row begins with a comma.
    """
    every = json_rows(rows)
    least = every.agg(F.min(F.struct("index", "json")).alias("row")).first().row
    if least is None:
        return in_order([document_head(about)], every.select("index", F.col("json").alias("line")), ["]}"]).write.mode("overwrite").text(path)
    same = (F.col("index") == F.lit(least["index"])) & (F.col("json") == F.lit(least["json"]))
    copies = every.where(same).count()
    lines = every.where(~same).select("index", F.concat(F.lit(","), "json").alias("line"))
    in_order([document_head(about) + ",".join([least["json"]] * copies)], lines, ["]}"]).write.mode("overwrite").text(path)


def write_documents(rows: DataFrame, path: str, keys: tuple[str, ...], about: DataFrame | None = None) -> None:
    """One JSON document for each project (keys), each a file of its own. about has (keys, head), what document_head says of each project."""
    columns = [c for c in rows.columns if c not in keys]
    lines = rows.select(*keys, "index", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))
    lines = lines.join(about.select(*keys, "head"), list(keys), "left") if about is not None else lines.withColumn("head", F.lit(None).cast("string"))
    head = F.coalesce("head", F.lit(document_head({})))
    write_files(lines, path, keys, F.concat(head, "line"), F.concat(F.lit(","), "line"), "]}")


def read_files(spark: SparkSession, path: str, keys: tuple[str, ...], types: dict[str, str] | None = None) -> DataFrame:
    """(keys, content): the files that write_files wrote, each whole; of a project that write_csv cut, its parts."""
    with many_folders(spark):
        found = spark.read.text(path, wholetext=True)
    return found.select(*[F.col(k).cast((types or {}).get(k, "string")).alias(k) for k in keys], F.col("value").alias("content"))


def digests(spark: SparkSession, path: str, keys: tuple[str, ...], types: dict[str, str] | None = None) -> DataFrame:
    """(keys, md5): of each project's content as write_csv wrote it. Where it has several parts, a task reads one and goes on from the state that the part before left, so the driver sees states alone."""
    typed = lambda df: df.withColumns({k: F.col(k).cast((types or {}).get(k, "string")) for k in keys})
    binary = lambda *paths: spark.read.option("basePath", path).format("binaryFile").load(list(paths))
    number = F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("long")
    with many_folders(spark):
        found = binary(path)
    files = typed(found).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(number.alias("n"), "path"))).alias("files"))
    large = files.where(F.size("files") > 1).collect()
    whole = read_files(spark, path, keys, types)
    if not large:
        return whole.select(*keys, F.md5("content").alias("md5"))
    states: dict[int, bytes] = dict.fromkeys(range(len(large)), b"")
    resumed = F.udf(hashing.md5_resumed, "binary", useArrow=True)
    for turn in range(max(len(p["files"]) for p in large)):
        given = [(n, p["files"][turn]["path"], states[n]) for n, p in enumerate(large) if turn < len(p["files"])]
        of = lambda at: F.create_map(*[F.lit(x) for g in given for x in (g[1], g[at])])[F.col("path")]
        now = binary(*[g[1] for g in given]).select(of(0).alias("n"), resumed(of(2), "content").alias("state"))
        states |= {r["n"]: bytes(r["state"]) for r in now.collect()}
    schema = ", ".join(f"`{k}` {whole.schema[k].dataType.simpleString()}" for k in keys) + ", md5 string"
    chained = spark.createDataFrame([(*[p[k] for k in keys], hashing.md5_ended(states[n])) for n, p in enumerate(large)], schema)
    return whole.where(~among(large, keys)).select(*keys, F.md5("content").alias("md5")).unionByName(chained)


def script_safe(json: Column) -> Column:
    """JSON for a script element of a page."""
    return F.replace(json, F.lit("<"), F.lit(chr(92) + "u003c"))


def replace_pairs(entries: DataFrame, indent: str = "  ", newline: str = "\n") -> DataFrame:
    """index, pair of entries (index, search, replace) as they stand in a replace list."""
    pair = F.concat(F.lit(f"{indent}<searchtext>"), T.escape_replace_list("search"), F.lit(f"</searchtext>{newline}{indent}<replacetext>"), T.escape_replace_list("replace"), F.lit("</replacetext>"))
    return entries.select("index", pair.alias("pair"))


def replace_list(entries: DataFrame, template: str = TEMPLATE, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, content: the template with its one pair replaced by all of a key's pairs in order of index."""
    m = PAIR.search(template)
    if not m:
        raise ValueError("the template has no searchtext followed by a replacetext")
    pairs = replace_pairs(entries.select(*keys, "index", "search", "replace"), m[1], m[2]) if not keys else entries.withColumn("pair", F.concat(F.lit(f"{m[1]}<searchtext>"), T.escape_replace_list("search"), F.lit(f"</searchtext>{m[2]}{m[1]}<replacetext>"), T.escape_replace_list("replace"), F.lit("</replacetext>")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "pair"))), lambda x: x["pair"]), m[2])
    return pairs.groupBy(*keys).agg(F.concat(F.lit(template[: m.start()]), body, F.lit(template[m.end() :])).alias("content"))


def selected(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries (index, search, replace) of the chosen rows with a revision: the target version's text and its revision."""
    target = F.when(F.col("revision_target") == "tw", F.col("tw")).otherwise(F.col("cn"))
    return rows.join(ids.select("index").distinct(), "index", "left_semi").where(T.text_of("revision_text") != "").select("index", target.alias("search"), F.col("revision_text").alias("replace"))


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
