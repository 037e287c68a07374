"""Reading inputs: directory listings, roles, plain texts, converters, uploads."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Formats by extension, and the roles of a comparison.
FORMATS = {"csv": "csv", "docbook": "docbook", "docx": "docx", "epub": "epub", "html": "html", "htm": "html", "json": "json", "md": "markdown", "markdown": "markdown", "odt": "odt", "rst": "rst", "rtf": "rtf", "tsv": "tsv"}
ROLES = {"bilingual": ["jp", "cn"], "trilingual": ["jp", "cn", "tw"]}
#: What a file name says of its role; the roles are tried in this order, each over the files that are left.
HINTS = {"jp": "[ぁ-んァ-ヶー]", "cn": r"[简简中汉栖这学园诡诈骗权译]|(?i)\bcn\b", "tw": r"[繁台臺這學園詐騙權譯鎌馬]|(?i)\btw\b"}
#: Files that a directory has to hold at least.
LEAST_FILES = {"bilingual": 2, "trilingual": 3}
MAX_UPLOAD = 80 << 20


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def format_of(path: Column) -> Column:
    return F.get(F.array(F.create_map(*[F.lit(x) for p in FORMATS.items() for x in p])[extension(path)]), F.lit(0))


def listing(spark: SparkSession, directory: str) -> DataFrame:
    """Supported files of a directory, not of those below: path, name, format, size, modified; in the order of their names for Chinese readers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    found = files.withColumns({"name": basename(F.col("path")), "ext": extension(F.col("path"))}).where(F.col("ext").isin("txt", *FORMATS))
    return found.withColumn("format", F.coalesce(format_of(F.col("path")), F.lit("txt"))).orderBy(F.expr("name collate zh"))


def scan(spark: SparkSession, directory: str, mode: str = "trilingual") -> DataFrame:
    """The listing of a directory with the role that each file's name suggests; an error where there are fewer files than roles."""
    found = listing(spark, directory)
    if (n := found.count()) < LEAST_FILES[mode]:
        raise ValueError(f"{LEAST_FILES[mode]} supported files are needed, {n} found")
    return guess_roles(found, mode)


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), T.read_text("value").alias("text"))


def converted(files: DataFrame, to: str = "plain", command: str = "pandoc", source: str = "content") -> DataFrame:
    """(path, output, error) of binary files through an external converter on the executors. What fails, a missing converter too, is an error of its file."""

    @F.pandas_udf("output string, error string")
    def run(content: pd.Series, fmt: pd.Series) -> pd.DataFrame:
        out = []
        for c, f in zip(content, fmt):
            try:
                done = subprocess.run([command, "-f", f, "-t", to, "--wrap=none"], input=c, capture_output=True, check=True)
                out.append((done.stdout.decode("utf-8", "replace"), None))
            except FileNotFoundError:
                out.append((None, f"{command} is not installed"))
            except subprocess.CalledProcessError as e:
                out.append((None, e.stderr.decode("utf-8", "replace").strip() or str(e)))
        return pd.DataFrame(out, columns=["output", "error"])

    return files.withColumn("_c", run(F.col(source), format_of(F.col("path")))).select("path", F.col("_c.output").alias("output"), F.col("_c.error").alias("error"))


def convert(files: DataFrame, source: str = "content", command: str = "pandoc") -> DataFrame:
    """(path, text) of binary files through an external converter; an error of the job where a file has one."""
    found = converted(files, "plain", command, source)
    return found.select("path", F.when(F.col("error").isNull(), T.document_text("output")).otherwise(F.raise_error(F.col("error")).cast("string")).alias("text"))


def read_inputs(spark: SparkSession, directory: str, inline: dict | None = None, books_by: str = "auto") -> DataFrame:
    """(path, text) of all supported files, each by its own reader; books_by is epub.read_books' converter."""
    from . import epub, markup

    files = spark.read.format("binaryFile").load(directory).withColumn("_f", F.coalesce(format_of(F.col("path")), F.lit("txt")))
    plain = files.where(F.col("_f").isin("txt", "markdown", "csv", "tsv", "json", "rst")).select("path", T.read_text(F.decode("content", "UTF-8")).alias("text"))
    html = files.where("_f = 'html'").select("path", markup.html_text(F.decode("content", "UTF-8"), inline or {}).alias("text"))
    books = epub.read_books(files.where("_f = 'epub'").select("path", "content"), books_by, inline or {}).select("path", "text")
    other = convert(files.where(F.col("_f").isin("docbook", "docx", "odt", "rtf")))
    return plain.unionByName(html).unionByName(books).unionByName(other)


def input_mode(files: DataFrame, path: str = "path", *keys: str) -> DataFrame:
    """What kind of input the files are, all of them or those of each key."""
    ext = extension(F.col(path))
    return files.groupBy(*keys).agg(F.when(F.every(ext == "txt"), "txt").when(F.every(ext == "epub"), "epub").otherwise("document").alias("input_mode"))


def guess_roles(files: DataFrame, mode: str = "trilingual") -> DataFrame:
    """files (name) with role: for each role in turn the first unused file that its hint fits, then the first unused one; null for the rest.

    A listing is small; a role is taken by a join with the files that are left, never on the driver.
    """
    left = files.withColumn("_n", F.row_number().over(Window.orderBy(F.expr("name collate zh"))))
    taken = None
    for hinted in (True, False):
        for role in ROLES[mode]:
            free = left if taken is None else left.join(taken.select("_n"), "_n", "left_anti")
            if taken is not None and not hinted:
                free = free.join(taken.where(F.col("role") == role).select(F.lit(1).alias("_x")), F.lit(True), "left_anti")
            pick = (free.where(F.col("name").rlike(HINTS[role])) if hinted else free).agg(F.min("_n").alias("_n")).where("_n is not null").withColumn("role", F.lit(role))
            taken = pick if taken is None else taken.unionByName(pick)
    return left.join(taken, "_n", "left").drop("_n")


def validate_selection(files: dict[str, str], mode: str = "trilingual", labels: dict[str, str] | None = None) -> dict[str, str]:
    """Labels of a selection with defaults; an error if a role lacks its file or a format is unknown."""
    for role in ROLES[mode]:
        path = files.get(role)
        if not path:
            raise ValueError(f"no file for {role}")
        if path.rsplit(".", 1)[-1].lower() not in {"txt", *FORMATS}:
            raise ValueError(f"format of {path} is not supported")
    return {r: (labels or {}).get(r) or d for r, d in zip(("jp", "cn", "tw"), ("原文 A", "非原文 B", "非原文 C")) if r in ROLES[mode]}


def resolve_selection(given: dict | None = None, saved: dict | None = None, ask: Callable[[dict | None], dict] | None = None, ask_if_saved: bool = False) -> dict:
    """What arguments or the environment select; else what a user answers, asked where nothing is saved or where that is wanted; else what is saved."""
    if given:
        return given
    if ask and (ask_if_saved or not saved):
        return ask(saved)
    if saved:
        return saved
    raise ValueError("no input selection")


def uploads(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, role, name, data in base64) with a safe name, the content and what is wrong, null if nothing."""
    content = F.try_to_binary(F.col("data"), F.lit("base64"))
    name = T.safe_filename("name")
    wrong = F.when(~F.coalesce(F.col("role").isin("jp", "cn", "tw"), F.lit(False)), "role").when(F.coalesce(format_of(name), F.when(extension(name) == "txt", "txt")).isNull(), "format").when(content.isNull(), "base64").when(F.length(content) > MAX_UPLOAD, "size")
    return rows.select(*keys, "role", name.alias("name"), content.alias("content"), wrong.alias("wrong"))
