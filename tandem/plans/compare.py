"""Building a comparison: texts to paragraphs, embeddings, both alignments, rows, signatures, artifacts."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, points
from ..operators import align, browse, rows, segment
from . import crosslingual, sinks
from .store import scratch

MAX_CHARS, DIMENSIONS = 420, 256


def hashed_ngrams(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Default encoder: counts of hashed runs of one to three characters. It knows no language; a cross-lingual model is given as another encoder."""
    return points.hashed_counts([t.lower() for t in texts], dimensions)


def embed(items: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashed_ngrams, text: str = "text", out: str = "vector") -> DataFrame:
    """items with unit vectors of the first 420 code points of their texts; load() gives the encoder, once for each task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in batches:
            v = np.asarray(encode([t or "" for t in s]), np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)))

    return items.withColumn(out, run(F.left(text, F.lit(MAX_CHARS))))


def kept_in(spark: SparkSession):
    """df -> df written to the shared folder and read back."""
    root, n = scratch(spark), itertools.count()

    def keep(df: DataFrame) -> DataFrame:
        df.write.parquet(path := f"{root}/{next(n)}")
        return spark.read.schema(df.schema).parquet(path)

    return keep


def side(paragraphs: DataFrame, keys: list[str], lang: str, text: str = "text") -> DataFrame:
    return paragraphs.where(F.col("lang") == lang).select(*keys, F.col("source_index").cast("int").alias("idx"), F.col(text).alias("text"), *[c for c in paragraphs.columns if c == "normal"])


def embedded(paragraphs: DataFrame, keys: list[str], pivot: str, load, keep, learnt: bool) -> DataFrame:
    """Paragraphs of the source and the pivot with vectors. If learnt, source vectors are turned into the pivot's space by a mapping from anchors, where there are enough."""
    vectors = embed(paragraphs.where(F.col("lang").isin("jp", pivot)), load)
    if not learnt:
        return vectors  # each side is read once, so writing it would only cost
    vectors = keep(vectors)
    matrix = crosslingual.learn(vectors, crosslingual.anchor_pairs(paragraphs, keys, "jp", pivot), keys, "jp", pivot)
    if matrix is None:
        return vectors

    return keep(vectors.withColumn("vector", F.when(F.col("lang") == "jp", crosslingual.turned(matrix)("vector")).otherwise(F.col("vector"))))


def compare(paragraphs: DataFrame, keys: list[str], mode: str = "trilingual", pivot: str = "cn", load=lambda: hashed_ngrams, normal=align.cjk, keep=None, learnt: bool = False) -> DataFrame:
    """Signed comparison rows of paragraphs (keys, lang, source_index, chapter, text, cn_text, chars); see rows.compare_rows.

    learnt maps the source's vectors into the pivot's space, see crosslingual. Each stage is written under the shared folder and read back, unless keep says otherwise.
    """
    keep = keep or kept_in(paragraphs.sparkSession)
    # normal forms are worked out once; both the alignment of versions and the rows need them
    paragraphs = rows.kept_without_copies(paragraphs.withColumn("normal", F.when(F.col("lang") != "jp", rows.compared(normal))), "cn_text", "text", keep)
    pivot = "cn" if mode == "bilingual" else pivot
    vectors = embedded(paragraphs, keys, pivot, load, keep, learnt)
    of = lambda lang: vectors.where(F.col("lang") == lang).select(*keys, F.col("source_index").cast("int").alias("idx"), "vector")
    source = keep(align.align_vectors(of("jp"), of(pivot), keys))
    version = keep(align.align_versions(side(paragraphs, keys, "cn"), side(paragraphs, keys, "tw", "cn_text"), keys, normal=lambda c: F.col("normal")))
    found = rows.compare_rows(paragraphs, version, source, keys, mode, pivot, normal, keep)
    return found.withColumn("signature", hashing.row_signature("jp", "cn", "tw", "tw_cn", "relation"))


def signatures(signed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows_signature, row_count."""
    return signed.groupBy(*keys).agg(hashing.table_signature(F.col("index"), F.col("signature")).alias("rows_signature"), F.count("*").alias("row_count"))


def pivot_of(mode: str = "trilingual", stored: DataFrame | None = None) -> str:
    """The version that the source is aligned with: B of two, else what a stored alignment (pivot) says, C where it says nothing."""
    if mode == "bilingual":
        return "cn"
    row = stored.select("pivot").first() if stored is not None else None
    return (row.pivot if row else None) or "tw"


def alignment(paragraphs: DataFrame, keys: list[str], pivot: str = "cn", load=lambda: hashed_ngrams, keep=None) -> DataFrame:
    """The alignment of the source with its pivot as it is stored, a row for each key: pivot, window, counts, mapping (index, pivot_index, score) and groups (start, end, pivot_start, pivot_end, score)."""
    keep = keep or kept_in(paragraphs.sparkSession)
    vectors = keep(embed(paragraphs.where(F.col("lang").isin("jp", pivot)), load))
    of = lambda lang: vectors.where(F.col("lang") == lang).select(*keys, F.col("source_index").cast("int").alias("idx"), "vector")
    listed = lambda df, name, *c: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*c))).alias(name))
    mapping = listed(align.point_mapping(of("jp"), of(pivot), keys), "mapping", F.col("left_index").alias("index"), F.col("right_index").alias("pivot_index"), "score")
    found = align.align_vectors(of("jp"), of(pivot), keys)
    groups = listed(found, "groups", F.col("left_start").alias("start"), F.col("left_end").alias("end"), F.col("right_start").alias("pivot_start"), F.col("right_end").alias("pivot_end"), "score")
    counts = vectors.groupBy(*keys).agg(F.count_if(F.col("lang") == "jp").alias("source_count"), F.count_if(F.col("lang") == pivot).alias("pivot_count"))
    fixed = [F.lit(pivot).alias("pivot"), F.lit(align.VECTOR_WINDOW).alias("search_window")]
    return counts.join(mapping, keys, "left").join(groups, keys, "left").select(*keys, *fixed, "source_count", "pivot_count", "mapping", "groups")


def build(docs: DataFrame, keys: list[str], staging: str, mode: str = "trilingual", input_mode: str = "document", markers: dict | None = None, load=lambda: hashed_ngrams, about: dict | None = None) -> DataFrame:
    """Writes the artifacts of docs (keys, lang, text) to a staging folder, each stage read back from what the one before wrote; returns the rows."""
    spark = docs.sparkSession
    segment.load_paragraphs(docs, keys, mode, input_mode, markers).write.parquet(f"{staging}/paragraphs")
    paragraphs = spark.read.parquet(f"{staging}/paragraphs")
    alignment(paragraphs, keys, "cn", load).write.parquet(f"{staging}/alignment")
    compare(paragraphs, keys, mode, load=load).write.parquet(f"{staging}/rows")
    found = spark.read.parquet(f"{staging}/rows")
    sinks.write_csv(found, f"{staging}/csv", mode)
    counts = {r.lang: r["count"] for r in paragraphs.groupBy("lang").count().collect()}
    signed = signatures(found, keys).limit(2).collect()  # a document is of one project; several have no signature in common
    sinks.write_document(found, f"{staging}/json", {"counts": {x: counts.get(x, 0) for x in ("jp", "cn", "tw")}, "rowsSignature": signed[0].rows_signature if len(signed) == 1 else None, **(about or {})})
    shown = browse.client_rows(found, F.col("signature"))
    sinks.json_rows(shown).select("index", sinks.script_safe(F.col("json")).alias("json")).write.json(f"{staging}/html")
    sinks.replace_pairs(found.select("index", F.col("cn").alias("search"), F.col("cn").alias("replace")).where("false")).write.json(f"{staging}/replace_list")
    return found


def progress(done: DataFrame, total: int, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Rows of a finished count as progress events mapped to a range."""
    n = F.row_number().over(Window.orderBy("at"))  # a run reports some hundred times at most
    return done.select("at", n.alias("current"), F.lit(total).alias("total"), (F.floor((low + (high - low) * n / max(1, total)) * 10 + 0.5) / 10).alias("percent"))
