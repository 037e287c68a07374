"""A training corpus from `documents`: toxic texts go, one of each group of near copies stays, benchmark passages are cut out, sources are mixed to
their targets, and the result is dealt to shards.

Every stage but the last returns the columns of documents. Null and empty texts pass the filters (they have no words), take no part in
the mix and so end there. Rows are told apart by ids of their own, so repeated doc_ids and rows without one are rows like others: equal rows are copies, of which
one stays. Very long texts are judged whole. Columns named like added ones keep their names and values up to the last stage, which renames them to a free name.
An empty table gives an empty one; without labels no text is toxic, without benchmark nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import decontaminate, jaccard, mixing, sharding, toxicity
from tandem.llm.common import Workspace, free_name, read


def apart(docs: DataFrame, added: set[str]) -> tuple[DataFrame, list[Column]]:
    """docs with columns named like added ones under other names, and the columns that bring the old names back."""
    prefix = "_own"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    names = {c: f"{prefix}{i}" for i, c in enumerate(docs.columns) if c.lower() in added}
    return docs.withColumnsRenamed(names), [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold. The field learns from the labels of the documents that it is given."""
    model = toxicity.fit(*toxicity.weighted_sample(docs, read(spark, sf_dir, "labels")))
    docs, own = apart(docs, {"score", "predicted", "toxic_spans"})
    return toxicity.score(docs, model).where("predicted = 0").select(own)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest doc_id (null last), of each group that links of 5-word shingles at a Jaccard similarity of 0.8 or more join."""
    number = free_name(docs, "_copy_row")
    kept = Workspace(spark, "copies").keep(docs.withColumn(number, F.monotonically_increasing_id()))
    slim = kept.select(F.col(number).alias("doc_id"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), "text")
    found = jaccard.join(slim, k=5, percent=80, columns=["doc_id", "_id", "_text"])
    row = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_text", F.col("doc_id").alias("row"))
    first = found.groupBy("component_id").agg(F.min(row)["row"].alias("_first"))
    gone = found.join(first, F.col("doc_id") == F.col("_first"), "left_anti").select(F.col("doc_id").alias(number))
    return kept.join(gone, number, "left_anti").select(docs.columns)


def benchmark_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows; one that consists of nothing else goes."""
    docs, own = apart(docs, {"n_words", "hit_spans", "items"} | {"_n_words", "_hit_spans", "_items"})
    found = decontaminate.find_hits(docs, read(spark, sf_dir, "benchmark"), remove=True)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    kept = found.where((n_hit == 0) | (n_hit < F.col("n_words")))
    return kept.withColumn("n_chars", F.when(n_hit == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(own)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target says."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it."""
    return sharding.shard(docs)


STAGES = [("toxicity", toxicity_filter), ("near copies", near_copies), ("benchmark decontamination", benchmark_cut), ("source mix", source_mix), ("shards", shards)]

#: Neither the field of the first stage nor its fitting can be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, docs = Workspace(spark, "pipeline"), read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = ws.keep(docs)
    return docs
