"""A mapping from the vectors of one language to those of another, learnt from the books themselves.

The default encoder hashes character n-grams, so a source and a version of another script have nothing in common but their lengths. Pairs of paragraphs that must belong together
(anchors) show which directions of one space stand for which of the other: the sum of their outer products is the cross-covariance, which partitions sum and Spark adds up, and the
orthogonal matrix that fits it best (Procrustes) turns source vectors into the version's space. Only that d x d sum reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Anchors below which nothing is learnt; a mapping of few pairs would fit them alone.
LEAST = 50


def anchor_pairs(paragraphs: DataFrame, keys: list[str], source: str = "jp", pivot: str = "cn") -> DataFrame:
    """(keys, source_index, pivot_index): paragraphs whose numbers and Latin words are the same and stand in one paragraph of each side alone."""
    tokens = T.protected_tokens(T.canonical("text"))
    told = paragraphs.where(F.col("lang").isin(source, pivot)).withColumn("_t", tokens).where(F.size("_t") > 0)
    marks = told.select(*keys, "lang", "source_index", F.xxhash64(F.array_join("_t", " ")).alias("_mark"))
    only = marks.groupBy(*keys, "lang", "_mark").agg(F.count("*").alias("_n"), F.min("source_index").alias("_at")).where("_n = 1")
    side = lambda lang, name: only.where(F.col("lang") == lang).select(*keys, "_mark", F.col("_at").alias(name))
    return side(source, "source_index").join(side(pivot, "pivot_index"), [*keys, "_mark"]).drop("_mark")


def cross_covariance(pairs: DataFrame, left: str = "left", right: str = "right") -> tuple[np.ndarray, int]:
    """Sum of the outer products of two vector columns, and the number of pairs: partitions sum, Spark adds a row of the matrix at a time."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for pdf in batches:
            if len(pdf):
                a, b = (np.stack(pdf[c].to_list()).astype(float) for c in ("left", "right"))
                total, n = (a.T @ b if total is None else total + a.T @ b), n + len(pdf)
        if n:
            yield pd.DataFrame({"row": np.arange(len(total)), "values": list(total), "n": n})

    part = pairs.select(F.col(left).alias("left"), F.col(right).alias("right")).where("left is not null and right is not null").mapInPandas(partial, "row int, values array<double>, n long")
    size = F.size("values")
    cells = part.select("row", "n", F.posexplode("values").alias("column", "value"), size.alias("size")).groupBy("row", "column").agg(F.sum("value").alias("value"), F.sum("n").alias("n"), F.max("size").alias("size"))
    rows = cells.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("column", "value"))), lambda x: x["value"]).alias("values"), F.max("n").alias("n")).orderBy("row").collect()
    return np.array([r["values"] for r in rows], float), (rows[0].n if rows else 0)


def procrustes(covariance: np.ndarray) -> np.ndarray:
    """The orthogonal matrix m for which left @ m is nearest to right, by the pairs that the covariance sums."""
    u, _, v = np.linalg.svd(covariance)
    return u @ v


def learn(vectors: DataFrame, anchors: DataFrame, keys: list[str], source: str = "jp", pivot: str = "cn", least: int = LEAST) -> np.ndarray | None:
    """The mapping from source to pivot vectors (keys, lang, source_index, vector) by anchors of all keys together; None with too few."""
    side = lambda lang, index, name: vectors.where(F.col("lang") == lang).select(*keys, F.col("source_index").alias(index), F.col("vector").alias(name))
    pairs = anchors.join(side(source, "source_index", "left"), [*keys, "source_index"]).join(side(pivot, "pivot_index", "right"), [*keys, "pivot_index"])
    covariance, n = cross_covariance(pairs)
    return procrustes(covariance) if n >= least else None


def turned(matrix: np.ndarray):
    """Column -> Column: vectors through the mapping."""

    @F.pandas_udf("array<float>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_list()) @ matrix).astype(np.float32))) if len(v) else pd.Series([], dtype=object)

    return run


def mapped(encode: Callable[[list[str]], np.ndarray], matrix: np.ndarray | None) -> Callable[[list[str]], np.ndarray]:
    """An encoder whose vectors are of unit length and then go through the mapping."""

    def run(texts: list[str]) -> np.ndarray:
        v = np.asarray(encode(texts), float)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        return (v if matrix is None else v @ matrix).astype(np.float32)

    return run
