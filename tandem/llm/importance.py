r"""Importance resampling toward a target distribution, by hashed n-grams.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text with A-Z lower-cased. Its features are all runs of 1 to n consecutive words, joined by one space,
repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo the number of buckets. All documents and all target texts are counted by bucket, and
a bucket's gain is floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for s of the documents' S features and t of the target's T among B buckets. A document's weight is
the sum of its features' gains. Of the N documents with `least` words or more, floor(percent N / 100) are drawn without replacement: those with the highest sums of
weight and a Gumbel number, which the document's id and the seed alone give.

A batch's texts are joined with sentinels between them and one regular expression pass splits them into words; the words' places among the texts'
offsets tell each one's document, and n-grams whose first and last word differ in it are masked before they are counted by numpy. What meets on the driver are
the counts of the buckets, whose number is a parameter; ranks come from a range partitioning by score.

Null and empty texts have no features, weight 0 and are never drawn while `least` is above 0. Texts longer than BLOCK bytes are split at signs between words, in pieces
that bring the last n - 1 words of the piece before. A null doc_id counts as an empty one in the Gumbel number and stands last among equal scores. Repeated rows count each, and
rows with equal doc_id and score are ordered by a hash of the text. Extra columns pass through, renamed if they clash; empty documents give an empty table, and an empty target counts 0 everywhere.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sql
from .common import Workspace, positions, read, unclash

GRAMS, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of text that are joined, or of one text that are split, at once; a word takes some 200 bytes of memory meanwhile.
BLOCK = 1 << 20
#: In UTF-8 every byte of a character beyond U+007F is 80 or above.
WORDS = re.compile(rb"([0-9a-z\x80-\xff]+)")
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")
ADDED = ["n_features", "weight", "score", "rank"]


def split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of lower-cased texts in order, and the number of each one's text."""
    parts = WORDS.split(b"\0".join(texts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return parts[1::2], np.searchsorted(offsets, ends[0::2][: len(parts) // 2], "right") - 1


def grams(words: list[bytes], text: np.ndarray, n: int, buckets: int, brought: int = 0):
    """(number of the text, bucket) of the features, as arrays for each length; features that end within the first `brought` words do not count."""
    codes, spaced = list(map(crc32, words)), [b" " + w for w in words] if n > 1 else []
    for k in range(1, n + 1):
        if k > 1:
            codes = list(map(crc32, spaced[k - 1 :], codes))
        some = text[k - 1 :] == text[: len(text) - k + 1]
        some[: max(0, brought - k + 1)] = False
        yield text[k - 1 :][some], np.fromiter(codes, np.int64, len(codes))[some] % buckets


def features(texts: list[str | None], n: int, buckets: int):
    """(first text, number of texts, numbers of the texts from the first on, buckets, number of words by text) over blocks of texts and pieces of long texts."""
    raw, lo = [(t or "").encode().lower() for t in texts], 0
    while lo < len(raw):
        if len(raw[lo]) > BLOCK:
            words: list[bytes] = []
            at = 0
            while at < len(raw[lo]):
                cut = BETWEEN.search(raw[lo], at + BLOCK)
                end = cut.end() if cut else len(raw[lo])
                before = words[max(0, len(words) - n + 1) :] if n > 1 else []
                words = [*before, *WORDS.findall(raw[lo], at, end)]
                for text, bucket in grams(words, np.zeros(len(words), np.int64), n, buckets, len(before)):
                    yield lo, 1, text, bucket, None
                yield lo, 1, np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([len(words) - len(before)])
                at = end
            lo += 1
            continue
        hi, size = lo, 0
        while hi < len(raw) and len(raw[hi]) <= BLOCK and (hi == lo or size + len(raw[hi]) <= BLOCK):
            size += len(raw[hi])
            hi += 1
        words, of = split(raw[lo:hi])
        for text, bucket in grams(words, of, n, buckets):
            yield lo, hi - lo, text, bucket, None
        yield lo, hi - lo, np.zeros(0, np.int64), np.zeros(0, np.int64), np.bincount(of, minlength=hi - lo)
        lo = hi


def bucket_counts(texts: DataFrame, n: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (column text) are in each bucket: partitions count, Spark sums."""

    def count(batches):
        out = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, bucket, _ in features(batch.column(0).to_pylist(), n, buckets):
                out += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(out[some], pa.int64())})

    found = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r.bucket] = r.n
    return found


def bucket_gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    b, total, wanted = float(len(documents)), float(documents.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (total + b) / ((s + 1.0) * (wanted + b)))) for s, t in zip(documents.tolist(), target.tolist())], np.int64)


def weigh(documents: DataFrame, gains: np.ndarray, n: int = GRAMS, columns: list[str] | None = None) -> DataFrame:
    """The given columns of documents (all, if None) with n_words, n_features and weight."""
    columns = documents.columns if columns is None else columns
    shared = documents.sparkSession.sparkContext.broadcast(gains)
    rows = documents.select(*columns, F.col("text").alias("_words_of"))
    schema = T.StructType([*documents.select(*columns).schema.fields, *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def run(batches):
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            gain = shared.value
            for lo, size, text, bucket, n_words in features(batch.column(batch.num_columns - 1).to_pylist(), n, len(gain)):
                out[1, lo : lo + size] += np.bincount(text, minlength=size)
                out[2, lo : lo + size] += np.bincount(text, gain[bucket], size).astype(np.int64)  # whole numbers, exact below 2 ** 53
                if n_words is not None:
                    out[0, lo : lo + size] += n_words
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out)], names=schema.names)

    return rows.mapInArrow(run, schema)


def draw(documents: DataFrame, target: DataFrame, n: int = GRAMS, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED, columns: list[str] | None = None) -> DataFrame:
    """The given columns of documents (all, if None) with n_features, weight, score and rank, from 1 among the drawn, null for the others. Both tables bring a column text."""
    documents = unclash(documents, [*ADDED, "n_words", "_minus", "_no_id", "_tie", "_words_of", "_id", "_part", "_place", "_g"])
    columns = documents.columns if columns is None else columns
    gains = bucket_gains(bucket_counts(documents, n, buckets), bucket_counts(target, n, buckets))
    ws = Workspace(documents.sparkSession, "draw")
    ties = documents.withColumn("_tie", F.xxhash64("text"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))
    weighed = weigh(ties, gains, n, list(dict.fromkeys([*columns, "doc_id", "_tie"]))).withColumn("score", F.col("weight") + gumbel)
    weighed = ws.keep(weighed.withColumn("_minus", -F.col("score")).withColumn("_no_id", F.col("doc_id").isNull()))
    able = weighed.where(F.col("n_words") >= least)
    top = percent * able.count() // 100
    ranked, _ = positions(able, [], ["_minus", "_no_id", "doc_id", "_tie"], ws)
    rank = F.when(F.col("pos") < top, F.col("pos") + 1)
    out = [*columns, "n_features", "weight", "score"]
    return ranked.select(*out, rank.alias("rank")).unionByName(weighed.where(F.col("n_words") < least).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_importance_draw(spark, sf_dir):
    return draw(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), columns=["doc_id"])


SQL = rf"""
with recursive {sql.CRC_TABLE},
w as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from documents),
v as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
code as materialized (select word, {sql.crc32("word")} % 10000 as bucket from (select word from w union select word from v), crc_table),
s as (select bucket, count(*) as n from w join code using (word) group by bucket),
t as (select bucket, count(*) as n from v join code using (word) group by bucket),
total as (select (select coalesce(sum(n), 0) from s)::double as s, (select coalesce(sum(n), 0) from t)::double as t),
gain as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (total.s + 10000) / ((coalesce(s.n, 0) + 1)::double * (total.t + 10000))))::bigint as gain from s full join t using (bucket), total),
f as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from w join code using (word) join gain using (bucket) group by doc_id),
d as (select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h from documents left join f using (doc_id)),
z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from d),
r as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) filter (where n_features >= 20) over () as n from z)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from r
"""
