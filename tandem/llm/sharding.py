"""Sharding by histogram sort.

Documents are ordered by a key of three 63-bit numbers: a hash of the text, so that equal texts stand together, a hash of
doc_id, and a hash of the row's number in a written table, which tells repeated rows apart. Round by round, every partition counts exactly the rows and bytes below candidate boundaries; the candidates
close in on each wanted byte total until a boundary is within the tolerance or falls between two neighbouring keys. A
boundary stays between texts where that is within the tolerance; only inside a group of equal texts too large for that it
goes on with the second number, and inside a group of equal rows with the third, so a group of any size is cut. Then the rows are exchanged once, by part.

A shard is a row of consecutive parts, so no task holds a shard: parts have 64 MB each up to 65,536 parts (4 TB); beyond they grow, to 1.6 GB at
100 TB, and a part is sorted in one task, which may spill. The counts below the boundaries give each part's first slot, so slots need no pass of their own.

Null texts have no bytes: size 1, crc32 0, the hash of the empty text. Null doc_ids get one hash. Extra columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, read, unclash

SHARDS, TOLERANCE, PROBES, PART_BYTES = 8, 0.002, 32, 64 << 20
#: Parts in all, and candidates that one round counts, at most; the first round spreads them over all keys, as hashes are spread.
MAX_PARTS, MAX_KEYS = 1 << 16, 1 << 18
TOP = 1 << 63


@dataclass
class Boundary:
    """The search for one boundary: the wanted bytes below it, and the nearest keys known on either side with (bytes, rows) below."""

    want: int
    low: tuple[int, int, int] = (0, 0, 0)
    high: tuple[int, int, int] = (TOP, 0, 0)
    below_low: tuple[int, int] = (0, 0)
    below_high: tuple[int, int] = (0, 0)
    done: tuple | None = field(default=None)  # key, bytes, rows
    numbers: int = 3  # of a key that tell rows apart
    tied: bool = False  # ended among rows that these do not tell apart

    def probes(self, n: int) -> list[tuple[int, int, int]]:
        """Some n keys between the two, in the first of the numbers that still leaves room."""
        for k in range(self.numbers):
            at, top = self.low[k], self.high[k] if self.low[:k] == self.high[:k] else TOP - 1
            steps = {at + max(1, (top - at) * i // (n + 1)) for i in range(1, n + 1)}
            found = [key for x in sorted(steps) if x <= top and self.low < (key := (*self.low[:k], x, *(0,) * (2 - k))) < self.high]
            if found:
                return found
        return []

    def learn(self, key: tuple[int, int, int], below: tuple[int, int]) -> None:
        if below[0] <= self.want and key >= self.low:
            self.low, self.below_low = key, below
        if below[0] >= self.want and key <= self.high:
            self.high, self.below_high = key, below

    def settle(self, slack: float) -> None:
        under, over = self.want - self.below_low[0], self.below_high[0] - self.want
        near = min(under, over) <= slack or self.below_high[1] - self.below_low[1] <= 1
        if near or not self.probes(1):
            self.tied = not near
            self.done = (self.low, *self.below_low) if under <= over else (self.high, *self.below_high)


def keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.withColumns({
        "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1,
        "text_crc32": F.crc32(F.encode(text, "UTF-8")).cast("long"),
        "k1": F.xxhash64(text).bitwiseAND(TOP - 1),
        "k2": F.xxhash64(F.lit("id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).bitwiseAND(TOP - 1),
    })


def bucket_of(keys: list[tuple[int, ...]]):
    """For arrays of the numbers of rows' keys: how many of the sorted keys are at or below each row's."""
    firsts = np.array([k[0] for k in keys], np.int64)

    def find(first: np.ndarray, *others: np.ndarray) -> np.ndarray:
        if not others or not len(firsts):
            return np.searchsorted(firsts, first, "right")
        out = np.searchsorted(firsts, first, "left")
        tied = np.flatnonzero(firsts[np.minimum(out, len(firsts) - 1)] == first)
        for a in np.unique(first[tied]):  # rows that share their first number with keys are decided by the others
            mine, lo, hi = tied[first[tied] == a], *np.searchsorted(firsts, [a, a + 1])
            out[mine] = lo + bucket_of([k[1:] for k in keys[lo:hi]])(*(x[mine] for x in others))
        return out

    return find


def histogram(slim: DataFrame, keys: list[tuple[int, int, int]]) -> np.ndarray:
    """Exact (bytes, rows) below each key: partitions count, Spark sums."""

    def count(batches):
        find, out = bucket_of(keys), np.zeros((len(keys) + 1, 2), np.int64)
        for b in batches:
            at = find(b.k1.to_numpy(), b.k2.to_numpy(), b.k3.to_numpy())
            out[:, 0] += np.bincount(at, b["size"].to_numpy(), len(keys) + 1).astype(np.int64)
            out[:, 1] += np.bincount(at, minlength=len(keys) + 1)
        some = np.flatnonzero(out[:, 1])
        yield pd.DataFrame({"bucket": some, "bytes": out[some, 0], "n": out[some, 1]})

    rows = slim.select("k1", "k2", "k3", "size").mapInPandas(count, "bucket long, bytes long, n long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    table = np.zeros((len(keys) + 1, 2), np.int64)
    for r in rows:
        table[r.bucket] = r.bytes, r.n
    return np.cumsum(table, axis=0)


def splitters(slim: DataFrame, shards: int, parts: int, tolerance: float, numbers: int = 3) -> tuple[list[tuple], bool]:
    """(key, bytes below, rows below) of the boundaries between shards * parts parts, of which every parts-th is a shard's; whether one missed its total as rows have equal numbers."""
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n = shards * parts
    found = [Boundary(total * i // n, below_high=(total, rows), numbers=numbers) for i in range(1, n)]
    slack = [tolerance * total / shards if i % parts == 0 else 0.1 * total / n for i in range(1, n)]
    for b, s in zip(found, slack):
        b.settle(s)
    if any(b.done is None for b in found):
        spread = min(MAX_KEYS, 8 * n + 64)
        keys = [(TOP * i // spread, 0, 0) for i in range(1, spread)]
        below = histogram(slim, keys)
        totals = below[:-1, 0]
        for b, s in zip(found, slack):
            at = int(np.searchsorted(totals, b.want, "left"))  # the last key below and the first at or above what is wanted
            for i in {max(0, at - 1), min(at, len(keys) - 1)}:
                b.learn(keys[i], tuple(below[i].tolist()))
            b.settle(s)
    while open_ := [(b, s) for b, s in zip(found, slack) if b.done is None]:
        each = max(1, min(PROBES, MAX_KEYS // len(open_)))
        keys = sorted({p for b, _ in open_ for p in b.probes(each)})
        below = histogram(slim, keys)
        for b, s in open_:
            lo, hi = bisect_left(keys, b.low), bisect_right(keys, b.high)
            for i in range(lo, hi):
                b.learn(keys[i], tuple(below[i].tolist()))
            b.settle(s)
    out = []
    for b in found:  # boundaries may fall together, never back
        out.append(max(b.done, out[-1]) if out else b.done)
    return out, any(b.tied for b in found)


def shard(documents: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES, columns: list[str] | None = None) -> DataFrame:
    """documents (or the given columns) with size, text_crc32, shard and slot; the exchange is by part."""
    documents = unclash(documents, ["size", "text_crc32", "k1", "k2", "k3", "part", "start", "_p", "shard", "slot"])
    columns = documents.columns if columns is None else columns
    ws = Workspace(documents.sparkSession, "shard")
    rows = keyed(documents).withColumn("k3", F.lit(0).cast("long")).select(*columns, "size", "text_crc32", "k1", "k2", "k3")
    numbered = lambda df: df.withColumn("k3", F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(TOP - 1))
    wide = "text" in columns
    slim = ws.keep(rows.select("k1", "k2", "k3", "size") if wide else numbered(rows))
    total = slim.agg(F.sum("size")).first()[0] or 0
    parts = max(1, min(MAX_PARTS // shards, -(-total // (shards * part_bytes))))
    cuts, tied = splitters(slim, shards, parts, tolerance, 2 if wide else 3)
    if tied:
        # what tells equal rows apart has to be the same whenever they are read, so only then are whole rows written
        slim = rows = ws.keep(numbered(rows))
        cuts, _ = splitters(slim, shards, parts, tolerance)
    elif not wide:
        rows = slim
    find = bucket_of([c[0] for c in cuts])
    below = [0, *[c[2] for c in cuts]]
    first = np.array([below[p] - below[p // parts * parts] for p in range(shards * parts)], np.int64)

    @F.pandas_udf("part int, start long")
    def part_of(k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.DataFrame:
        part = find(k1.to_numpy(), k2.to_numpy(), k3.to_numpy())
        return pd.DataFrame({"part": part.astype(np.int32), "start": first[part]})

    dealt = rows.withColumn("_p", part_of("k1", "k2", "k3")).select("*", F.col("_p.part").alias("part"), F.col("_p.start").alias("start")).repartition(shards * parts, "part")
    at = F.row_number().over(Window.partitionBy("part").orderBy("k1", "k2", "k3")) - 1
    return dealt.select(*columns, "size", "text_crc32", (F.col("part") / parts).cast("int").alias("shard"), (at + F.col("start")).cast("long").alias("slot"))


def op8_histogram_shards(spark, sf_dir):
    """Law `bytes`: sizes near equal."""
    out = shard(read(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
