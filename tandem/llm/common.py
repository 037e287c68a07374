"""What the operators share: tables in the cluster's shared folder, word splitting and hashing in numpy, distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these six, as SQL regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a temporary one serves a master on this machine alone; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tandem-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        found = _local[0]
    return found.rstrip("/")


_open: list[Workspace] = []


def release() -> None:
    """Deletes the tables of all jobs so far. Results that have not been read yet need them, so it is called when those are written, at last when the program ends."""
    while _open:
        ws = _open.pop()
        with contextlib.suppress(Exception):  # a stopped gateway cannot delete; the folder's owner then has to
            ws.delete(ws.at)


class Workspace:
    """Tables of one job in the shared folder. They cut the lineage and outlive executors; see release()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/tandem-{name}-{uuid.uuid4().hex[:12]}", 0
        _open.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        """df written out and read back."""
        self.n += 1
        df.write.parquet(path := f"{self.at}/{self.n}")
        back = self.spark.read.schema(df.schema).parquet(path)
        back.tandem_path = path
        return back

    def delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.delete(t.tandem_path)


atexit.register(release)


def unclash(df: DataFrame, added) -> DataFrame:
    """df with columns that are named like added ones, in any case, under the first free of <name>_0, <name>_1 and so on."""
    taken, names = {c.lower() for c in (*df.columns, *added)}, {}
    for c in df.columns:
        if c.lower() in {a.lower() for a in added}:
            names[c] = next(n for i in itertools.count() if (n := f"{c}_{i}").lower() not in taken)
            taken.add(names[c].lower())
    return df.withColumnsRenamed(names)


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first of <name>_0, <name>_1 and so on that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in itertools.chain([name], (f"{name}_{i}" for i in itertools.count())) if n.lower() not in taken)


def text_size(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- words and shingles of an Arrow column, by numpy ----

#: Odd multipliers of the polynomial hash and of the places in a shingle.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes of text that are hashed at once; each takes about 40 bytes of memory meanwhile.
BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        step = np.full(max(n, BLOCK + 1), base, np.uint64)
        step[0] = 1
        _powers[base] = np.multiply.accumulate(step)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_blocks(column: pa.Array):
    """(first row, end row, bytes, offsets) over blocks of whole rows of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block of texts, A-Z lower-cased, and the place of each text's first word in them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[LOWER[data]] * powers(BASE, len(data)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers(BASE_INV, len(data))[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int):
    """For each text the sorted distinct hashes (63 bits) of its k-word shingles; of fewer words, one of them all."""
    with np.errstate(over="ignore"):
        weights = powers(BASE ^ 0x5DEECE66, k + 1)[1:]
        for lo, hi, data, offsets in text_blocks(column):
            words, first = word_hashes(data, offsets)
            grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
            for j in range(k):
                grams += words[j : j + len(grams)] * weights[j]
            grams = mix(grams) >> np.uint64(1)
            for i in range(hi - lo):
                a, b = first[i], first[i + 1]
                if b - a >= k:
                    yield np.unique(grams[a : b - k + 1])
                elif b > a:
                    yield mix(np.add.reduce(words[a:b] * weights[: b - a], keepdims=True) + np.uint64(b - a)) >> np.uint64(1)
                else:
                    yield np.zeros(0, np.uint64)


# ---- ranks without gathering a group in one task ----


def positions(rows: DataFrame, group: list[str], order: list[str], ws: Workspace, parts: int | None = None, total: str | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (kept as a table) with `pos`, each row's place from 0 in its group by order, and in the column `total`, if it is named, the number of the group's rows; the table.

    A range partitioning by group and order splits large groups over tasks. The place within a partition and
    the number of a group's rows in the partitions before add up to the place; only these counts, one for each group
    and partition, meet in one window.
    """
    keys = [*group, *order]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    kept = ws.keep(dealt.sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    null_safe = [F.struct(*group).alias("_g")] if group else [F.lit(0).alias("_g")]
    cells = kept.select(part.alias("_part"), place.alias("_place"), *null_safe).groupBy("_g", "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = [F.sum("_n").over(Window.partitionBy("_g")).alias(total)] if total else []
    cells = cells.select("_g", "_part", (before - F.col("_first")).alias("_shift"), *every)
    out = kept.withColumns({"_part": part, "_place": place, "_g": null_safe[0]}).alias("k").join(cells.alias("c"), (F.col("k._part") == F.col("c._part")) & F.col("k._g").eqNullSafe(F.col("c._g")))
    return out.select(*[F.col(f"k.{c}") for c in rows.columns], (F.col("k._place") + F.col("c._shift")).alias("pos"), *([F.col(f"c.{total}")] if total else [])), kept


# ---- joins in which a key may have very many rows ----

#: Rows of a key that is looked up in a broadcast, and such keys at most.
HEAVY, MAX_HEAVY = 256, 500_000


def with_first(rows: DataFrame, table: DataFrame, keys: list[str], size: str, ws: Workspace) -> DataFrame:
    """rows joined with a table that has one row for each key and, in `size`, how many rows have it. Keys of many rows are looked up in a broadcast, so none needs a task of its own."""
    table = ws.keep(table)
    heavy = table.where(F.col(size) > HEAVY)
    n = heavy.limit(MAX_HEAVY + 1).count()
    if not 0 < n <= MAX_HEAVY:
        return rows.join(table.hint("merge"), keys)
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(table.where(F.col(size) <= HEAVY).hint("merge"), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(light)
