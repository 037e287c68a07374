"""Neighbouring rows as context, ring by ring under a budget, and rules over the last rows of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ROUNDS, ROWS, CHARS = 6, 12, 6000
LAST, LEAST, RATE = 20, 10, 0.5


def context(rows: DataFrame, keys: list[str], source: str = "source", target: str = "target", counterpart: str = "counterpart", order: str = "index", rounds: int = ROUNDS, most_rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """rows with context: items (round, index, relative, source, target, counterpart) in order of index.

    In each round the row before comes first, then the row after. An item that would pass the character budget ends its round,
    unless it is the round's first, which always enters; `round` is the number of the round in which it came.
    """
    size = T.utf16_length(source) + T.utf16_length(target) + T.utf16_length(counterpart)
    item = F.struct(F.col(order).alias("index"), T.text_of(source).alias("source"), T.text_of(target).alias("target"), T.text_of(counterpart).alias("counterpart"), size.cast("long").alias("size"))
    w = Window.partitionBy(*keys).orderBy(order)
    near = rows.withColumns({"_before": F.reverse(F.collect_list(item).over(w.rowsBetween(-rounds, -1))), "_after": F.collect_list(item).over(w.rowsBetween(1, rounds))})

    def candidate(i):
        r = F.floor(i / 2).cast("int")
        sign = F.when(i % 2 == 0, -1).otherwise(1)
        x = F.when(i % 2 == 0, F.get(F.col("_before"), r)).otherwise(F.get(F.col("_after"), r))
        return F.struct((r + 1).alias("round"), (sign * (r + 1)).alias("relative"), x.alias("x"))

    every = F.filter(F.transform(F.sequence(F.lit(0), F.lit(2 * rounds - 1)), candidate), lambda c: c["x"].isNotNull())
    empty = F.expr("cast(array() as array<struct<round:int,relative:int,x:struct<index:bigint,source:string,target:string,counterpart:string,size:bigint>>>)")
    start = F.struct(empty.alias("items"), F.lit(0).cast("long").alias("chars"), F.lit(0).alias("round"), F.lit(0).alias("added"), F.lit(False).alias("ended"))

    def step(s, c):
        fresh = c["round"] != s["round"]
        added, ended = F.when(fresh, 0).otherwise(s["added"]), F.when(fresh, False).otherwise(s["ended"])
        total = s["chars"] + c["x"]["size"]
        full = F.size(s["items"]) >= most_rows
        over = (total > chars) & (added > 0)
        take = ~ended & ~full & ~over
        return F.struct(
            F.when(take, F.concat(s["items"], F.array(c))).otherwise(s["items"]).alias("items"), F.when(take, total).otherwise(s["chars"]).alias("chars"), c["round"].alias("round"),
            F.when(take, added + 1).otherwise(added).alias("added"), (ended | full | over).alias("ended"),
        )

    typed = F.transform(every, lambda c: F.struct(c["round"].alias("round"), c["relative"].alias("relative"), F.struct(c["x"]["index"].cast("long").alias("index"), c["x"]["source"].alias("source"), c["x"]["target"].alias("target"), c["x"]["counterpart"].alias("counterpart"), c["x"]["size"].alias("size")).alias("x")))
    near = near.withColumn("_items", F.aggregate(typed, start, step, lambda s: s["items"]))
    flat = F.transform("_items", lambda c: F.struct(c["x"]["index"].alias("index"), c["round"].alias("round"), c["relative"].alias("relative"), c["x"]["source"].alias("source"), c["x"]["target"].alias("target"), c["x"]["counterpart"].alias("counterpart")))
    return near.withColumn("context", F.sort_array(flat)).drop("_before", "_after", "_items")


def rolling_rate(rows: DataFrame, failed: Column, keys: list[str], order: list[str], last: int = LAST, least: int = LEAST, rate: float = RATE) -> DataFrame:
    """rows with seen, failures and error_rate of the last so many, and tripped where a breaker would open."""
    w = Window.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(1 - last, 0)
    hit = F.coalesce(failed, F.lit(False)).cast("int")
    out = rows.withColumns({"seen": F.row_number().over(w), "failures": F.sum(hit).over(frame), "error_rate": F.avg(hit).over(frame)})
    return out.withColumn("tripped", (F.col("seen") >= least) & (F.col("error_rate") >= rate))


def trip_point(rows: DataFrame, failed: Column, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key at which the breaker opens."""
    return rolling_rate(rows, failed, keys, order).where("tripped").groupBy(*keys).agg(F.min("seen").alias("trip_at"))


def newest(rows: DataFrame, keys: list[str], order: list, keep: int) -> DataFrame:
    """The first so many rows of each key by the order, as logs, requests and snapshots are kept."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")
