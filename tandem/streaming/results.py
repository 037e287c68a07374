"""Result events as an append-only log: revisions, bounded reads, one view of the latest, live merging and a stateful breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.context import LAST, LEAST, RATE

PAGE, MOST = 64, 500


def with_revision(events: DataFrame, run: str, order: list[str], start: int = 0) -> DataFrame:
    """events with revision, counted up in each run from start + 1. Given when a batch is committed, since tasks have no common order."""
    return events.withColumn("revision", F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("long") + start)


def page_after(log: DataFrame, cursor: Column | int, limit: int = PAGE, run: str | None = None, cursor_run: str | None = None) -> DataFrame:
    """The next rows of one run after a cursor, in order; at most `limit`, and 500 in any case. A cursor of another run counts as 0."""
    if run is not None:
        log, cursor = log.where(F.col("run") == run), cursor if cursor_run == run else 0
    return log.where(F.col("revision") > cursor).orderBy("revision").limit(max(1, min(MOST, limit)))


def pages(log: DataFrame, run: str, limit: int = PAGE) -> DataFrame:
    """log with page, the number of the read from 1 in which a reader that starts at 0 gets the row."""
    return log.withColumn("page", F.ceil(F.row_number().over(Window.partitionBy(run).orderBy("revision")) / min(MOST, limit)).cast("long"))


def cursors(log: DataFrame, run: str) -> DataFrame:
    return log.groupBy(run).agg(F.max("revision").alias("cursor"), F.count("*").alias("events"))


def latest(log: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """The last event of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), revision).alias("_r")).select(*keys, "_r.*")


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events applied once for each key (run, index, revision); works on streams."""
    return events.dropDuplicates(keys)


def current(events: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Events whose row still has their signature; works for a stream against a table."""
    return events.join(rows.select(*keys, "signature"), [*keys, "signature"])


def stale(events: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return events.join(rows.select(*keys, "signature"), [*keys, "signature"], "left_anti")


class Breaker(StatefulProcessor):
    """Keeps the last outcomes of a run; opens once, when so many of them failed. Emits seen and error_rate with each event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.outcomes = handle.getListState("outcomes", "failed boolean")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = [r[0] for r in self.outcomes.get()] if self.outcomes.exists() else []
        n = self.seen.get()[0] if self.seen.exists() else 0
        out = []
        for pdf in rows:
            for event, failed in pdf.sort_values("event_id")[["event_id", "failed"]].itertuples(index=False):
                last, n = [*last, bool(failed)][-LAST:], n + 1
                rate = sum(last) / len(last)
                out.append((key[0], event, n, rate, n >= LEAST and rate >= RATE))
        self.outcomes.put([(x,) for x in last])
        self.seen.update((n,))
        yield pd.DataFrame(out, columns=["run", "event_id", "seen", "error_rate", "tripped"])

    def close(self) -> None:
        pass


def watch(events: DataFrame) -> DataFrame:
    """A stream (run, event_id, failed) through the breaker."""
    return events.groupBy("run").transformWithStateInPandas(statefulProcessor=Breaker(), outputStructType="run string, event_id long, seen long, error_rate double, tripped boolean", outputMode="Append", timeMode="None")


def exists(spark: SparkSession, pattern: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place))


def start_log(events: DataFrame, path: str, checkpoint: str, run: str = "run", order: tuple[str, ...] = ("event_id",), **trigger):
    """Appends a stream to a log, with revisions that go on from what the log holds. A batch that is written again after a failure replaces itself, as its number is part of its path.

    Beside each batch stands one row for each run with its last revision, so a batch reads the counts of the batch before and never the log. A new checkpoint
    would number batches from 0 and write over what an existing log holds, so it is refused.
    """
    spark = events.sparkSession
    if exists(spark, f"{path}/batch=*") and not exists(spark, f"{checkpoint}/offsets/*"):
        raise ValueError("the log exists and its checkpoint is another one")
    counter = f"`{run}` {events.schema[run].dataType.simpleString()}, last long"

    def append(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            known = spark.read.schema(counter).parquet(f"{path}/counts/batch={number - 1}") if number else spark.createDataFrame([], counter)
            rows = with_revision(batch, run, list(order)).join(known, run, "left")
            rows = rows.withColumn("revision", F.col("revision") + F.coalesce("last", F.lit(0))).drop("last")
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
            now = spark.read.schema(rows.schema).parquet(f"{path}/batch={number}").groupBy(run).agg(F.max("revision").alias("_now"))
            known.join(now, run, "full_outer").select(run, F.greatest("last", "_now").alias("last")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
