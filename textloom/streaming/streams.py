"""Streams: file sources, event-time aggregates, streaming preparation and inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def tumbling(events: DataFrame, ts: str, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums per event-time window and type; the same code in batch and streaming."""
    work = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = work.groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("w_start"), "event_type", "n")


def sliding(events: DataFrame, ts: str, width: str, slide: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts per ``keys`` in windows of ``width`` that begin every ``slide``; an event is in width / slide of them.

    On a stream with ``late`` a window is given out once (append mode), when the watermark has passed its end; later events for it are dropped.
    """
    work = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = work.groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Counts per session of a key: events less than ``gap`` apart.  On a stream a late event within the watermark extends or joins sessions."""
    work = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = work.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("s_start"), F.col("session_window.end").alias("s_end"), "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """One event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


class _Share(StatefulProcessor):
    """Marks rows of a key as dev so that of the first n rows floor(n * share) are; the state is n."""

    def __init__(self, share: Fraction, label: str, columns: list[str]) -> None:
        self.share, self.label, self.columns = share, label, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: object, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = self.seen.get()
        n = int(found[0]) if found is not None else 0
        for part in rows:
            up_to = (np.arange(n, n + len(part) + 1, dtype=object) * self.share.numerator) // self.share.denominator
            dev = (up_to[1:] > up_to[:-1]).astype(bool)
            n += len(part)
            part = part if self.label in part else part.assign(**{self.label: key[0]})
            yield part[self.columns].assign(split=np.where(dev, "dev", "train"))
        self.seen.update((n,))

    def close(self) -> None:
        pass


def split_stream(rows: DataFrame, label: str, share: str | float, key: str | None = None, lanes: int = 1) -> DataFrame:
    """A stream's rows with ``split``: of each label's rows so far, floor(share * n) are dev, whatever the micro-batches.

    The number of rows of each label is state, so the shares hold across batches and restarts.  Labels that one task could not take are dealt to
    ``lanes`` by a hash of ``key``; then each lane holds its share.  Needs the RocksDB state store (:func:`state_store`).
    """
    lane = F.pmod(F.xxhash64(F.col(key)), F.lit(lanes)).cast("int") if lanes > 1 else F.lit(0)
    schema = StructType(list(rows.schema.fields)).add("split", "string")
    dealt = rows.withColumn("__lane", lane).groupBy(label, "__lane")
    return dealt.transformWithStateInPandas(_Share(Fraction(str(share)), label, rows.columns), schema, "Append", "None")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start in this block keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all data that there is and give its result as a table; for tests and backfills.

    The result is written as Parquet next to the checkpoint, so nothing of it is held by the driver.
    """
    spark = stream.sparkSession
    path = f"{checkpoint}/{name}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def prepare(stream: DataFrame, processor: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A processor on a stream; processors are plain DataFrame functions."""
    return processor(stream)


def in_micro_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, least_rows: int = 1) -> None:
    """Operators that need whole micro-batches (sorting, windows); smaller batches than ``least_rows`` are passed over."""

    def each(batch: DataFrame, number: int) -> None:
        if batch.limit(least_rows).count() >= least_rows:
            work(batch).write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
