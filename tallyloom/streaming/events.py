"""Event streams: windows with late data, and state that a run leaves for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """The column as a timestamp: a watermark can't stand on one without a time zone."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts by window and kind; events later than `late` behind the newest are left out of a stream."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    return with_event_time(events).withWatermark("ts", late).groupBy(at.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return with_event_time(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return with_event_time(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def incremental(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch to `merge` once there is something new, then stops. A batch that is handed over again after a
    crash has the same number, by which `merge` knows that it has it."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exactly_once(stream: DataFrame, store, name: str, make: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Commits what `make` makes of each batch and what the store holds (path, content) to a store with a ledger. The
    batch's number is committed with the documents: a batch that is handed over again changes nothing, whatever a crash
    left undone, and of two writers one is refused."""

    def merge(batch: DataFrame, number: int) -> None:
        if store.last_batch(name) < number:
            live = store.read()
            store.commit(make(batch, live), live.select("path", "hash"), batch=(name, number))

    return incremental(stream, merge, checkpoint)
