"""What each run has to do about a component, told by state that the stream keeps from run to run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

KEY = ["component_key", "root_component"]
ACTIONS = "component_key string, root_component boolean, at timestamp, input_hash string, action string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Component(StatefulProcessor):
    """Keeps a component's last input hash and when it was seen; a timer tells that it was seen no more."""

    def __init__(self, lapse_ms: int):
        self.lapse_ms = lapse_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "input_hash string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["at", "input_hash"])
        was = self.last.get() if self.last.exists() else None
        out, kept = [], was
        for at, now in zip(seen["at"], seen["input_hash"], strict=True):
            ms = at.value // 1_000_000
            if was is not None and ms - was[1] > self.lapse_ms:  # the timer had no chance to tell
                out.append((*key, pd.Timestamp(was[1] + self.lapse_ms, unit="ms"), was[0], "delete"))
                was = None
            out.append((*key, at, now, "create" if was is None else "skip_unchanged" if was[0] == now else "regenerate"))
            was = (now, ms)
        if kept is not None:
            self.handle.deleteTimer(kept[1] + self.lapse_ms)
        self.last.update(was)
        self.handle.registerTimer(was[1] + self.lapse_ms)
        yield pd.DataFrame(out, columns=[*KEY, "at", "input_hash", "action"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            was = self.last.get()
            self.last.clear()
            yield pd.DataFrame([(*key, pd.Timestamp(was[1] + self.lapse_ms, unit="ms"), was[0], "delete")], columns=[*KEY, "at", "input_hash", "action"])

    def close(self) -> None:
        pass


def use_state(spark: SparkSession) -> None:
    """Has the session keep streams' state where this operator needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def component_actions(runs: DataFrame, lapse: str = "2 hours", late: str = "0 seconds") -> DataFrame:
    """component_key, root_component, at, input_hash, action for each row of a stream (component_key, root_component, at,
    input_hash; a row for each component of a run): create, regenerate, or skip_unchanged where the hash is the one from
    before. A component that isn't there for longer than `lapse` is a delete, told when the watermark (`late` behind the
    newest run) has passed; after that it is created anew. Rows older than the watermark are left out."""
    ms = int(pd.Timedelta(lapse).total_seconds() * 1000)
    rows = runs.select(*KEY, F.col("at").cast("timestamp").alias("at"), "input_hash").withWatermark("at", late)
    return rows.groupBy(*KEY).transformWithStateInPandas(statefulProcessor=_Component(ms), outputStructType=ACTIONS, outputMode="Append", timeMode="EventTime")


def component_actions_at_once(runs: DataFrame, lapse: str = "2 hours") -> DataFrame:
    """The same of all runs as one batch, without state. Deletes are told up to the newest run."""
    order = Window.partitionBy(*KEY).orderBy("at", "input_hash")
    wait = F.expr(f"interval {lapse}")
    rows = runs.select(*KEY, F.col("at").cast("timestamp").alias("at"), "input_hash").withColumns({"was": F.lag("input_hash").over(order), "before": F.lag("at").over(order), "after": F.lead("at").over(order)})
    lapsed = F.col("before").isNull() | (F.col("at") > F.col("before") + wait)
    each = rows.select(*KEY, "at", "input_hash", F.when(lapsed, "create").when(F.col("was") == F.col("input_hash"), "skip_unchanged").otherwise("regenerate").alias("action"))
    newest = runs.agg(F.max(F.col("at").cast("timestamp")).alias("newest"))  # one row
    gone = rows.join(F.broadcast(newest)).where(F.coalesce("after", "newest") > F.col("at") + wait)
    return each.unionByName(gone.select(*KEY, (F.col("at") + wait).alias("at"), "input_hash", F.lit("delete").alias("action")))
