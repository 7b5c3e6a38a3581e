"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once; a longer document is a step of its own.
SLICE_BYTES = 4 << 20
#: The white space of every word contract, for Java's, DuckDB's and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_prefix(df: DataFrame, prefix: str) -> str:
    """The prefix, with underscores until no column of `df` starts with it in any case."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where that is unset, a local session
    has a folder of its own; on a cluster there is no folder that all machines are sure to see, and that is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tallyloom-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which the driver removes when it ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def remove(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows without lineage: a Parquet table in the shared folder, from which any executor reads them again."""
    spark = df.sparkSession
    at = scratch(spark, "table")
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows whose text has about `limit` bytes at most (one row may have more), with that column as binary."""
    for batch in batches:
        text = batch.column(column).cast(pa.binary())
        if not len(text):
            continue
        ends = np.frombuffer(text.buffers()[1], dtype=np.int32, count=len(text) + 1 + text.offset)[text.offset :].astype(np.int64)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), text.slice(at, to - at)
            at = to


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of the connected component.

    Large-star and small-star rounds, each a few equality joins and aggregations with map-side combining, cut
    from its lineage by a table in the shared folder, which goes with the round after the next. The number of rounds grows with the logarithm of the longest path. No
    group is gathered: a hub's row count only ever meets a one-row minimum. Null ends are dropped; self-links
    give a node that is its own root.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    nodes_alone = e.where("u = v").select("u", "v")
    spark, kept, before = edges.sparkSession, [], None

    def put(df: DataFrame) -> DataFrame:
        kept.append(scratch(spark, "edges"))
        df.write.parquet(kept[-1])
        if len(kept) > 1:  # the round that was read is not read again
            remove(spark, kept[-2])
        return spark.read.schema(df.schema).parquet(kept[-1])

    e = put(e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # large-star: what is above u links to the least neighbour of u
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small-star: what is below u, and u itself, links to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = put(small.where("u != v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return stars.union(roots).union(nodes_alone.toDF("node", "root")).groupBy("node").agg(F.min("root").alias("root"))
