"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a local session has a folder of its own; on a cluster
    there is no folder that all machines are sure to see, and that is an error."""
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
    """A new place in the shared folder, removed when the driver ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


#: Bytes of a row group: what a task holds to write one, and, as 4,096 rows are read at once but never across groups, to read
#: it. Rows may be whole requests.
GROUP_BYTES = 16 << 20


def stored(df: DataFrame) -> DataFrame:
    """The same rows without lineage: a Parquet table that any executor reads again, removed when the driver ends."""
    spark = df.sparkSession
    at = scratch(spark, "table")
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(at)
    return spark.read.schema(df.schema).parquet(at)
