"""Session settings that results depend on, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def guard(spark: SparkSession) -> None:
    """Spark 4.1 may take a union of equally partitioned parts as partitioned
    by a column that it is not, and leave out an exchange that grouping needs;
    unions are planned without that shortcut.  The setting stays, as results
    are planned lazily, after this call has returned."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only on one machine, where
    the session names none, is a temporary one made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="treeloom-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: what
    it took to make it runs one time, whatever reads it, and lost executors
    cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all tasks where a plain scan gives few partitions (a
    small file is one task, however long Python works on it); larger scans,
    plans with exchanges and streams stay as they lie."""
    if df.isStreaming:
        return df
    plan, tasks = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext.defaultParallelism
    if plan.nodeName() == "AdaptiveSparkPlan" or plan.execute().getNumPartitions() >= 2 * tasks:
        return df
    return df.repartition(tasks)
