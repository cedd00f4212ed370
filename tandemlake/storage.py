"""Materialising steps in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset a temporary folder serves a session whose executors are
    threads of the driver (tests on one machine); on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder: later steps read the same rows in the same partitions."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def cut_placed(df: DataFrame) -> DataFrame:
    """`cut`, such that later steps know by which columns the rows are partitioned, and don't shuffle them for these
    again. An adaptive plan doesn't tell, so this step's is none."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        # A frame keeps the plan that it was first given; this one is new.
        return cut(df.select("*"))
    finally:
        conf.set(name, before)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that `cut` wrote and that no later step reads, by their paths in the shared folder."""
    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        if not plan.getClass().getSimpleName() == "LogicalRDD":
            continue  # a step upon a written frame owns no files
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of data that nothing refers to any more. It does so when the driver's JVM
    collects garbage, which a job of many short rounds seldom makes it do by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
