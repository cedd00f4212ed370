"""Statistics that are kept up batch by batch, as alleles arrive.

Each batch adds a table of its own counts (sample, marker, value), in a folder named by the batch, which a repeated batch
overwrites: so every allele counts once, also after a restart in the middle of a batch. Now and then the batches are
merged into a base; batches up to the base's number are then out of date and are left out, whether or not they have been
deleted yet. Statistics are sums over the base and the batches since, and cost what distinct counts there are, not what
alleles have come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("sample_id", "marker_id", "value")
COUNT = "sample_id bigint, marker_id bigint, value double, n bigint"


def _folders(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the finished tables `name`=number of a folder, which may be in any store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def add_batch(alleles: DataFrame, folder: str, batch: int) -> None:
    """Write the counts of a batch; the same batch again takes the place of what was written."""
    counts = alleles.groupBy(*[F.col(k).cast(t.split()[1]).alias(k) for k, t in zip(KEYS, COUNT.split(", "))]).agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def keep(alleles: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Take in all that has arrived in a stream of alleles, and stop; start it again for what comes later."""
    work = alleles.select(*KEYS).writeStream.foreachBatch(lambda rows, batch: add_batch(rows, folder, batch))
    return work.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_counts(spark: SparkSession, folder: str) -> DataFrame:
    """sample_id, marker_id, value, n over all batches so far."""
    bases = _folders(spark, folder, "base")
    base = bases[-1] if bases else -1
    tables = [f"{folder}/base={base}"] if bases else []
    tables += [f"{folder}/batch={b}" for b in _folders(spark, folder, "batch") if b > base]
    rows = spark.read.schema(COUNT).parquet(*tables) if tables else spark.createDataFrame([], COUNT)
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def compact(spark: SparkSession, folder: str) -> None:
    """Merge everything into a new base, numbered by the last batch in it, and delete what it replaces."""
    bases, batches = _folders(spark, folder, "base"), _folders(spark, folder, "batch")
    last = max([*bases, *batches], default=-1)
    if last < 0 or last in bases:
        return
    kept_counts(spark, folder).write.mode("overwrite").parquet(f"{folder}/base={last}")
    jvm = spark.sparkContext._jvm
    for name in [*(f"base={b}" for b in bases), *(f"batch={b}" for b in batches if b <= last)]:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept_moi(counts: DataFrame) -> DataFrame:
    """sample_id, moi, multi_loci, as `quality.moi_per_sample` gives them of all alleles."""
    per = counts.groupBy("sample_id", "marker_id").agg(F.sum("n").alias("n"))
    return per.groupBy("sample_id").agg(F.max("n").alias("moi"), F.count_if(F.col("n") > 1).alias("multi_loci"))


def kept_alleles(counts: DataFrame) -> DataFrame:
    """marker_id, value, n, freq: the alleles so far, and their shares of their marker."""
    per = counts.groupBy("marker_id", "value").agg(F.sum("n").alias("n"))
    total = per.groupBy("marker_id").agg(F.sum("n").alias("total"))
    return per.join(total, "marker_id").select("marker_id", "value", "n", (F.col("n") / F.col("total")).alias("freq"))


def kept_distribution(counts: DataFrame) -> DataFrame:
    """marker_id, samples: the samples so far with each marker."""
    return counts.groupBy("marker_id").agg(F.count_distinct("sample_id").alias("samples"))
