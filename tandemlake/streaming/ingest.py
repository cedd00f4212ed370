"""Incremental ingest: new allele tables that appear in a folder are added to a fact table, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import tabular


def stream_alleles(spark: SparkSession, folder: str, columns: list[str], sep: str = ",") -> DataFrame:
    """Alleles of the wide tables of a folder, as they arrive; all have the same columns."""
    tabular.check_headers(columns)
    schema = ", ".join(f"`{c}` string" for c in columns)
    return tabular.alleles(spark.readStream.schema(schema).option("header", "true").option("sep", sep).csv(folder))


def ingest(alleles: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is there by now and stop; the checkpoint folder remembers what was taken."""
    return alleles.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def arrivals(events: DataFrame, time: str, window: str, delay: str) -> DataFrame:
    """Events in each time window; rows later than the delay are left out, so state stays bounded."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window)).agg(F.count("*").alias("n")).select("window.start", "window.end", "n")
