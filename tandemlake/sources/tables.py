"""The domain's tables, from a catalog of Parquet files or from the stand-in star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, *names: str):
    """Tables of a folder, one for each name; a single name gives the table itself."""
    out = [spark.read.parquet(f"{folder}/{n}.parquet") for n in names]
    return out[0] if len(out) == 1 else out


def alleles(spark: SparkSession, folder: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """Allele facts: line items are alleles, their orders' customers the samples, line numbers the markers."""
    items, orders = read(spark, folder, "lineitem", "orders")
    if types:
        items = items.filter(F.col("l_returnflag").isin(*types))
    return items.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("sample_id"), F.col("l_linenumber").cast("bigint").alias("marker_id"),
        F.col("l_quantity").cast("int").alias("value"), (F.col("l_quantity") + F.col("l_discount")).alias("size"),
        F.col("l_extendedprice").alias("height"), F.col("l_orderkey").alias("assay_id"), F.col("l_returnflag").alias("peak_type"),
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Sample dimension: customers with region and nation as location and the first order as collection date."""
    customer, nation, region, orders = read(spark, folder, "customer", "nation", "region", "orders")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("collection_date"))
    return (
        customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("sample_id"), F.col("c_name").alias("code"), F.col("c_mktsegment").alias("batch"),
            F.col("r_name").alias("country"), F.col("n_name").alias("level1"), "collection_date",
            (F.col("c_custkey") % 2 == 0).alias("passive_detection"), (F.col("c_acctbal") < 0).alias("recurrent"),
        )
    )


def haplotype_alleles(spark: SparkSession, folder: str) -> DataFrame:
    """Coarse alleles of three markers, so that genotypes are shared."""
    return coarse_alleles(spark, folder).filter("marker_id <= 3")


def coarse_alleles(spark: SparkSession, folder: str) -> DataFrame:
    """Coarse alleles of all markers, so that genotypes are near to each other."""
    return alleles(spark, folder).withColumn("value", F.floor(F.col("value") / 10).cast("int"))


def country_sets(spark: SparkSession, folder: str) -> DataFrame:
    """set_id, sample_id: the samples of each country."""
    return samples(spark, folder).select(F.col("country").alias("set_id"), "sample_id")


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """channel_id, data: one trace per row."""
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("channel_id"), F.col("embedding").cast("array<double>").alias("data"))


def peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Peaks of traces: events of a user by time; size is the place, height the value."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, folder, "events").select(
        F.col("event_id").alias("peak_id"), F.col("user_id").alias("channel_id"), (F.col("user_id") % 50).alias("assay_id"),
        F.row_number().over(order).alias("rtime"), (F.row_number().over(order) * 0.75).alias("size"), F.col("value").alias("height"),
    )
