"""Filters on allele facts (marker_id, sample_id, value, size, height, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = ("marker_id", "sample_id")


def by_type(alleles: DataFrame, types=("peak-bin",)) -> DataFrame:
    return alleles.filter(F.col("peak_type").isin(*types))


def by_marker(alleles: DataFrame, marker_ids=()) -> DataFrame:
    """No markers: no filter."""
    return alleles.filter(F.col("marker_id").isin(*marker_ids)) if marker_ids else alleles


def absolute(alleles: DataFrame, threshold: float) -> DataFrame:
    """Heights strictly above the threshold, if that is above 0."""
    return alleles.filter(F.col("height") > threshold) if threshold > 0 else alleles


def relative(alleles: DataFrame, threshold: float, cutoff: float = 0.0) -> DataFrame:
    """Alleles of at least `threshold` of the highest of their marker and sample.

    With a cutoff, a marker of a sample goes altogether if its second-highest remaining allele has a larger share than
    that. One shuffle by (marker, sample) serves both.
    """
    ratio = F.try_divide(F.col("height"), F.max("height").over(Window.partitionBy(*GROUP)))
    kept = alleles.withColumn("_ratio", ratio).filter(F.col("_ratio") >= threshold)
    if cutoff > 0:
        order = Window.partitionBy(*GROUP).orderBy(F.desc("_ratio"))
        second = F.max(F.when(F.col("_rank") == 2, F.col("_ratio"))).over(Window.partitionBy(*GROUP))
        kept = kept.withColumn("_rank", F.row_number().over(order)).withColumn("_second", second)
        kept = kept.filter(F.coalesce(F.col("_second"), F.lit(0.0)) <= cutoff).drop("_rank", "_second")
    return kept.drop("_ratio")


def thresholds(alleles: DataFrame, params) -> DataFrame:
    """Type, marker, absolute and relative filters of `AnalysisParams`; the first three reach the scan."""
    kept = absolute(by_marker(by_type(alleles, params.peak_types), params.marker_ids), params.abs_threshold)
    return relative(kept, params.rel_threshold, params.rel_cutoff) if params.rel_threshold > 0 or params.rel_cutoff > 0 else kept


def dominant(alleles: DataFrame, keys=GROUP) -> DataFrame:
    """The highest alleles of each marker and sample; ties stay."""
    return alleles.withColumn("_top", F.max("height").over(Window.partitionBy(*keys))).filter("height = _top").drop("_top")


def sample_alleles(alleles: DataFrame) -> DataFrame:
    """sample_id, marker_id, alleles: (height, value) of called and binned peaks, the highest first."""
    return alleles.groupBy("sample_id", "marker_id").agg(F.sort_array(F.collect_list(F.struct("height", "value")), False).alias("alleles"))


def latest(alleles: DataFrame, channel: str = "channel_id", revision: str = "revision_no") -> DataFrame:
    """The newest revision of each channel."""
    newest = Window.partitionBy(channel).orderBy(F.desc(revision))
    return alleles.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def top_alleles(alleles: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each marker, of equal counts the smaller values."""
    counted = alleles.groupBy("marker_id", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("marker_id").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
