"""Quality filters of samples and markers, and the pipeline that prepares an analysis.

Frames have set_id, sample_id and marker_id; samples without any allele are in none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alleles import absolute, by_type, dominant, thresholds
from .sets import differentiate


#: Markers in one number of a presence mask.
WORD = 62


def marker_ids(alleles: DataFrame) -> list[int]:
    """The markers of a table, sorted: a row a marker is gathered."""
    return sorted(r[0] for r in alleles.select("marker_id").filter("marker_id IS NOT NULL").distinct().collect())


def _words(markers: list[int]) -> list[Column]:
    """For each WORD of the markers the bit of a row's marker in it."""
    place = F.array_position(F.array(*[F.lit(m).cast("bigint") for m in markers]), F.col("marker_id").cast("bigint")) - 1 if markers else F.lit(-1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(WORD)).cast("int"))
    return [F.when((place >= j * WORD) & (place < (j + 1) * WORD), bit).otherwise(F.lit(0).cast("bigint")) for j in range(max(1, -(-len(markers) // WORD)))]


def presence(alleles: DataFrame, markers: list[int], keys=("set_id", "sample_id")) -> DataFrame:
    """keys, mask: which of the markers a sample has, a bit for each, WORD bits a number. One shuffle, of a row a sample."""
    return alleles.groupBy(*keys).agg(F.array(*[F.bit_or(w) for w in _words(markers)]).alias("mask"))


def mask_size(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))


def mask_bit(mask: Column, i: int) -> Column:
    """1 if the i-th marker is in a mask, else 0."""
    return F.shiftright(F.get(mask, F.lit(i // WORD)), i % WORD).bitwiseAND(F.lit(1).cast("bigint"))


def sample_quality(alleles: DataFrame, threshold: float) -> DataFrame:
    """set_id, sample_id, failed, passed: markers of all sets that a sample lacks; it may lack (1 - threshold) of them."""
    markers = marker_ids(alleles)
    n = len(markers)
    failed = (n - mask_size(F.col("mask"))).alias("failed")
    return presence(alleles, markers).select("set_id", "sample_id", failed).withColumn("passed", F.col("failed") <= n - threshold * n)


def marker_quality(alleles: DataFrame, threshold: float, denominator: str = "present") -> DataFrame:
    """marker_id, failed, prop_failed_pct, passed: samples that lack a marker, against those that have it (or `total`)."""
    markers = marker_ids(alleles)
    masks = presence(alleles, markers, ("sample_id",))
    counts = masks.agg(F.count("*").alias("n"), F.array(*[F.sum(mask_bit(F.col("mask"), i)) for i in range(len(markers))]).cast("array<bigint>").alias("c"))
    counted = counts.select("n", F.posexplode("c").alias("i", "present")).withColumn("marker_id", F.get(F.array(*map(F.lit, markers)).cast("array<bigint>"), F.col("i")))
    prop = F.try_divide((F.col("n") - F.col("present")).cast("double"), F.col("present" if denominator == "present" else "n"))
    return counted.select("marker_id", (F.col("n") - F.col("present")).alias("failed"), (prop * 100).alias("prop_failed_pct"), (prop <= threshold).alias("passed"))


def moi_per_sample(alleles: DataFrame, keys=("sample_id",)) -> DataFrame:
    """The most alleles at any marker, and the markers with more than one."""
    counted = alleles.groupBy(*keys, "marker_id").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.max("n").alias("moi"), F.count_if(F.col("n") > 1).alias("multi_loci"))


def strict(alleles: DataFrame, keys=("sample_id",)) -> DataFrame:
    """Alleles of samples with at most one marker that has several."""
    single = moi_per_sample(alleles, keys).filter("multi_loci <= 1").select(*keys)
    return alleles.join(single, list(keys), "left_semi")


def unique(alleles: DataFrame, keys=("set_id", "sample_id")) -> DataFrame:
    """Alleles of the samples with unique genotypes: of a set's samples with one genotype that with the smallest id.

    A genotype is the mean of the dominant alleles of every marker; a missing marker is a value of its own.
    """
    top = dominant(alleles, (*keys, "marker_id")).groupBy(*keys, "marker_id").agg(F.avg("value").alias("v"))
    per = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("marker_id", "v"))).alias("genotype"))
    sets = [k for k in keys if k != "sample_id"]
    first = per.groupBy(*sets, "genotype").agg(F.min("sample_id").alias("sample_id")).select(*keys)
    return alleles.join(first, list(keys), "left_semi")


def sample_quality_report(alleles: DataFrame, threshold: float) -> DataFrame:
    """Per set: samples, the markers that they lack (mean, median, least, most), failed samples and their share in %."""
    judged = sample_quality(alleles, threshold)
    failed = F.count_if(~F.col("passed"))
    return judged.groupBy("set_id").agg(
        F.count("*").alias("samples"), F.avg("failed").alias("mean"), F.percentile("failed", 0.5).alias("median"), F.min("failed").alias("min"), F.max("failed").alias("max"),
        failed.alias("failed_samples"), F.bround(100.0 * failed / F.count("*")).cast("int").alias("failed_pct"),
    )


def sample_failures(alleles: DataFrame, threshold: float) -> DataFrame:
    """`sample_quality_report` with a last row over all sets (set_id null), and passed_samples: both from one pass."""
    judged = sample_quality(alleles, threshold)
    failed = F.count_if(~F.col("passed"))
    return judged.rollup("set_id").agg(
        F.count("*").alias("samples"), F.avg("failed").alias("mean"), F.percentile("failed", 0.5).alias("median"), F.min("failed").alias("min"), F.max("failed").alias("max"),
        failed.alias("failed_samples"), F.bround(100.0 * failed / F.count("*")).cast("int").alias("failed_pct"), F.count_if(F.col("passed")).alias("passed_samples"),
    )


def marker_failures(alleles: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """code, failed, failed_pct (whole percents of all samples, cut), included (Yes or No) of each marker by its code.

    codes: marker_id, code. A marker passes by the samples that have it, as in the filter; shares are of all samples.
    """
    judged = marker_quality(alleles, threshold).select("marker_id", "passed")
    shown = marker_quality(alleles, threshold, "total").join(F.broadcast(judged.withColumnRenamed("passed", "kept")), "marker_id")  # a row a marker
    return shown.join(F.broadcast(codes), "marker_id").select("code", "failed", F.floor("prop_failed_pct").cast("int").alias("failed_pct"), F.when(F.col("kept"), "Yes").otherwise("No").alias("included"))


def failed_markers(alleles: DataFrame) -> DataFrame:
    """set_id, sample_id, failed: the markers, of those that any set has, that a sample lacks."""
    markers = marker_ids(alleles)
    every = F.array(*map(F.lit, markers)).cast("array<bigint>")
    lacking = [F.when(mask_bit(F.col("mask"), i) == 0, F.lit(i)) for i in range(len(markers))]
    failed = F.transform(F.array_compact(F.array(*lacking).cast("array<int>")), lambda i: F.get(every, i))
    return presence(alleles, markers).select("set_id", "sample_id", failed.alias("failed"))


def passing_markers(masks: DataFrame, markers: list[int], sample_threshold: float, marker_threshold: float) -> tuple[int, list[int]]:
    """(markers that any sample has, markers that pass): of the samples with few enough missing markers, at most
    `marker_threshold` times as many lack a passing marker as have it.

    masks: a row a sample. Samples with equally many markers pass or fail together, so their counts decide: a row for
    each number of markers is gathered.
    """
    sums = F.array(*[F.sum(mask_bit(F.col("mask"), i)) for i in range(len(markers))]).cast("array<bigint>")
    found = masks.groupBy(mask_size(F.col("mask")).alias("size")).agg(F.count("*").alias("n"), sums.alias("c")).collect()
    n = sum(any(r["c"][i] for r in found) for i in range(len(markers)))
    kept = [r for r in found if n - r["size"] <= n - sample_threshold * n]
    total, present = sum(r["n"] for r in kept), [sum(r["c"][i] for r in kept) for i in range(len(markers))]
    return n, [m for m, c in zip(markers, present) if c and (total - c) / c <= marker_threshold]


def prepare(alleles: DataFrame, members: DataFrame, samples: DataFrame, params) -> tuple[DataFrame, DataFrame]:
    """(prepared alleles with set_id, sets) for `AnalysisParams`: differentiation, thresholds, sample and marker quality.

    Thresholds work within marker and sample, so removing samples or markers later equals extracting alleles anew. One
    shuffle by sample serves the thresholds, the masks of the markers that a sample has, and the sets. Which markers pass
    follows from counts of masks, which are gathered first.
    """
    sets = differentiate(members, samples, params.spatial, params.temporal, params.detection)
    facts = thresholds(alleles.repartition("sample_id"), params)
    markers = sorted(set(params.marker_ids)) or marker_ids(absolute(by_type(alleles, params.peak_types), params.abs_threshold))
    masks = presence(facts.join(sets.select("sample_id").distinct(), "sample_id", "left_semi"), markers, ("sample_id",))
    n, good = passing_markers(masks, markers, params.sample_qual_threshold, params.marker_qual_threshold)
    own = Window.partitionBy("sample_id")
    size = sum((F.bit_count(F.bit_or(w).over(own)) for w in _words(markers)), F.lit(0))
    facts = facts.withColumn("_lacks", n - size).filter(F.col("_lacks") <= n - params.sample_qual_threshold * n).drop("_lacks")
    facts = facts.filter(F.col("marker_id").isin(*good)).join(sets.select("set_id", "sample_id"), "sample_id")
    if params.sample_option == "S":
        facts = strict(facts, ("set_id", "sample_id"))
    elif params.sample_option == "U":
        facts = unique(facts)
    return facts, sets
