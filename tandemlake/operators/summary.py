"""Allele, marker and sample summaries. `keys` are the columns that tell sets apart, possibly none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, cut_placed
from .alleles import dominant
from .quality import moi_per_sample


def heterozygosity(alleles: DataFrame, keys=("marker_id",), adjust: bool = True) -> DataFrame:
    """keys, n, he: n / (n - 1) * (1 - sum of squared frequencies); without the correction for a single allele."""
    counted = alleles.groupBy(*keys, "value").agg(F.count("*").alias("c"))
    total = counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    plain = 1 - F.try_divide(F.col("squares").cast("double"), F.col("n") * F.col("n"))
    he = F.when(F.col("n") > 1, F.try_divide(F.col("n").cast("double"), F.col("n") - 1) * plain).otherwise(plain) if adjust else plain
    return total.select(*keys, "n", he.alias("he"))


def heterozygosity_by_samples(alleles: DataFrame) -> DataFrame:
    """The older form: the correction counts samples, not alleles."""
    counted = alleles.groupBy("marker_id", "value").agg(F.count("*").alias("c"))
    n = alleles.groupBy("marker_id").agg(F.count_distinct("sample_id").alias("samples"))
    total = counted.groupBy("marker_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares")).join(n, "marker_id")
    plain = 1 - F.try_divide(F.col("squares").cast("double"), F.col("n") * F.col("n"))
    return total.select("marker_id", "samples", F.when(F.col("samples") > 1, F.try_divide(F.col("samples").cast("double"), F.col("samples") - 1) * plain).otherwise(plain).alias("he"))


def mean_heterozygosity(alleles: DataFrame, keys=("set_id",)) -> DataFrame:
    """The unweighted mean over markers of the dominant alleles' heterozygosity."""
    per = heterozygosity(dominant(alleles, (*keys, "marker_id", "sample_id")), (*keys, "marker_id"))
    return per.groupBy(*keys).agg(F.avg("he").alias("he"), F.stddev_pop("he").alias("sd"), F.count("*").alias("markers"))


def he_table(alleles: DataFrame, sets: list[str]) -> DataFrame:
    """Markers by sets; null where a set lacks a marker."""
    per = heterozygosity(dominant(alleles, ("set_id", "marker_id", "sample_id")), ("set_id", "marker_id"))
    return per.groupBy("marker_id").pivot("set_id", sets).agg(F.first("he"))


def average_rank(order: str) -> Column:
    """Rank among all rows, tied rows sharing the mean of theirs. Meant for a few rows (a row a set and marker)."""
    return F.rank().over(Window.orderBy(order)) + (F.count("*").over(Window.partitionBy(order)) - 1) / 2.0


def kruskal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """h, df of the Kruskal-Wallis test with tie correction, over a small table such as He by set and marker."""
    ranked = rows.select(group, value).filter(F.col(value).isNotNull()).withColumn("r", average_rank(value)).withColumn("t", F.count("*").over(Window.partitionBy(value)))
    per = ranked.groupBy(group).agg(F.sum("r").alias("s"), F.count("*").alias("c"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    got = per.agg(F.sum(F.col("s") * F.col("s") / F.col("c")).alias("a"), F.sum("c").alias("n"), F.sum("ties").alias("ties"), F.count("*").alias("k"))
    h = 12.0 / (F.col("n") * (F.col("n") + 1)) * F.col("a") - 3.0 * (F.col("n") + 1)
    fix = 1.0 - F.col("ties").cast("double") / (F.col("n") * F.col("n") * F.col("n") - F.col("n"))
    return got.select(F.try_divide(h, fix).alias("h"), (F.col("k") - 1).alias("df"))


def wilcoxon(rows: DataFrame, a: str, b: str) -> DataFrame:
    """w, n of the paired signed-rank test, zero differences left out."""
    d = rows.select((F.col(a) - F.col(b)).alias("d")).filter("d <> 0").withColumn("x", F.abs("d")).withColumn("r", average_rank("x"))
    plus, minus = (F.coalesce(F.sum(F.when(c, F.col("r"))), F.lit(0.0)) for c in (F.col("d") > 0, F.col("d") < 0))
    return d.agg(F.least(plus, minus).alias("w"), F.count("*").alias("n"))


def allele_summary(alleles: DataFrame, keys=()) -> DataFrame:
    """Per marker and value: share, count, height, sizes and whether the next values are more than 1 away (`delta_status`)."""
    per = alleles.groupBy(*keys, "marker_id", "value").agg(
        F.count("*").alias("n"), F.avg("height").alias("mean_height"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
        (F.max("size") - F.min("size")).alias("delta"), F.avg("size").alias("mean_size"), F.count_distinct("sample_id").alias("samples"),
    )
    total = F.sum("n").over(Window.partitionBy(*keys, "marker_id"))
    return delta_status(per.withColumn("freq", F.col("n") / total), (*keys, "marker_id"))


def allele_members(alleles: DataFrame, keys=()) -> DataFrame:
    """Marker, value and sample of every allele of the summary, each once."""
    return alleles.select(*keys, "marker_id", "value", "sample_id").distinct()


def allele_maps(alleles: DataFrame, keys=()) -> DataFrame:
    """Per marker: values with their counts, as a map; a marker has few values."""
    per = alleles.groupBy(*keys, "marker_id", "value").agg(F.count("*").alias("n"))
    return per.groupBy(*keys, "marker_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts"))


def delta_status(values: DataFrame, keys=("marker_id",), fix_last: bool = False) -> DataFrame:
    """ok: both neighbouring values are more than 1 away. The last one only looks back, and passes unless `fix_last`."""
    order = Window.partitionBy(*keys).orderBy("value")
    before, after = F.col("value") - F.lag("value").over(order), F.lead("value").over(order) - F.col("value")
    last = (F.coalesce(before > 1, F.lit(True))) if fix_last else F.lit(True)
    return values.withColumn("ok", F.when(F.lead("value").over(order).isNull(), last).otherwise((F.coalesce(before > 1, F.lit(True))) & (after > 1)))


def _moi_columns() -> list[Column]:
    multi = F.col("moi") > 1
    return [
        F.avg("moi").alias("mean"), F.percentile("moi", 0.5).alias("median"), F.min("moi").alias("min"), F.max("moi").alias("max"),
        F.stddev_pop("moi").alias("sd"), F.avg(multi.cast("double")).alias("prop"), F.count_if(multi).alias("n"),
    ]


def moi_stats(alleles: DataFrame, keys=("set_id",)) -> DataFrame:
    return moi_per_sample(alleles, (*keys, "sample_id")).groupBy(*keys).agg(*_moi_columns())


def moi_histogram(alleles: DataFrame, by: str = "multi_loci") -> DataFrame:
    return moi_per_sample(alleles).groupBy(by).agg(F.count("*").alias("n"))


def polyclonality(alleles: DataFrame, keys=("marker_id",)) -> DataFrame:
    """Samples with more than one allele at a marker."""
    return alleles.groupBy(*keys, "sample_id").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.count_if(F.col("n") > 1).alias("polyclonal"))


def marker_distribution(alleles: DataFrame) -> DataFrame:
    return alleles.groupBy("marker_id").agg(F.count_distinct("sample_id").alias("samples"))


def allele_matrix(alleles: DataFrame, markers: list[int]) -> DataFrame:
    """Alleles of each sample (rows) at each marker (columns m1, m2, ...)."""
    return alleles.groupBy("sample_id").pivot("marker_id", markers).count().select("sample_id", *[F.coalesce(F.col(str(m)), F.lit(0)).alias(f"m{m}") for m in markers])


def marker_summary(alleles: DataFrame) -> DataFrame:
    """Per marker over all sets: distinct values, MoI statistics, dominant heterozygosity, polyclonal samples."""
    per = alleles.groupBy("marker_id", "sample_id").agg(F.count("*").alias("n"))
    moi = per.groupBy("marker_id").agg(F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.min("n").alias("min"), F.max("n").alias("max"), F.stddev_pop("n").alias("sd"), F.count_if(F.col("n") > 1).alias("polyclonal"), F.count("*").alias("samples"))
    unique = alleles.groupBy("marker_id").agg(F.count_distinct("value").alias("unique"))
    he = heterozygosity(dominant(alleles)).select("marker_id", "he")
    return moi.join(unique, "marker_id").join(he, "marker_id")


def cumulative_clonality(alleles: DataFrame, by: str = "he") -> DataFrame:
    """Markers in falling order of He (or polyclonal samples), and the samples polyclonal at a marker so far."""
    ranked = marker_summary(alleles).select("marker_id", F.row_number().over(Window.orderBy(F.desc(by), "marker_id")).alias("rank"))  # a row a marker
    multi = alleles.groupBy("marker_id", "sample_id").agg(F.count("*").alias("n")).filter("n > 1")
    first = multi.join(F.broadcast(ranked), "marker_id").groupBy("sample_id").agg(F.min("rank").alias("rank"))
    per = ranked.join(first.groupBy("rank").agg(F.count("*").alias("new")), "rank", "left")
    return per.select("marker_id", "rank", F.sum(F.coalesce("new", F.lit(0))).over(Window.orderBy("rank")).alias("cumulative"))


def sample_summary(alleles: DataFrame) -> DataFrame:
    """Per set: samples, mean and spread of MoI, polyclonal share and mean heterozygosity."""
    counted = moi_per_sample(alleles, ("set_id", "sample_id")).groupBy("set_id").agg(F.count("*").alias("samples"), *_moi_columns())
    return counted.join(mean_heterozygosity(alleles).select("set_id", "he"), "set_id")


def sample_profiles(alleles: DataFrame, markers: list[int]) -> DataFrame:
    """set_id, sample_id, m1, ... (mean of the dominant alleles), moi, multi_loci of each sample, after one shuffle."""
    keys = ("set_id", "sample_id")
    rows = alleles.repartition(*keys).withColumn("_top", F.max("height").over(Window.partitionBy(*keys, "marker_id")))
    per = rows.groupBy(*keys, "marker_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("height") == F.col("_top"), F.col("value"))).alias("v"))
    values = [F.max(F.when(F.col("marker_id") == m, F.col("v"))).alias(f"m{m}") for m in markers]
    return per.groupBy(*keys).agg(*values, F.max("n").alias("moi"), F.count_if(F.col("n") > 1).alias("multi_loci"))


def with_main_country(facts: DataFrame, sets: DataFrame) -> DataFrame:
    """The alleles of all sets, and once more those of the main country's sets as one set, named by the country.

    facts: set_id (text). sets: set_id, country. The main country has the most samples, of equal ones the last by name.
    """
    counted = facts.select("set_id", "sample_id").distinct().join(F.broadcast(sets), "set_id").groupBy("country").agg(F.count_distinct("sample_id").alias("n"))  # a row a set
    top = counted.agg(F.max(F.struct("n", "country"))["country"]).first()[0]
    inside = sets.filter(F.col("country") == top).select("set_id", "country")
    again = facts.join(F.broadcast(inside), "set_id").drop("set_id").withColumnRenamed("country", "set_id").dropDuplicates(["set_id", "sample_id", "marker_id", "value", "size", "height"])
    return facts.unionByName(again.select(*facts.columns))


def full_sample_summary(alleles: DataFrame, markers: list[int], sets: DataFrame | None = None) -> DataFrame:
    """Per set, and for the main country: `sample_summary` with the linkage of complete, strict and unique genotypes.

    n and ia of the sets of genotypes are null where none is complete; ia is null for at most two.
    """
    from .popgen import linkage

    rows = with_main_country(alleles, sets) if sets is not None else alleles
    profiles = cut(sample_profiles(rows, markers))  # a row a sample, read twice
    counted = profiles.groupBy("set_id").agg(F.count("*").alias("samples"), *_moi_columns())
    out = counted.join(mean_heterozygosity(rows).select("set_id", "he"), "set_id")
    # A genotype of a set stands for all its samples, for the strict ones, and for one: one table and one linkage for all.
    names = [f"m{m}" for m in markers]
    alike = profiles.dropna(subset=names).groupBy("set_id", *names).agg(F.count("*").alias("all"), F.count_if(F.col("multi_loci") <= 1).alias("strict"))
    kinds = {"": F.col("all"), "strict_": F.col("strict"), "unique_": F.lit(1)}
    each = alike.select("set_id", *names, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), n.cast("bigint").alias("weight")) for k, n in kinds.items()]))).filter("weight > 0")
    got = linkage(each, markers, ("set_id", "kind"), "weight")
    columns = [F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}{name}") for k in kinds for c, name in (("n", "n_ld"), ("ia", "ia"))]
    return out.join(got.groupBy("set_id").agg(*columns), "set_id", "left")


def rank_polyclonality(alleles: DataFrame, by: str = "he") -> DataFrame:
    """`cumulative_clonality` as shares of what all markers together find; 0 where they find none."""
    rows = cumulative_clonality(alleles, by)
    most = F.max("cumulative").over(Window.partitionBy())  # a row a marker
    return rows.withColumn("share", F.coalesce(F.try_divide(F.col("cumulative").cast("double"), most), F.lit(0.0)))


def loci_distribution(alleles: DataFrame, keys=("set_id",)) -> DataFrame:
    """Per set and number of markers with several alleles: how many samples have that number, and their mean MoI."""
    return moi_per_sample(alleles, (*keys, "sample_id")).groupBy(*keys, "multi_loci").agg(F.count("*").alias("n"), F.avg("moi").alias("mean"))


def he_report(alleles: DataFrame, sets: list[str]) -> tuple[DataFrame, DataFrame]:
    """(markers by sets with rows Mean and StdDev, test): the paired test of two sets, else that of all."""
    table = he_table(alleles, sets)
    shown = table.select(F.col("marker_id").cast("string").alias("marker"), *[f"`{s}`" for s in sets])
    ends = [table.agg(*[f(s).alias(s) for s in sets]).select(F.lit(label).alias("marker"), *[f"`{s}`" for s in sets]) for label, f in (("Mean", F.avg), ("StdDev", F.stddev_pop))]
    if len(sets) == 2:
        test = wilcoxon(table, *sets)
    else:
        long = table.select("marker_id", F.inline(F.array(*[F.struct(F.lit(s).alias("set_id"), F.col(f"`{s}`").alias("he")) for s in sets])))
        test = kruskal(long, "set_id", "he")
    return shown.unionByName(ends[0]).unionByName(ends[1]), test


def by_location(rows: DataFrame) -> DataFrame:
    return rows.groupBy("location").agg(F.count("*").alias("n"))


def by_year(rows: DataFrame) -> DataFrame:
    return rows.groupBy("year", "location").agg(F.count("*").alias("n"))


def adjusted_bins(alleles: DataFrame, bins: DataFrame) -> DataFrame:
    """Bins (marker_id, tag, pos) moved to the rounded mean size of their alleles, where there are any."""
    seen = alleles.groupBy("marker_id", F.col("value").alias("tag")).agg(F.round(F.avg("size"), 1).alias("mean"))
    return bins.join(seen, ["marker_id", "tag"], "left").select("marker_id", "tag", F.coalesce("mean", "pos").alias("pos"))


def comprehensive(alleles: DataFrame, markers: list[int] | None = None, sample_threshold: float = 0.5) -> dict[str, DataFrame]:
    """The tables of a full report, by name. With markers also the linkage of the sets and their FST over them.

    The alleles are written once and read by every table. They stay partitioned as they come: by sample, as a join with
    the samples leaves them, no table of samples shuffles them again.
    """
    from .genotype import genotypes
    from .popgen import fst_both
    from .quality import sample_failures

    alleles = cut_placed(alleles.select("set_id", "sample_id", "marker_id", "value", "size", "height"))
    parts = {
        "sample_failures": sample_failures(alleles, sample_threshold), "marker_summary": marker_summary(alleles), "sample_summary": sample_summary(alleles),
        "clonality_by_he": cumulative_clonality(alleles), "clonality_by_polyclonal": cumulative_clonality(alleles, "polyclonal"),
        "allele_summary": allele_summary(alleles, ("set_id",)), "marker_distribution": marker_distribution(alleles), "rank_by_he": rank_polyclonality(alleles),
        "rank_by_polyclonal": rank_polyclonality(alleles, "polyclonal"), "loci_distribution": loci_distribution(alleles),
    }
    if markers:
        parts |= {"linkage": full_sample_summary(alleles, markers), "fst": fst_both(genotypes(alleles, markers), markers)}
    return parts


def set_counts(members: DataFrame, alleles: DataFrame) -> DataFrame:
    """set_id, members, with_alleles, markers; sets without alleles stay, with zeros."""
    seen = alleles.select("sample_id", "marker_id").distinct()
    joined = members.join(seen.withColumnRenamed("sample_id", "seen"), F.col("sample_id") == F.col("seen"), "left")
    return joined.groupBy("set_id").agg(
        F.count_distinct("sample_id").alias("members"), F.count_distinct("seen").alias("with_alleles"), F.count_distinct("marker_id").alias("markers")
    )
