"""Genotypes, haplotypes and what compares them. `markers` is the explicit list of marker ids."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .alleles import dominant
from .classes import components
from .ordering import numbered


def genotypes(alleles: DataFrame, markers: list[int], keys=("set_id", "sample_id")) -> DataFrame:
    """A row per sample with columns m1, m2, ...: the mean of the dominant alleles, null where none is."""
    top = dominant(alleles, (*keys, "marker_id"))
    wide = top.groupBy(*keys).pivot("marker_id", markers).agg(F.avg("value"))
    return wide.select(*keys, *[F.col(str(m)).alias(f"m{m}") for m in markers])


def complete(wide: DataFrame, markers: list[int]) -> DataFrame:
    return wide.dropna(subset=[f"m{m}" for m in markers])


def unique_genotypes(wide: DataFrame, markers: list[int]) -> DataFrame:
    """For each distinct genotype (nulls being equal) the smallest sample id and how many samples share it."""
    return wide.groupBy(*[f"m{m}" for m in markers]).agg(F.min("sample_id").alias("sample_id"), F.count("*").alias("n"))


def unique_in_sets(wide: DataFrame, markers: list[int]) -> DataFrame:
    """Of the samples of a set with one genotype that with the smallest id; columns as they were."""
    names = [f"m{m}" for m in markers]
    return wide.groupBy("set_id", *names).agg(F.min("sample_id").alias("sample_id")).select("set_id", "sample_id", *names)


def genotype_display(alleles: DataFrame, assays: DataFrame) -> DataFrame:
    """`genotype_rows` with the assay of each allele: sample_id, marker_id, row, value, height, assay_id, filename."""
    per = alleles.groupBy("sample_id", "marker_id").agg(F.sort_array(F.collect_list(F.struct("height", "value", "assay_id")), False).alias("a"))
    rows = per.select("sample_id", "marker_id", F.posexplode("a").alias("row", "x")).select("sample_id", "marker_id", "row", "x.value", "x.height", "x.assay_id")
    return rows.join(assays.select("assay_id", "filename"), "assay_id", "left").select("sample_id", "marker_id", "row", "value", "height", "assay_id", "filename")


def genotype_rows(alleles: DataFrame) -> DataFrame:
    """sample_id, marker_id, row, value, height: alleles of a marker side by side, the highest in row 0."""
    per = alleles.groupBy("sample_id", "marker_id").agg(F.sort_array(F.collect_list(F.struct("height", "value")), False).alias("a"))
    return per.select("sample_id", "marker_id", F.posexplode("a").alias("row", "x")).select("sample_id", "marker_id", "row", "x.value", "x.height")


def haplotypes(wide: DataFrame, markers: list[int]) -> DataFrame:
    """haplotype ('v1 v2 ...'), freq, first_sample, hap_id: 1, 2, ... by first sample; singletons are class 0."""
    text = F.concat_ws(" ", *[F.col(f"m{m}").cast("int").cast("string") for m in markers])
    seen = complete(wide, markers).withColumn("haplotype", text).groupBy("haplotype").agg(F.count("*").alias("freq"), F.min("sample_id").alias("first_sample"))
    many = numbered(seen.filter("freq > 1"), ["first_sample"]).withColumn("hap_id", F.col("number").cast("int")).drop("number")
    return many.unionByName(seen.filter("freq = 1").withColumn("hap_id", F.lit(0)))


def haplotypes_by_set(wide: DataFrame, markers: list[int]) -> DataFrame:
    text = F.concat_ws(" ", *[F.col(f"m{m}").cast("int").cast("string") for m in markers])
    return complete(wide, markers).groupBy("set_id", text.alias("haplotype")).agg(F.count("*").alias("n"))


def pairwise_distance(wide: DataFrame, markers: list[int], blocks: int = 24) -> DataFrame:
    """i, j, d, d_norm for every i < j: differing markers. All pairs are the result; meant for a chosen set of samples.

    Samples are dealt to blocks, and each two blocks meet in a task of their own: however few bytes the samples take,
    their pairs are dealt to blocks * (blocks + 1) / 2 cells, and a task holds one block.
    """
    values = [F.col(f"m{m}") for m in markers]
    block = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int")
    kept = cut(complete(wide, markers).select(block.alias("block"), F.struct("sample_id", *values).alias("x")))
    later, earlier = F.sequence(F.col("block"), F.lit(blocks - 1)), F.sequence(F.lit(0), F.col("block"))
    left = kept.select(F.col("block").alias("p"), F.explode(later).alias("q"), F.col("x").alias("a"))
    right = kept.select(F.explode(earlier).alias("p"), F.col("block").alias("q"), F.col("x").alias("b"))
    left, right = (df.repartition(blocks * (blocks + 1) // 2, "p", "q") for df in (left, right))
    # In a cell of two blocks each two samples meet once, whichever has the smaller id.
    met = left.join(right.hint("shuffle_hash"), ["p", "q"]).filter("p < q OR a.sample_id < b.sample_id")
    differ = sum(((F.col(f"a.m{m}") != F.col(f"b.m{m}")).cast("int") for m in markers), F.lit(0))
    pairs = met.select(F.least("a.sample_id", "b.sample_id").alias("i"), F.greatest("a.sample_id", "b.sample_id").alias("j"), differ.alias("d"))
    return pairs.withColumn("d_norm", F.col("d") / float(len(markers)))


def genotype_members(wide: DataFrame, markers: list[int]) -> DataFrame:
    """sample_id, genotype of every complete sample: the smallest sample id that has the same values."""
    names = [f"m{m}" for m in markers]
    kept = complete(wide, markers).select("sample_id", *names)
    return kept.join(unique_genotypes(kept, markers).select(*names, F.col("sample_id").alias("genotype")), names).select("sample_id", "genotype")


def genotype_pairs(wide: DataFrame, markers: list[int], blocks: int = 12) -> DataFrame:
    """i, j, n_i, n_j, d, d_norm of every two distinct genotypes i < j with their samples and differing markers.

    With `genotype_members` this is the distance of every pair of complete samples; those of one genotype differ in
    nothing. Genotypes are dealt to blocks, and each pair of blocks meets by an equi-join.
    """
    values = F.array(*[f"m{m}" for m in markers])
    own = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    one = unique_genotypes(complete(wide, markers), markers).select("sample_id", "n", values.alias("v"), own.alias("own"), every.alias("other"))
    left = one.select(F.col("own").alias("p"), F.col("other").alias("q"), F.col("sample_id").alias("i"), F.col("n").alias("n_i"), F.col("v").alias("a"))
    right = one.select(F.col("other").alias("p"), F.col("own").alias("q"), F.col("sample_id").alias("j"), F.col("n").alias("n_j"), F.col("v").alias("b"))
    differ = F.aggregate(F.zip_with("a", "b", lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    met = left.join(right, ["p", "q"]).filter(F.col("i") < F.col("j"))
    return met.select("i", "j", "n_i", "n_j", differ.alias("d")).withColumn("d_norm", F.col("d") / float(len(markers)))


def mismatch_histogram(wide: DataFrame, markers: list[int]) -> DataFrame:
    """d, share over the ordered-or-equal pairs i <= j of complete samples, diagonal included.

    Samples with one genotype are counted together, and pairs that agree on a subset of markers are counted by that
    subset: a cube over the distinct genotypes gives the pairs equal on each subset, and inclusion-exclusion gives those
    equal on exactly so many. No pair of samples is ever made; the subsets are 2 to the number of markers, at most 20.
    """
    from math import comb

    names, size = [f"m{m}" for m in markers], len(markers)
    if size > 20:
        raise ValueError("more than 20 markers have too many subsets; take fewer, or genotype_pairs")
    distinct = complete(wide, markers).groupBy(*names).agg(F.count("*").alias("c"))
    cubed = distinct.cube(*names).agg(F.sum("c").alias("n"), F.grouping_id().alias("left_out"))
    sums = cubed.filter("n IS NOT NULL").groupBy((F.lit(size) - F.bit_count("left_out")).alias("k")).agg(F.sum(F.col("n") * (F.col("n") + 1) / 2).alias("pairs"))
    # Pairs equal on exactly e markers: sum over k >= e of (-1)^(k-e) * C(k, e) * S_k.
    signs = F.inline(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(k).alias("k"), F.lit(float((-1) ** (k - e) * comb(k, e))).alias("w")) for e in range(size + 1) for k in range(e, size + 1)]))
    weights = wide.sparkSession.range(1).select(signs)
    exact = sums.join(F.broadcast(weights), "k").groupBy("e").agg(F.sum(F.col("w") * F.col("pairs")).alias("pairs"))
    total = F.sum("pairs").over(Window.partitionBy())
    return exact.select((F.lit(size) - F.col("e")).alias("d"), F.try_divide("pairs", total).alias("share"))


def _distinct_genotypes(wide: DataFrame, markers: list[int]) -> DataFrame:
    """g (struct of the values), first_sample, n of each distinct genotype; a missing value is a value of its own."""
    values = F.struct(*[F.col(f"m{m}").cast("double").alias(f"m{m}") for m in markers])
    return wide.select(values.alias("g"), "sample_id").groupBy("g").agg(F.min("sample_id").alias("first_sample"), F.count("*").alias("n"))


def _masked(distinct: DataFrame, markers: list[int], open_markers: list[tuple[int, ...]]) -> DataFrame:
    """The distinct genotypes once for each choice of open markers: mask (its number) and rest, the other values."""
    wanted = set(markers)
    keys = [
        F.struct(F.lit(i).alias("mask"), F.struct(*[(F.col(f"g.m{m}") if m in wanted - set(c) else F.lit(None).cast("double")).alias(f"m{m}") for m in markers]).alias("rest"))
        for i, c in enumerate(open_markers)
    ]
    return distinct.select("first_sample", "n", F.explode(F.array(*keys)).alias("k")).select("first_sample", "n", "k.mask", "k.rest")


def genotype_neighbours(wide: DataFrame, markers: list[int], radius: int) -> DataFrame:
    """first_sample, n, at_1, ..., near of each distinct genotype: the samples that have it, those whose genotype differs
    at exactly 1, 2, ... markers, and all of these up to the radius.

    No pairs are made. Genotypes that differ at j markers or fewer agree outside some choice of j open markers. The
    samples that agree with a genotype outside each choice are counted, by partial sums; a sample at i differences is
    in comb(markers - i, j - i) of the counts for j, which is solved for the number at exactly j.
    """
    if not 0 < radius < len(markers):
        raise ValueError(f"a radius from 1 to {len(markers) - 1}, not {radius}")
    choices = [c for j in range(1, radius + 1) for c in combinations(markers, j)]
    sizes = F.array(*[F.lit(len(c)) for c in choices])
    distinct = _distinct_genotypes(wide, markers)
    masked = _masked(distinct, markers, choices)
    counts = masked.groupBy("mask", "rest").agg(F.sum("n").alias("c"))
    found = masked.join(counts, ["mask", "rest"]).groupBy("first_sample", "n")
    found = found.agg(*[F.sum(F.when(F.get(sizes, F.col("mask")) == j, F.col("c")).otherwise(0)).alias(f"sum_{j}") for j in range(1, radius + 1)])
    at = {0: F.col("n")}
    for j in range(1, radius + 1):
        at[j] = F.col(f"sum_{j}") - sum((at[i] * comb(len(markers) - i, j - i) for i in range(j)), F.lit(0))
    return found.select("first_sample", "n", *[at[j].cast("bigint").alias(f"at_{j}") for j in range(1, radius + 1)], sum((at[j] for j in range(1, radius + 1)), F.lit(0)).cast("bigint").alias("near"))


def genotype_classes(wide: DataFrame, markers: list[int], radius: int) -> DataFrame:
    """sample_id, class_id, class_size: samples are of one class if steps of at most `radius` differing markers lead from
    one genotype to the other; class_id is its smallest sample.

    Genotypes that agree outside a choice of `radius` open markers all link to each other, so each is tied to the first
    of them only: as many ties as genotypes and choices, whatever the size of a group.
    """
    if not 0 <= radius < len(markers):
        raise ValueError(f"a radius from 0 to {len(markers) - 1}, not {radius}")
    distinct = cut(_distinct_genotypes(wide, markers))
    masked = _masked(distinct, markers, list(combinations(markers, radius)))
    first = masked.groupBy("mask", "rest").agg(F.min("first_sample").alias("b"))
    found = components(masked.join(first, ["mask", "rest"]).select(F.col("first_sample").alias("a"), "b"))
    classes = distinct.join(found, F.col("first_sample") == F.col("node"), "left").select("g", "n", F.coalesce("component", "first_sample").alias("class_id"))
    sized = classes.join(classes.groupBy("class_id").agg(F.sum("n").alias("class_size")), "class_id").select("g", "class_id", "class_size")
    own = wide.select("sample_id", F.struct(*[F.col(f"m{m}").cast("double").alias(f"m{m}") for m in markers]).alias("g"))
    return own.join(sized, "g").select("sample_id", "class_id", "class_size")
