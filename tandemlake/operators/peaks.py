"""Peaks of traces: stutter, overlap, sizing and binning. A peak has peak_id, channel_id, assay_id, rtime, size, height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stutter(peaks: DataFrame, reach: float = 1.25) -> DataFrame:
    """peak_type 'peak-stutter' where a neighbour by size is within `reach` and higher, else 'peak-called'."""
    order = Window.partitionBy("channel_id").orderBy("size", "peak_id")
    near = F.lit(False)
    for move in (F.lag, F.lead):
        other, height = move("size").over(order), move("height").over(order)
        near = near | F.coalesce((F.abs(other - F.col("size")) < reach) & (height > F.col("height")), F.lit(False))
    return peaks.withColumn("peak_type", F.when(near, "peak-stutter").otherwise("peak-called"))


def width_level(begin: Column, end: Column) -> Column:
    """The least level from 1 on whose cells, 2 to its power wide, are as wide as the interval."""
    return F.length(F.bin(F.greatest(F.ceil(end - begin), F.lit(1)).cast("bigint") - 1))


def _meetings(x: DataFrame, y: DataFrame, above: bool = False) -> DataFrame:
    """Two intervals of an assay (assay_id, brtime, ertime, ...), their columns with x_ and y_ before their names, that lie
    in neighbouring cells of the level of y, which is that of x or a higher one (`above`: a higher one).

    An interval's level follows its own width, and it is kept once, in the cell of its level where it begins. Others find
    it from their own level upwards, over the levels that the assay has, in at most four cells of each. So a wide peak
    meets what it covers, and no other peak meets more for it.
    """
    cell = lambda time, level: F.floor(time / F.pow(F.lit(2.0), level)).cast("bigint")
    finders, kept = (t.withColumn("_level", width_level(F.col("brtime"), F.col("ertime"))) for t in (x, y))
    levels = kept.groupBy("assay_id").agg(F.collect_set("_level").alias("_levels"))  # at most some 60 a row
    own = lambda t, side: [F.col(c).alias(f"{side}_{c}") for c in t.columns]
    stood = kept.select("assay_id", F.col("_level").alias("level"), cell(F.col("brtime"), F.col("_level")).alias("cell"), *own(y, "y"))
    first, last = F.least("brtime", "ertime"), F.greatest("brtime", "ertime")
    higher = F.filter("_levels", lambda v: v > F.col("_level") if above else v >= F.col("_level"))
    rows = finders.join(levels, "assay_id").select("assay_id", *own(x, "x"), first.alias("first"), last.alias("last"), F.explode(higher).alias("level"))
    rows = rows.select("assay_id", *[f"x_{c}" for c in x.columns], "level", F.explode(F.sequence(cell(F.col("first"), F.col("level")) - 1, cell(F.col("last"), F.col("level")))).alias("cell"))
    return rows.join(stood, ["assay_id", "level", "cell"]).drop("assay_id", "level", "cell")


def overlapping_pairs(peaks: DataFrame) -> DataFrame:
    """x, y: structs of two peaks of different channels of an assay, the one of the lower or the same level first, that
    lie in neighbouring cells of the level of y. Pairs of one level come twice. Peaks have brtime and ertime."""
    sides = [F.struct(*[F.col(f"{side}_{c}").alias(c) for c in peaks.columns]).alias(side) for side in "xy"]
    return _meetings(peaks, peaks).filter("x_channel_id <> y_channel_id").select(*sides)


def two_highest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, height, channel_id: of each key the highest row, and the highest of another channel. Whatever channel is left
    out, the highest of the others is one of the two."""
    per = rows.groupBy(*keys, "channel_id").agg(F.max("height").alias("height"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("height"), "channel_id"))
    return per.withColumn("_place", place).filter("_place <= 2").drop("_place")


def higher_than(peaks: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The peaks below one of `two_highest` that is of another channel than theirs."""
    best, other = F.max(F.struct("height", "channel_id")), F.min(F.struct("height", "channel_id"))
    per = found.groupBy(*keys).agg(best["height"].alias("_best"), best["channel_id"].alias("_of"), F.when(F.count("*") > 1, other["height"]).alias("_other"))
    limit = F.when(F.col("_of") != F.col("channel_id"), F.col("_best")).otherwise(F.col("_other"))
    return peaks.join(per, keys).filter(F.col("height") < limit).drop("_best", "_of", "_other")


TIMES = ["assay_id", "brtime", "ertime"]


def _overlapping_highest(rows: DataFrame) -> DataFrame:
    """assay_id, brtime, ertime, height, channel_id: `two_highest` of the peaks that overlap each interval of an assay.

    Peaks of one interval and assay count together, and no two of them meet. Two intervals overlap where the second
    begins within the first, or the first within the second. Times are numbered in each assay. The numbers are leaves of a
    binary tree: an interval is at most two nodes of a level, a place one node of each, and both meet in a node. So each
    interval makes rows as the logarithm of its assay's times, however many overlap it.
    """
    tops = two_highest(rows, TIMES)
    seen = tops.groupBy(*TIMES).agg(F.collect_list(F.struct("height", "channel_id")).alias("e"))
    sides = seen.filter("brtime <= ertime").select(*TIMES, "e", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("time")) for s, c in enumerate(TIMES[1:])])))
    sides = sides.withColumn("n", F.dense_rank().over(Window.partitionBy("assay_id").orderBy("time")).cast("bigint"))
    sides = sides.withColumn("last", F.max("n").over(Window.partitionBy("assay_id")))
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("n")))
    placed = sides.groupBy(*TIMES).agg(F.first("e").alias("e"), at(0).alias("b"), at(1).alias("z"), (F.length(F.bin(F.max("last"))) + 1).alias("depth"))
    levels = F.sequence(F.lit(0), F.col("depth"))

    def node(way: int, level: Column, cell: Column) -> Column:
        return F.struct(F.lit(way).alias("way"), level.alias("level"), cell.alias("cell"))

    def place(way: int, n: Column) -> Column:
        """The nodes above a leaf."""
        return F.transform(levels, lambda v: node(way, v, F.call_function("shiftright", n, v)))

    def span(way: int, low: Column, high: Column) -> Column:
        """The nodes whose leaves together are low to high - 1."""
        shift = lambda x, v: F.call_function("shiftright", x, v)
        a, z = (lambda v: -shift(-low, v)), (lambda v: shift(high, v))
        ends = F.transform(levels, lambda v: F.filter(F.array(
            F.when((a(v) < z(v)) & (a(v) % 2 == 1), node(way, v, a(v))), F.when((a(v) < z(v)) & (z(v) % 2 == 1), node(way, v, z(v) - 1)),
        ), lambda e: e.isNotNull()))
        return F.flatten(ends)

    # Leaves are twice the number, one less for an interval without length, which another one of its time doesn't reach.
    b, z = 2 * F.col("b"), 2 * F.col("z")
    begins = F.when(b < z, b).otherwise(b - 1)
    given = placed.select("assay_id", "e", F.inline(F.concat(place(0, begins), span(1, b + 1, z)))).select("assay_id", "way", "level", "cell", F.inline("e"))
    asked = placed.select(*TIMES, F.inline(F.concat(span(0, b, z - 1), place(1, b))))
    nodes = ["assay_id", "way", "level", "cell"]
    met = asked.join(two_highest(given, nodes), nodes).select(*TIMES, "height", "channel_id")
    # An interval that ends before it begins overlaps what reaches over it on both sides; these few meet all of their assay.
    odd = seen.filter("brtime > ertime").select("assay_id", F.col("brtime").alias("_b"), F.col("ertime").alias("_z"), F.col("e").alias("_e"))
    pairs = seen.join(odd, "assay_id").filter("brtime < _z AND _b < ertime")
    both = F.array(F.struct("brtime", "ertime", F.col("_e").alias("e")), F.struct(F.col("_b").alias("brtime"), F.col("_z").alias("ertime"), "e"))
    turned = pairs.select("assay_id", F.inline(both)).select(*TIMES, F.inline("e"))
    return two_highest(met.unionByName(turned), TIMES)


def overlaps(peaks: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """peak_id of peaks that overlap in time with a higher one of another channel of the assay.

    Peaks have brtime and ertime (end exclusive); all are judged by the types they had before. With channels (assay_id,
    channel_id, data) one of the two peaks must also be lower than the other channel's signal at its time. Instead of data
    channels may have levels, a map from the times of the peaks to the signal.
    """
    known = peaks.dropna(subset=[*TIMES, "channel_id", "height"])
    if channels is None:
        return higher_than(known.select("peak_id", "channel_id", "height", *TIMES), _overlapping_highest(known.select(*TIMES, "channel_id", "height")), TIMES).select("peak_id").distinct()
    # Intervals of channels that have a signal meet the different intervals and times of the assay's peaks, not the peaks.
    rows = known.dropna(subset=["rtime"]).select("peak_id", "channel_id", "height", "rtime", *TIMES)
    places, mine = [*TIMES, "rtime"], [*TIMES, "channel_id"]
    at = F.try_element_at("levels", F.col("rtime").cast("int")) if "levels" in channels.columns else F.get("data", F.col("rtime").cast("int"))
    traces = channels.select("assay_id", "channel_id", "levels" if "levels" in channels.columns else "data")
    shown = known.join(traces.select("assay_id", "channel_id"), ["assay_id", "channel_id"], "left_semi").groupBy(*mine).agg(F.max("height").alias("height"))
    asked = rows.select(*places).distinct()
    near = lambda of, at: [*[F.col(f"{at}_{c}").alias(c) for c in places], *[F.col(f"{of}_{c}").alias(c) for c in ("channel_id", "height")], F.col(f"{of}_brtime").alias("own_b"), F.col(f"{of}_ertime").alias("own_e")]
    near = _meetings(shown, asked).select(*near("x", "y")).unionByName(_meetings(asked, shown, above=True).select(*near("y", "x")))
    near = near.filter("own_b < ertime AND brtime < own_e").withColumn("own", F.struct(F.col("own_b").alias("brtime"), F.col("own_e").alias("ertime")))
    met = near.groupBy(*places, "channel_id").agg(F.max("height").alias("height"), F.collect_list("own").alias("own"))
    met = met.join(traces, ["assay_id", "channel_id"]).withColumn("level", at).drop("data", "levels").filter("level IS NOT NULL")
    # Lower than the signal of a channel whose own peak there is higher.
    under = two_highest(met.select(*places, "channel_id", F.least("height", "level").alias("height")), places)
    first = higher_than(rows, under, places).select("peak_id")
    # Below a peak that is lower than the own channel's signal: of the peaks below the signal the highest of another channel.
    order = Window.partitionBy(*places).orderBy("height", "channel_id")
    turned = F.lag("channel_id").over(order) != F.col("channel_id")
    steps = rows.select(*places, "height", "channel_id").withColumn("_turn", F.when(turned, F.lag("height").over(order)))
    steps = steps.withColumn("_turn", F.last("_turn", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.select(*places, "height", F.lit(1).alias("kind"), "channel_id", F.col("height").alias("top"), F.col("channel_id").alias("of"), F.array("_turn").alias("other"))
    sought = met.select(*places, F.col("level").alias("height"), F.lit(0).alias("kind"), "channel_id", "own")
    line = Window.partitionBy(*places).orderBy("height", "kind", "channel_id").rowsBetween(Window.unboundedPreceding, 0)
    below = steps.unionByName(sought, allowMissingColumns=True).select(*[F.last(c, ignorenulls=True).over(line).alias(c) for c in ("top", "of", "other")], "assay_id", "channel_id", "kind", "own").filter("kind = 0")
    below = below.select("assay_id", "channel_id", F.when(F.col("of") != F.col("channel_id"), F.col("top")).otherwise(F.get("other", F.lit(0))).alias("_limit"), F.inline("own"))
    limits = below.filter("_limit IS NOT NULL").groupBy(*mine).agg(F.max("_limit").alias("_limit"))
    second = rows.join(limits, mine).filter("height < _limit").select("peak_id")
    return first.unionByName(second).distinct()


def band_overlaps(peaks: DataFrame, tolerance: float = 1.25) -> DataFrame:
    """peak_id of peaks with a higher one of another channel of the assay within the tolerance of their size.

    Peaks of one size and assay count together: sizes meet sizes, each with the two highest of different channels.
    """
    known = peaks.dropna(subset=["assay_id", "channel_id", "size", "height"]).select("peak_id", "channel_id", "height", "assay_id", "size")
    sizes = two_highest(known, ["assay_id", "size"]).withColumn("slot", F.floor(F.col("size") / tolerance))
    given = sizes.select("assay_id", "slot", F.col("size").alias("_size"), "height", "channel_id")
    asked = sizes.select("assay_id", "size", "slot").distinct().select("assay_id", "size", F.explode(F.array(*[F.col("slot") + k for k in (-1, 0, 1)])).alias("slot"))
    met = asked.join(given, ["assay_id", "slot"]).filter(F.abs(F.col("size") - F.col("_size")) < tolerance)
    return higher_than(known, two_highest(met, ["assay_id", "size"]), ["assay_id", "size"]).select("peak_id").distinct()


def nearest_bin(size: Column, bins: Column) -> Column:
    """The bin (pos, tag) nearest to a size; of two equally near the lower. Bins are an array column or literal."""
    keyed = F.transform(bins, lambda b: F.struct(F.abs(b["pos"] - size).alias("d"), b["pos"].alias("pos"), b["tag"].alias("tag")))
    return F.array_min(keyed)


def bin_alleles(alleles: DataFrame, markers: DataFrame) -> DataFrame:
    """value and peak_type of sized alleles: strictly within their marker's range they get the nearest bin's tag.

    Markers: marker_id, repeats, min_size, max_size, bins. far: farther from the bin than three quarters of a repeat.
    """
    joined = alleles.join(F.broadcast(markers), "marker_id")  # a row a marker
    inside = (F.col("size") > 0) & (F.col("size") > F.col("min_size")) & (F.col("size") < F.col("max_size"))
    found = joined.withColumn("_bin", F.when(inside, nearest_bin(F.col("size"), F.col("bins"))))
    return found.select(
        *[c for c in alleles.columns if c not in ("value", "peak_type")], F.coalesce(F.col("_bin.tag"), F.col("value").cast("int")).alias("value"),
        F.when(F.col("_bin").isNotNull(), "peak-bin").otherwise(F.col("peak_type")).alias("peak_type"),
        (F.col("_bin.d") > F.col("repeats") * 0.75).alias("far"),
    )


def size_peaks(peaks: DataFrame, ladders: DataFrame, low: float = 70, high: float = 600) -> DataFrame:
    """size, value and peak_type by the assay's cubic z (highest power first), strictly within its ladder's peaks."""
    z = F.col("z")
    x = F.col("rtime").cast("double")
    size = ((F.get(z, F.lit(0)) * x + F.get(z, F.lit(1))) * x + F.get(z, F.lit(2))) * x + F.get(z, F.lit(3))
    within = (x > F.col("first_rtime")) & (x < F.col("last_rtime"))
    joined = peaks.join(ladders, "assay_id").withColumn("size", F.when(within, size).otherwise(-1.0))
    called = F.when(within & F.col("size").between(low, high), "peak-called").otherwise("peak-unassigned")
    return joined.withColumn("value", F.when(within, F.bround("size").cast("int"))).withColumn("peak_type", called).drop("z", "first_rtime", "last_rtime")


def overlap_report(peaks: DataFrame, rel: float = 0.33) -> DataFrame:
    """Channels whose highest overlapping peak exceeds their lowest retained bin (height over rel * the highest bin)."""
    top = F.max(F.when(F.col("peak_type") == "peak-bin", F.col("height"))).over(Window.partitionBy("channel_id"))
    rows = peaks.withColumn("_top", top)
    per = rows.groupBy("channel_id").agg(
        F.max(F.when(F.col("peak_type") == "peak-overlap", F.col("height"))).alias("overlap"),
        F.min(F.when((F.col("peak_type") == "peak-bin") & (F.col("height") > rel * F.col("_top")), F.col("height"))).alias("lowest"),
    )
    return per.filter("overlap > lowest")


def spacing(peaks: DataFrame) -> DataFrame:
    """The least and the largest distance between neighbouring sizes of a channel."""
    gap = F.lead("size").over(Window.partitionBy("channel_id").orderBy("size")) - F.col("size")
    return peaks.withColumn("gap", gap).groupBy("channel_id").agg(F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))


def separated(peaks: DataFrame, least: float) -> DataFrame:
    """channel_id, rtime, height of peaks more than `least` apart: from the end on, of two nearer ones the higher stays.

    A fold over the channel's peaks, as each choice depends on the last.
    """
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("rtime", "height"))))
    per = peaks.groupBy("channel_id").agg(ordered.alias("p"))
    first = F.slice("p", 1, 1)

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        head = F.slice(kept, 1, F.size(kept) - 1)
        higher = F.when(last["height"] > x["height"], last).otherwise(x)
        return F.when(last["rtime"] - x["rtime"] > least, F.concat(kept, F.array(x))).otherwise(F.concat(head, F.array(higher)))

    kept = F.aggregate(F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), first, step)
    return per.select("channel_id", F.inline(kept))
