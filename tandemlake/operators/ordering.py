"""Running numbers over whole tables, without sorting a table in one task.

The rows are written once. A sample of their sort keys gives cut points, which are held as constants: the count of each
range and the numbering inside it use one and the same expression, so both share one layout whatever partitions adaptive
execution makes of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from ..storage import cut

#: Rows of a range in expectation, ranges at most, and sampled keys for each range.
ROWS_PER_RANGE = 50_000
MAX_RANGES = 10_000
KEYS_PER_RANGE = 20


def range_cuts(rows: DataFrame, ranges: int, total: int) -> list[str]:
    """JSON of the sorted keys (column `key`, a struct) that begin a range, but for the first; empty for one range.

    Some KEYS_PER_RANGE keys a range are sampled; they only decide how even the ranges are, so it does no harm that JSON
    rounds a timestamp.
    """
    if ranges < 2:
        return []
    share = min(1.0, KEYS_PER_RANGE * ranges / total)
    sampled = rows.sample(share, seed=5).agg(F.array_sort(F.collect_list("key")).alias("k"))
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.element_at("k", F.greatest((F.size("k") * i / ranges).cast("int"), F.lit(1))))
    each = F.transform(F.array_distinct(at), lambda c: F.to_json(c))
    cuts = sampled.filter(F.size("k") > 0).select(each).first()  # at most MAX_RANGES keys
    return cuts[0] if cuts else []


def range_number(key: Column, kind: DataType, cuts: list[str]) -> Column:
    """How many cut points are at most the key, looked up in two steps of some sqrt(ranges) comparisons each."""
    if not cuts:
        return F.lit(0)
    array = lambda values: F.from_json(F.lit(f"[{','.join(values)}]"), ArrayType(kind))  # noqa: E731  folded to a constant
    wide = math.isqrt(len(cuts)) + 1
    skipped = F.greatest(F.size(F.filter(array(cuts[::wide]), lambda c: c <= key)) - 1, F.lit(0)) * wide
    return skipped + F.size(F.filter(F.slice(array(cuts), skipped + 1, wide), lambda c: c <= key))


def numbered(rows: DataFrame, order: list[str | Column], rows_per_range: int | None = None) -> DataFrame:
    """Add `number`, 1, 2, ... by the ascending order (nulls first) over all rows, without gaps.

    Rows that are equal in the order get numbers next to each other, in any sequence; so a value that a third of all
    rows share is cut into ranges like any other. An empty table stays empty. A column `number` of the rows is replaced.
    """
    names = [c for c in rows.columns if c.lower() != "number"]
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"))
    kept = cut(packed)
    # Checkpointed partitions don't change, so neither does the place of a row, which tells equal keys apart.
    kept = kept.withColumn("key", F.struct("key.*", F.monotonically_increasing_id().alias("at")))
    total = kept.count()
    ranges = max(1, min(MAX_RANGES, total // (rows_per_range or ROWS_PER_RANGE)))
    cuts = range_cuts(kept, ranges, total)
    placed = kept.withColumn("range", range_number(F.col("key"), kept.schema["key"].dataType, cuts))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    got = placed.withColumn("inside", inside).join(F.broadcast(starts), "range")
    return got.select("row.*", (F.col("inside") + F.col("start")).cast("bigint").alias("number"))
