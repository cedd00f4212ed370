"""Running numbers are 1..n in order, whatever adaptive execution does with the partitions."""

import pytest
from pyspark.sql import functions as F

from tandemlake.operators import ordering


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_of_two_million_rows(spark, adaptive):
    n = 2_000_000
    set_before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        # A permutation of 0..n-1, so the right number of a row is its key plus one.
        rows = spark.range(0, n, 1, 16).select(((F.col("id") * 1_234_577 + 991) % n).alias("k"))
        got = ordering.numbered(rows, ["k"], rows_per_range=70_000)
        r = got.agg(F.count("*").alias("n"), F.sum((F.col("number") != F.col("k") + 1).cast("int")).alias("wrong")).first()
        assert (r["n"], r["wrong"]) == (n, 0)
    finally:
        for k, v in set_before.items():
            spark.conf.set(k, v)


def test_equal_keys_are_cut_into_ranges(spark):
    rows = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 7).alias("a"), F.col("id").cast("string").alias("number"))
    got = ordering.numbered(rows, ["a"], rows_per_range=300).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(1, 9_001))
    values = [-1 if r["a"] is None else r["a"] for r in got]
    assert values == sorted(values) and values.count(-1) == 3_000


def test_orders_of_several_columns_and_an_empty_table(spark):
    rows = spark.createDataFrame([("b", 1.5, None), ("a", None, 3), ("a", 2.0, 3), ("a", 2.0, None)], "x string, y double, range int")
    got = [(r["x"], r["y"], r["range"], r["number"]) for r in ordering.numbered(rows, ["x", F.col("y"), "range"], rows_per_range=1).orderBy("number").collect()]
    assert got == [("a", None, 3, 1), ("a", 2.0, None, 2), ("a", 2.0, 3, 3), ("b", 1.5, None, 4)]
    assert ordering.numbered(rows.limit(0), ["x"]).count() == 0
