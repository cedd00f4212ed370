"""Kept statistics equal the batch queries after every batch, over restarts, repeated batches and merges."""

import random

from pyspark.sql import functions as F

from tandemlake.operators import quality as ql
from tandemlake.operators import summary as sm
from tandemlake.streaming import kept

FACT = "sample_id bigint, marker_id bigint, value double, height double"


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_after_each_batch(spark, tmp_path):
    rng = random.Random(1)
    source, folder, checkpoint = (str(tmp_path / n) for n in ("in", "kept", "cp"))
    seen = []
    for batch in range(5):
        new = [(rng.randrange(12), rng.randrange(4), float(rng.randrange(5)), 1.0) for _ in range(40 * (batch != 3))]
        spark.createDataFrame(new, FACT).coalesce(1).write.mode("append").parquet(source)
        seen += new
        stream = spark.readStream.schema(FACT).parquet(source)
        kept.keep(stream, folder, checkpoint).awaitTermination()
        if batch == 2:
            kept.compact(spark, folder)
            kept.compact(spark, folder)
        every = spark.createDataFrame(seen, FACT)
        counts = kept.kept_counts(spark, folder)
        assert rows_of(kept.kept_moi(counts)) == rows_of(ql.moi_per_sample(every))
        assert rows_of(kept.kept_distribution(counts)) == rows_of(sm.marker_distribution(every))
        want = every.groupBy("marker_id", "value").agg(F.count("*").alias("n"))
        assert rows_of(kept.kept_alleles(counts).drop("freq")) == rows_of(want)
        assert all(abs(r["s"] - 1) < 1e-9 for r in kept.kept_alleles(counts).groupBy("marker_id").agg(F.sum("freq").alias("s")).collect())
    assert kept._folders(spark, folder, "base") and len(kept._folders(spark, folder, "batch")) <= 2


def test_repeated_batches_and_late_ones(spark, tmp_path):
    """A batch that is written again, before or after a merge, counts once; without batches there is nothing."""
    folder = str(tmp_path / "kept")
    assert kept.kept_counts(spark, folder).count() == 0
    kept.compact(spark, folder)
    rows = spark.createDataFrame([(1, 1, 2.0, 1.0), (1, 1, 3.0, 1.0), (2, 1, 2.0, 1.0), (2, None, None, 1.0)], FACT)
    for batch in (0, 1, 1):
        kept.add_batch(rows, folder, batch)
    first = rows_of(kept.kept_counts(spark, folder).na.fill(-1))
    assert [r[-1] for r in first] == [2, 2, 2, 2]
    kept.compact(spark, folder)
    kept.add_batch(rows, folder, 1)  # a restart after the merge
    assert rows_of(kept.kept_counts(spark, folder).na.fill(-1)) == first
    kept.add_batch(rows, folder, 2)
    assert [r[-1] for r in rows_of(kept.kept_counts(spark, folder).na.fill(-1))] == [3, 3, 3, 3]
