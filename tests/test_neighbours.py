import random

import pytest
from pyspark.sql import functions as F

from tandemlake.operators import genotype as gt

WIDE = "sample_id bigint, m1 double, m2 double, m3 double, m4 double"
MARKERS = [1, 2, 3, 4]


@pytest.fixture(scope="module")
def table():
    rng = random.Random(2)
    rows = [(i, *[rng.choice([1.0, 2.0, 3.0, None]) for _ in range(4)]) for i in range(90)]
    # A third of all samples share three values: one group of 400 genotypes, no two alike.
    return rows + [(1_000 + i, 7.0, 7.0, 7.0, 100.0 + i) for i in range(45)] + [(2_000, 50.0, 51.0, 52.0, 53.0)]


def differing(a, b):
    return sum(x != y for x, y in zip(a[1:], b[1:]))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_neighbours_equal_all_pairs(spark, table, radius):
    got = {r["first_sample"]: r for r in gt.genotype_neighbours(spark.createDataFrame(table, WIDE), MARKERS, radius).collect()}
    firsts = {}
    for row in table:
        firsts.setdefault(row[1:], row)
    assert set(got) == {r[0] for r in firsts.values()}
    for row in firsts.values():
        n = [sum(differing(row, other) == j for other in table) for j in range(5)]
        r = got[row[0]]
        assert r["n"] == n[0] and [r[f"at_{j}"] for j in range(1, radius + 1)] == n[1 : radius + 1] and r["near"] == sum(n[1 : radius + 1])


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_classes_equal_all_pairs(spark, table, radius):
    root = {r[0]: r[0] for r in table}
    for a in table:
        for b in table:
            if differing(a, b) <= radius:
                x, y = sorted((root[a[0]], root[b[0]]))
                root = {k: x if v == y else v for k, v in root.items()}
    want = {(k, v, sum(w == v for w in root.values())) for k, v in root.items()}
    assert {tuple(r) for r in gt.genotype_classes(spark.createDataFrame(table, WIDE), MARKERS, radius).collect()} == want


def test_ties_grow_with_the_genotypes_not_their_pairs(spark):
    rows = [(i, 1.0, 1.0, 1.0, float(i)) for i in range(2_000)]
    masked = gt._masked(gt._distinct_genotypes(spark.createDataFrame(rows, WIDE), MARKERS), MARKERS, [(1,), (2,), (3,), (4,)])
    assert masked.count() == 4 * 2_000
    got = gt.genotype_neighbours(spark.createDataFrame(rows, WIDE), MARKERS, 1)
    assert got.filter(F.col("near") == 1_999).count() == 2_000


def test_radius_and_empty_tables(spark):
    empty = spark.createDataFrame([], WIDE)
    assert gt.genotype_neighbours(empty, MARKERS, 1).count() == 0 and gt.genotype_classes(empty, MARKERS, 2).count() == 0
    for bad in (0, 4):
        with pytest.raises(ValueError):
            gt.genotype_neighbours(empty, MARKERS, bad)


def test_pairwise_distance_deals_pairs_to_tasks(spark):
    """A set of a few kilobytes is not compared in one task; every pair comes once."""
    from itertools import combinations

    rows = [(i, float(i % 3), float(i % 2), float(i % 5)) for i in range(300)] + [(300, None, 1.0, 1.0)]
    wide = spark.createDataFrame(rows, "sample_id bigint, m1 double, m2 double, m3 double")
    got = gt.pairwise_distance(wide, [1, 2, 3])
    per = [n for n in got.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert len(per) > 100 and max(per) < sum(per) / 20
    want = {(a[0], b[0]): sum(x != y for x, y in zip(a[1:], b[1:])) for a, b in combinations(rows[:300], 2)}
    found = got.collect()
    assert len(found) == len(want) and {(r["i"], r["j"]): r["d"] for r in found} == want
    assert all(abs(r["d_norm"] - r["d"] / 3) < 1e-12 for r in found)
