"""Presence masks against plain sets, over more markers than one number holds."""

import random
from dataclasses import replace

import pytest

from tandemlake.model import AnalysisParams
from tandemlake.operators import quality as ql

FACT = "set_id string, sample_id bigint, marker_id bigint, value double, size double, height double, assay_id bigint, peak_type string"
SAMPLE = "sample_id bigint, code string, batch string, country string, level1 string, collection_date date, passive_detection boolean, recurrent boolean"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [
        (f"S{s % 3}", s, m * 7 - 20, 1.0 * v, 1.0, 50.0 + 10 * v, 1, "peak-bin")
        for s in range(60)
        for m in range(130)
        for v in range(rng.randrange(3))
        if rng.random() < (0.95 if s % 5 else 0.3) and (m % 11 or rng.random() < 0.4)
    ]


def has(rows):
    out = {}
    for r in rows:
        out.setdefault((r[0], r[1]), set()).add(r[2])
    return out


def test_filters_and_reports_equal_sets(spark, rows):
    df = spark.createDataFrame(rows, FACT)
    own, every = has(rows), {r[2] for r in rows}
    got = {(r["set_id"], r["sample_id"]): (r["failed"], r["passed"]) for r in ql.sample_quality(df, 0.6).collect()}
    assert got == {k: (len(every - v), len(every - v) <= len(every) - 0.6 * len(every)) for k, v in own.items()}
    lacking = {(r["set_id"], r["sample_id"]): r["failed"] for r in ql.failed_markers(df).collect()}
    assert lacking == {k: sorted(every - v) for k, v in own.items()}
    n = len({k[1] for k in own})
    for r in ql.marker_quality(df, 0.4).collect():
        present = len({k[1] for k, v in own.items() if r["marker_id"] in v})
        assert (r["failed"], r["passed"]) == (n - present, (n - present) / present <= 0.4)
    report = {r["set_id"]: r for r in ql.sample_quality_report(df, 0.6).collect()}
    assert sum(r["samples"] for r in report.values()) == len(own)
    empty = df.limit(0)
    assert ql.sample_quality(empty, 0.5).count() == ql.marker_quality(empty, 0.5).count() == ql.failed_markers(empty).count() == 0


@pytest.mark.parametrize("option", ["A", "S"])
@pytest.mark.parametrize("limits", [(0.5, 0.10), (0.9, 0.5), (0.99, 0.0)])
def test_prepare_equals_sets(spark, rows, option, limits):
    alleles = spark.createDataFrame(rows, FACT).drop("set_id")
    people = [(s, f"c{s}", "b", f"S{s % 3}", None, None, True, False) for s in range(50)]  # the last ten are in no set
    samples = spark.createDataFrame(people, SAMPLE)
    members = samples.selectExpr("0 AS set_id", "sample_id")
    params = replace(AnalysisParams(abs_threshold=55, rel_threshold=0.0, spatial=0, sample_option=option), sample_qual_threshold=limits[0], marker_qual_threshold=limits[1])
    kept, _ = ql.prepare(alleles, members, samples, params)
    facts = [r for r in rows if r[5] > 55 and r[1] < 50]
    every = {r[2] for r in facts}
    own = has(facts)
    good = {k[1] for k, v in own.items() if len(every) - len(v) <= len(every) - limits[0] * len(every)}
    present = {m: len({r[1] for r in facts if r[2] == m and r[1] in good}) for m in every}
    markers = {m for m, c in present.items() if c and (len(good) - c) / c <= limits[1]}
    want = sorted((r[1], r[2], r[3]) for r in facts if r[1] in good and r[2] in markers)
    if option == "S":
        n = {}
        for s, m, _ in want:
            n[s, m] = n.get((s, m), 0) + 1
        several = {s: sum(c > 1 for (t, _), c in n.items() if t == s) for s, _ in n}
        want = [r for r in want if several[r[0]] <= 1]
    assert sorted((r["sample_id"], r["marker_id"], r["value"]) for r in kept.collect()) == want


def test_alleles_with_sets_are_sorted_once(spark):
    """The sets are hashed: a task of dominance holds one sort of the alleles of its samples."""
    from tandemlake.operators import alleles as al
    from tandemlake.plans.queries import facts

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = al.dominant(facts(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin [sample_id" in plan and "SortMergeJoin [sample_id" not in plan
