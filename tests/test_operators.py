import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemlake.functions import scalar, stats
from tandemlake.model import PRESETS, AnalysisParams
from tandemlake.operators import alleles as al
from tandemlake.operators import genotype as gt
from tandemlake.operators import ordering
from tandemlake.operators import peaks as pk
from tandemlake.operators import popgen as pop
from tandemlake.operators import quality as ql
from tandemlake.operators import sets as st
from tandemlake.operators import signal as sg
from tandemlake.operators import store
from tandemlake.operators import summary as sm


def make_alleles(spark, n=600, seed=2):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 4), rng.randint(1, 40), rng.randint(1, 9), float(rng.randint(50, 400)), "peak-bin" if rng.random() < 0.9 else "peak-noise") for _ in range(n)]
    rows = [(m, s, v, v + 0.1, h, s, t) for m, s, v, h, t in rows]
    return spark.createDataFrame(rows, "marker_id bigint, sample_id bigint, value int, size double, height double, assay_id bigint, peak_type string"), rows


def literal_thresholds(rows, absolute, relative, cutoff):
    """The filters one group at a time."""
    out = []
    kept = [r for r in rows if r[4] > absolute]
    for key in {r[:2] for r in kept}:
        group = sorted((r for r in kept if r[:2] == key), key=lambda r: -r[4])
        passing = [r for r in group if r[4] / group[0][4] >= relative]
        if cutoff > 0 and len(passing) > 1 and passing[1][4] / group[0][4] > cutoff:
            continue
        out += passing
    return sorted(out)


@pytest.mark.parametrize("relative,cutoff", [(0.33, 0), (0.33, 0.8), (0.6, 0.7), (0.0, 0.9)])
def test_thresholds_equal_the_literal_loop(spark, relative, cutoff):
    df, rows = make_alleles(spark)
    params = AnalysisParams(abs_threshold=100, rel_threshold=relative, rel_cutoff=cutoff)
    got = sorted(map(tuple, al.thresholds(df, params).collect()))
    assert got == literal_thresholds([r for r in rows if r[6] == "peak-bin"], 100, relative, cutoff)


def test_dominant_keeps_ties(spark):
    df = spark.createDataFrame([(1, 1, 5, 9.0), (1, 1, 6, 9.0), (1, 1, 7, 3.0), (2, 1, 8, 1.0)], "marker_id bigint, sample_id bigint, value int, height double")
    assert sorted(r["value"] for r in al.dominant(df).collect()) == [5, 6, 8]
    wide = gt.genotypes(df.withColumn("set_id", F.lit(0)), [1, 2, 3]).first()
    assert (wide["m1"], wide["m2"], wide["m3"]) == (5.5, 8.0, None)


def test_set_algebra_laws(spark):
    a, b, every = ({1, 2, 3}, {3, 4}, {1, 2, 3, 4, 5})
    df = lambda x: spark.createDataFrame([(i,) for i in sorted(x)], "sample_id bigint")
    ids = lambda d: {r[0] for r in d.collect()}
    samples = df(every)
    assert ids(st.union(df(a), df(b))) == a | b
    assert ids(st.intersection(df(a), df(b))) == a & b
    assert ids(st.exclusive(df(a), df(b))) == a ^ b
    assert ids(st.complement(df(a), samples)) == every - a
    assert ids(st.exclusive(df(a), df(a))) == set()
    with pytest.raises(ValueError):
        st.select_samples(samples.withColumn("recurrent", F.lit(False)), town="kudat")


def test_differentiation(spark):
    rows = [(1, "MALAYSIA", "SABAH", "2001-02-28", True), (2, "MALAYSIA", "SABAH", "2001-03-01", True), (3, "MALAYSIA", "", "2001-12-01", None), (4, "PERU", "LIMA", "2001-09-01", False)]
    samples = spark.createDataFrame(rows, "sample_id bigint, country string, level1 string, d string, passive_detection boolean").withColumn("collection_date", F.to_date("d"))
    members = samples.select(F.lit("mine").alias("set_id"), "sample_id")
    labels = lambda **k: {r["sample_id"]: r["label"] for r in st.differentiate(members, samples, **k).collect()}
    assert set(labels().values()) == {"mine"}
    assert labels(spatial=1) == {1: "MALAYSIA / SABAH", 2: "MALAYSIA / SABAH", 3: "MALAYSIA", 4: "PERU / LIMA"}
    assert labels(spatial=0, temporal=3) == {1: "MALAYSIA | 2001 Q1", 2: "MALAYSIA | 2001 Q2", 3: "MALAYSIA | 2001 Q4", 4: "PERU | 2001 Q4"}
    assert labels(detection=True) == {1: "mine PD", 2: "mine PD", 3: "mine", 4: "mine AD"}


def test_prepare_and_strict(spark):
    df, rows = make_alleles(spark, 500, 4)
    samples = spark.createDataFrame([(i, "A" if i % 3 else "B") for i in range(1, 41)], "sample_id bigint, country string").withColumn("passive_detection", F.lit(None).cast("boolean"))
    samples = samples.withColumn("collection_date", F.lit(None).cast("date"))
    members = samples.select(F.lit(0).alias("set_id"), "sample_id")
    params = AnalysisParams(sample_qual_threshold=0.75, marker_qual_threshold=0.9, spatial=0)
    kept, sets = ql.prepare(df, members, samples, params)
    want = literal_thresholds([r for r in rows if r[6] == "peak-bin"], 100, 0.33, 0)
    good = {s for s in {r[1] for r in want} if len({r[0] for r in want if r[1] == s}) >= 3}
    assert {r["sample_id"] for r in kept.collect()} == good and kept.count() == sum(r[1] in good for r in want)
    strict, _ = ql.prepare(df, members, samples, replace(params, sample_option="S"))
    assert strict.count() < kept.count()


def test_parameters():
    assert AnalysisParams.from_dict({"abs_threshold": "50", "spatial": "2"}) == AnalysisParams(abs_threshold=50.0, spatial=2)
    with pytest.raises(ValueError):
        AnalysisParams(temporal=2)
    with pytest.raises(ValueError):
        AnalysisParams.from_dict({"nothing": 1})
    assert PRESETS["moi"].spatial == 0 and PRESETS["haplotype"].spatial == 4


def test_heterozygosity_bounds_and_single_allele(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (2, 2, 6)], "marker_id bigint, sample_id bigint, value int")
    got = {r["marker_id"]: r["he"] for r in sm.heterozygosity(df).collect()}
    assert got == {1: 0.0, 2: pytest.approx(1.0)}


def test_delta_status(spark):
    df = spark.createDataFrame([(1, v) for v in (10, 11, 14, 15)] + [(2, 7)], "marker_id bigint, value int")
    ok = lambda **k: {(r["marker_id"], r["value"]): r["ok"] for r in sm.delta_status(df, **k).collect()}
    assert ok() == {(1, 10): False, (1, 11): False, (1, 14): False, (1, 15): True, (2, 7): True}
    assert ok(fix_last=True)[1, 15] is False


def test_rank_tests_and_pvalues(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 5.0), ("c", 7.0), ("c", 8.0)]
    got = sm.kruskal(spark.createDataFrame(rows, "g string, v double"), "g", "v").first()
    ranks = {1.0: 1, 2.0: 3, 5.0: 5, 7.0: 6, 8.0: 7}
    s = {g: [ranks[v] for x, v in rows if x == g] for g in "abc"}
    h = 12 / (7 * 8) * sum(sum(v) ** 2 / len(v) for v in s.values()) - 3 * 8
    assert got["h"] == pytest.approx(h / (1 - 24 / (343 - 7))) and got["df"] == 2
    assert stats.chi2_tail(5.991464547, 2) == pytest.approx(0.05, rel=1e-6)
    assert stats.chi2_tail(0.5, 5) == pytest.approx(0.992123, rel=1e-5)
    w = sm.wilcoxon(spark.createDataFrame([(1.0, 2.0), (5.0, 3.0), (4.0, 4.0), (9.0, 1.0)], "a double, b double"), "a", "b").first()
    assert (w["w"], w["n"]) == (1.0, 3)
    assert 0 < stats.wilcoxon_pvalue(1.0, 3) <= 1


def wide_table(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(("x", "y")[i % 2], i, float(rng.randint(1, 3) + i % 2), float(rng.randint(1, 2)), float(rng.randint(1, 4))) for i in range(n)]
    return spark.createDataFrame(rows, "set_id string, sample_id bigint, m1 double, m2 double, m3 double"), rows


def test_fst_and_linkage_equal_pairs(spark):
    df, rows = wide_table(spark)
    diff = lambda a, b: sum(x != y for x, y in zip(a[2:], b[2:]))
    x, y = ([r for r in rows if r[0] == k] for k in "xy")
    s = lambda p, q: sum(diff(a, b) for a in p for b in q)
    within = s(x, x) / (2 * len(x)) + s(y, y) / (2 * len(y))
    total = s(rows, rows) / (2 * len(rows))
    sb = within / (len(rows) - 2)
    sa = (total - within - sb) / (len(rows) - (len(x) ** 2 + len(y) ** 2) / len(rows))
    assert pop.fst(df, [1, 2, 3]).first()["fst"] == pytest.approx(sa / (sa + sb))
    d = np.array([diff(a, b) for i, a in enumerate(x) for b in x[:i]])
    n = len(x)
    h = [n / (n - 1) * (1 - sum((sum(r[k] == v for r in x) / n) ** 2 for v in {r[k] for r in x})) for k in (2, 3, 4)]
    want = (d.var() / sum(v * (1 - v) for v in h) - 1) / 2
    assert {r["set_id"]: r["ia"] for r in pop.linkage(df, [1, 2, 3]).collect()}["x"] == pytest.approx(want)
    p = {r["set_id"]: r["p"] for r in pop.linkage_pvalue(df, [1, 2, 3], rounds=20).collect()}
    assert set(p) == {"x", "y"} and all(0 <= v <= 1 for v in p.values())


def test_linked_loci_are_significant(spark):
    rows = [("x", i, float(i % 4), float(i % 4), float(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "set_id string, sample_id bigint, m1 double, m2 double, m3 double")
    assert pop.linkage(df, [1, 2, 3]).first()["ia"] == pytest.approx(1.0, rel=0.1)
    assert pop.linkage_pvalue(df, [1, 2, 3], rounds=20).first()["p"] == pytest.approx(1 / 21)


def test_mismatch_histogram_counts_pairs(spark):
    df, rows = wide_table(spark, 41, 7)
    counts = [0] * 4
    for i, a in enumerate(rows):
        for b in rows[i:]:
            counts[sum(x != y for x, y in zip(a[2:], b[2:]))] += 1
    got = {r["d"]: r["share"] for r in gt.mismatch_histogram(df, [1, 2, 3]).collect()}
    assert [got.get(k, 0) for k in range(4)] == pytest.approx([c / sum(counts) for c in counts])


def test_neighbour_joining_recovers_an_additive_tree():
    tree = {("a", "u"): 2.0, ("b", "u"): 3.0, ("u", "v"): 4.0, ("c", "v"): 1.5, ("d", "v"): 2.5}

    def far(x, y, seen=()):
        if x == y:
            return 0.0
        for (p, q), w in tree.items():
            for s, t in ((p, q), (q, p)):
                if s == x and t not in seen and (r := far(t, y, (*seen, x))) is not None:
                    return w + r
        return None

    names = ["a", "b", "c", "d"]
    edges = pop.neighbour_joining(names, np.array([[far(x, y) for y in names] for x in names]))
    tips = {c: w for c, _, w in edges if c in names}
    assert tips == pytest.approx({"a": 2.0, "b": 3.0, "c": 1.5, "d": 2.5}, abs=1e-9) or sum(w for *_, w in edges) == pytest.approx(13.0)


def test_principal_components(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ np.diag([5.0, 1.0, 0.1])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "sample_id bigint, m1 double, m2 double, m3 double")
    got = pop.principal_components(df, ["m1", "m2", "m3"]).orderBy("sample_id").toPandas()
    assert abs(np.corrcoef(got["pc1"], x[:, 0])[0, 1]) > 0.99 and got["share1"][0] > 0.9


def test_nearest_bin_and_ties(spark):
    marker = spark.createDataFrame([(1, 3, 10.0, 30.0, [(12.0, 12), (15.0, 15), (18.0, 18)])], "marker_id bigint, repeats int, min_size double, max_size double, bins array<struct<pos:double,tag:int>>")
    sizes = [9.0, 10.0, 10.5, 13.5, 13.6, 16.4, 25.0, 30.0]
    rows = spark.createDataFrame([(1, s, 0, "peak-called") for s in sizes], "marker_id bigint, size double, value int, peak_type string")
    got = {r["size"]: (r["value"], r["peak_type"], r["far"]) for r in pk.bin_alleles(rows, marker).collect()}
    assert got[13.5] == (12, "peak-bin", False) and got[13.6] == (15, "peak-bin", False) and got[25.0] == (18, "peak-bin", True)
    assert got[10.0][1] == got[30.0][1] == got[9.0][1] == "peak-called"


def test_separated_is_the_literal_fold(spark):
    rng = random.Random(6)
    peaks = [(c, t, float(rng.randint(1, 99))) for c in (1, 2) for t in sorted(rng.sample(range(100), 30))]
    got = sorted(map(tuple, pk.separated(spark.createDataFrame(peaks, "channel_id bigint, rtime int, height double"), 4).collect()))
    want = []
    for c in (1, 2):
        own = sorted((p for p in peaks if p[0] == c), key=lambda p: -p[1])
        kept = [own[0]]
        for p in own[1:]:
            last = kept.pop()
            kept += [last, p] if last[1] - p[1] > 4 else [last if last[2] > p[2] else p]
        want += kept
    assert got == sorted(want)


def test_sizing(spark):
    z = [0.0, 0.0, 2.0, 1.0]
    ladders = spark.createDataFrame([(1, z, 10, 400)], "assay_id bigint, z array<double>, first_rtime int, last_rtime int")
    peaks = spark.createDataFrame([(1, t) for t in (10, 30, 100, 350)], "assay_id bigint, rtime int")
    got = {r["rtime"]: (r["size"], r["peak_type"]) for r in pk.size_peaks(peaks, ladders).collect()}
    assert got == {10: (-1.0, "peak-unassigned"), 30: (61.0, "peak-unassigned"), 100: (201.0, "peak-called"), 350: (701.0, "peak-unassigned")}


def test_wavelengths(spark):
    rows = spark.createDataFrame([(300.0, 255), (400.0, 255), (600.0, 255), (450.0, 100), (550.0, 100), (800.0, 100)], "nm double, top int")
    got = [r[0] for r in rows.select(scalar.wavelength_rgb(F.col("nm"), F.col("top"))).collect()]
    assert got == [[0, 0, 0], [131, 0, 181], [255, 190, 0], [0, 28, 100], [64, 100, 0], [0, 0, 0]]


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.ladder_score(F.lit(300.0), F.lit(33), F.lit(36)).alias("score"), scalar.species(F.lit("vivax/falciparum")).alias("s"), scalar.species(F.lit("")).alias("x"),
        scalar.truth(F.lit("yes")).alias("t"), scalar.short_location(F.lit("INDONESIA / EAST NUSA TENGGARA / KUPANG")).alias("short"), scalar.short_location(F.lit("PERU / LIMA")).alias("same"),
    ).first()
    assert row["score"] == pytest.approx(1 - 0.05 - 0.10 - 0.05) and (row["s"], row["x"], row["t"]) == ("falciparum/vivax", "X", True)
    assert (row["short"], row["same"]) == ("IN / ENT / KUPANG", "PERU / LIMA")


def bumps(n=400, at=(60, 150, 290), noise=1.0, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return sum((300.0 - 50 * i) * np.exp(-(((t - a) / 5.0) ** 2) / 2) for i, a in enumerate(at)) + rng.normal(0, noise, n)


def test_smoothing_keeps_polynomials(spark):
    y = [0.01 * t**3 - 0.2 * t**2 + t for t in range(40)]
    df = spark.createDataFrame([(1, [float(v) for v in y]), (2, [1.0, 2.0]), (3, [])], "channel_id bigint, data array<double>")
    got = {r["channel_id"]: r["data"] for r in sg.smooth(df).collect()}
    assert got[1][5:-5] == pytest.approx(y[5:-5], abs=1e-6) and got[2] == [1.0, 2.0] and got[3] == []
    padded = np.concatenate([y[0] - np.abs(np.array(y[1:6][::-1]) - y[0]), y, y[-1] + np.abs(np.array(y[-6:-1][::-1]) - y[-1])])
    want = np.convolve(padded, sg.savgol_weights()[::-1], mode="valid")
    assert got[1] == pytest.approx([*want], abs=1e-6)


def test_top_hat(spark):
    y = np.linspace(5, 9, 100)
    y[50] += 10
    df = spark.createDataFrame([(1, [float(v) for v in y])], "channel_id bigint, data array<double>")
    got = np.array(sg.top_hat(df, 3).first()["data"])
    low = np.array([y[max(0, i - 3) : i + 4].min() for i in range(100)])
    want = y - np.array([low[max(0, i - 3) : i + 4].max() for i in range(100)])
    assert got == pytest.approx(want) and got[50] > 9.5


def test_peak_scan(spark):
    df = spark.createDataFrame([(1, bumps().tolist()), (2, [0.0] * 50)], "channel_id bigint, data array<double>")
    got = sg.scan_peaks(df, sg.ScanParams(min_height=50.0)).collect()
    assert [abs(r["rtime"] - a) <= 2 for r, a in zip(sorted(got), (60, 150, 290))] == [True] * 3 and len(got) == 3
    assert all(r["brtime"] < r["rtime"] < r["ertime"] and r["beta"] > 0 for r in got)


def test_turning_points(spark):
    y = [float(np.sin(t / 5)) for t in range(120)]
    df = spark.createDataFrame([(1, y)], "channel_id bigint, data array<double>")
    got = sg.detect_turning_points(df, 5, 0.1).collect()
    tops, lows = ({r["t"] for r in got if r["kind"] == k} for k in ("max", "min"))
    assert all(y[t] > 0.98 for t in tops) and all(y[t] < -0.98 for t in lows) and len(tops) >= 2 and len(lows) >= 2


def test_ladder_alignment(spark):
    sizes = [50.0, 75, 100, 139, 150, 160, 200, 250, 300, 340, 350, 400]
    times = [int(s * 8 + 300) for s in sizes] + [1000, 1410]
    df = spark.createDataFrame([(1, t, 500.0 if i < 12 else 60.0) for i, t in enumerate(times)], "assay_id bigint, rtime int, height double")
    got = sg.align_ladders(df, sizes).first()
    assert got["rss"] < 1 and np.polyval(got["z"], 300 + 8 * 250) == pytest.approx(250, abs=0.5)


def test_merge_delete_snapshot(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id bigint, name string, n int")
    new = spark.createDataFrame([(2, "", 9), (3, "c", None)], "id bigint, name string, n int")
    assert sorted(map(tuple, store.merge(old, new, ["id"]).collect())) == [(1, "a", 5), (2, "b", 9), (3, "c", None)]
    assert [r["id"] for r in store.insert(old, new, ["id"]).collect()] == [3] and [r["id"] for r in store.existing(old, new, ["id"]).collect()] == [2]
    tables = {
        "sample": old, "assay": spark.createDataFrame([(10, 1), (11, 2)], "assay_id bigint, sample_id bigint"),
        "channel": spark.createDataFrame([(100, 10), (101, 11)], "channel_id bigint, assay_id bigint"),
    }
    left = store.delete(tables, old.filter("id = 1"), [("sample", "id", "assay", "sample_id"), ("assay", "assay_id", "channel", "assay_id")])
    assert [[r[0] for r in left[k].collect()] for k in tables] == [[2], [11], [101]]
    members = spark.createDataFrame([("v1", 1), ("v2", 2)], "uid string, id bigint")
    assert [r["id"] for r in store.snapshot(old, members, "v2", "id").collect()] == [2]


def test_distances_of_all_pairs_by_genotypes(spark):
    rows = [("A", i, *(float(i * k % m) for k, m in ((1, 3), (5, 4), (7, 3)))) for i in range(1, 260)] + [("B", 999, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "set_id string, sample_id bigint, m1 double, m2 double, m3 double")
    of = {r["sample_id"]: r["genotype"] for r in gt.genotype_members(df, [1, 2, 3]).collect()}
    got = gt.genotype_pairs(df, [1, 2, 3]).collect()
    d = {(r["i"], r["j"]): r["d"] for r in got}
    n = {r[k]: r[f"n_{k}"] for r in got for k in "ij"}
    assert len(d) == len(got) and n == {g: sum(x == g for x in of.values()) for g in set(of.values())} and set(of) == set(range(1, 260))
    values = {r[1]: r[2:] for r in rows}
    for a in of:
        for b in range(a + 1, 260):
            i, j = sorted((of[a], of[b]))
            assert (0 if i == j else d[i, j]) == sum(x != y for x, y in zip(values[a], values[b]))


def test_haplotypes_are_numbered_without_one_task_for_all(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 10)
    rows = [("A", i, float(i % 40), float(i % 40)) for i in range(120)] + [("A", 500, 77.0, 1.0)]
    df = spark.createDataFrame(rows, "set_id string, sample_id bigint, m1 double, m2 double")
    found = gt.haplotypes(df, [1, 2])
    assert sorted((r["first_sample"], r["freq"], r["hap_id"]) for r in found.collect()) == [(i, 3, i + 1) for i in range(40)] + [(500, 1, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(range#" in plan  # by ranges, never over all rows


def test_report_tables_shuffle_no_alleles_again(spark):
    """Alleles that a join left by sample are written so; only sums by marker or set are shuffled for the tables."""
    from tandemlake.operators import summary
    from tandemlake.plans.queries import facts

    before = spark.conf.get("spark.sql.adaptive.enabled")
    tables = summary.comprehensive(facts(spark, "/root/testdata/sf0.001"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    plans = {k: t._jdf.queryExecution().executedPlan().toString() for k, t in tables.items()}
    assert len(plans) == 10 and not [k for k, p in plans.items() for line in p.split("\n") if "Exchange hashpartitioning" in line and "sample_id" in line]
    assert tables["marker_summary"].count() == 7 and tables["sample_failures"].count() == 6
