import random
import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemlake.model import LADDERS
from tandemlake.operators import assay as asy
from tandemlake.operators import ladder as ld
from tandemlake.operators import peaks as pk

LIZ = list(map(float, LADDERS["LIZ500"]))


def place(size):
    return int(round(8 * size + 300))


def trace(peaks, n=4700, seed=0, noise=1.0):
    """A trace with a bump of a height at each size."""
    t = np.arange(n)
    y = np.random.default_rng(seed).normal(0, noise, n)
    for size, height in peaks:
        y += height * np.exp(-(((t - place(size)) / 5.0) ** 2) / 2)
    return y.tolist()


def test_ladder_is_found_among_noise_peaks():
    rng = np.random.default_rng(2)
    times = np.array([place(s) for s in LIZ] + [700, 1500, 3333], float)
    heights = np.array([*rng.uniform(400, 900, len(LIZ)), 60.0, 80.0, 50.0])
    order = np.argsort(times)
    fit = ld.fit_ladder(LIZ, times[order], heights[order])
    assert len(fit.pairs) == len(LIZ) and fit.rss < 1 and fit.dpscore > 0.9 * len(LIZ)
    assert all(times[order][j] == place(s) for s, j in fit.pairs)
    assert np.polyval(fit.z, place(212.0)) == pytest.approx(212, abs=0.3)


def test_ladder_that_is_not_there():
    assert ld.fit_ladder(LIZ, np.array([]), np.array([])).report.startswith("Not enough initial signals")
    few = ld.fit_ladder(LIZ, np.array([100.0, 200.0, 300.0]), np.array([50.0, 60.0, 70.0]))
    assert few.z == [] and few.report.startswith("Not enough filtered peaks")


def test_match_is_the_best_of_all_alignments():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n, m = rng.integers(1, 5, 2)
        s, gap = rng.uniform(0, 1, (n, m)), -0.05

        def best(i, j):
            """Every way to go on from the corner."""
            if i == 0 or j == 0:
                return 0.25 * gap if i else 0.0
            return max(best(i - 1, j - 1) + s[i - 1, j - 1], best(i - 1, j) + (0.25 if j == m else 1) * gap, best(i, j - 1))

        score, pairs = ld.match(s, gap)
        assert score == pytest.approx(best(n, m))
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))


def test_candidate_sets_and_separation():
    heights = np.array([5.2, 9.0, 9.5, 30.0, 31.0, 2.0])
    sets = ld.candidate_sets(heights, 3)
    assert [(h, p.tolist()) for h, p in sets] == [(2.0, [0, 1, 2, 3, 4, 5]), (5.0, [0, 1, 2, 3, 4]), (9.0, [1, 2, 3, 4]), (30.0, [3, 4])]
    kept = ld.separate(np.array([10.0, 12.0, 30.0, 33.0, 50.0]), np.array([5.0, 9.0, 4.0, 4.0, 1.0]), 4.0)
    assert kept.tolist() == [4, 2, 1]
    assert ld.assign_nearest([100, 200, 210], np.array([9.0, 21.0]), np.array([10.0, 20.0, 21.5])) == [(100.0, 0), (210.0, 1)]


@pytest.fixture(scope="module")
def run(spark):
    """Two assays: a sound one with peaks, stutter, overlap and a broad channel, and one without a ladder."""
    ladder = [(s, 600.0) for s in LIZ]
    channels = [
        (1, 10, "LIZ", trace(ladder, seed=1)),
        (1, 11, "6-fam", trace([(212, 900), (215, 700), (216.0, 250), (560, 400), (30, 500)], seed=2)),
        (1, 12, "VIC", trace([(240.0, 300.0), (301, 500)], seed=3)),
        (1, 13, "NED", trace([(240.2, 900.0)], seed=4)),
        (1, 14, "PET", trace([(150, 500)], seed=5)),
        (2, 20, "LIZ", trace([(100, 500)], seed=6)), (2, 21, "6-FAM", trace([(212, 900)], seed=7)),
        (3, 30, "LIZ", trace(ladder, seed=8)), (3, 31, "VIC", trace([(243, 700)], seed=9)),
    ]
    df = spark.createDataFrame(channels, "assay_id bigint, channel_id bigint, dye string, data array<double>")
    # A channel's signal leaks into another one where the higher peak stands.
    leak = F.when(F.col("channel_id") == 12, F.transform("data", lambda y, i: y + F.when(F.abs(i - place(240.2)) < 2, 400.0).otherwise(0.0))).otherwise(F.col("data"))
    df = df.withColumn("data", leak)
    assays = spark.createDataFrame([(1, "P", None), (2, "P", None), (3, "P", ["m2"])], "assay_id bigint, panel string, exclude array<string>")
    panels = spark.createDataFrame([("P", "LIZ500", m, d) for m, d in (("M1", "6-FAM"), ("M2", "VIC"), ("M3", "NED"))], "panel string, ladder string, marker string, dye string")
    bins = [(float(x), x) for x in range(200, 320, 3)]
    markers = spark.createDataFrame([(i, f"M{i}", 3, 190.0, 330.0, bins) for i in (1, 2, 3)], "marker_id bigint, code string, repeats int, min_size double, max_size double, bins array<struct<pos:double,tag:int>>")
    out = asy.process(df, assays, panels, asy.ladder_table(spark), markers)
    return {k: v.cache() for k, v in out.items()} | {"markers": markers}


def test_channels_get_markers(run):
    got = {r["channel_id"]: (r["status"], r["marker"], r["sizes"] is not None) for r in run["channels"].collect()}
    assert got[10] == ("channel-ladder", "undefined", True) and got[11] == ("channel-clean", "M1", False)
    assert got[14] == ("channel-unassigned", "undefined", False) and got[31] == ("channel-unassigned", "undefined", False)


def test_ladders_are_scored(run):
    got = {r["assay_id"]: r for r in run["ladders"].collect()}
    assert got[1]["score"] >= 0.95 and got[1]["used"] == len(LIZ) and "Height" in got[1]["report"]
    assert got[2]["score"] == 0 and got[2]["z"] is None and got[2]["rss"] == -1
    assert (got[1]["first_rtime"], got[1]["last_rtime"]) == pytest.approx((place(LIZ[0]), place(LIZ[-1])), abs=2)
    again = asy.refit(run["ladders"].select("assay_id", F.explode("peaks").alias("p")).select("assay_id", "p.*"), run["ladders"]).collect()
    assert {r["assay_id"] for r in again} == {1, 3} and all(r["rss"] == pytest.approx(got[r["assay_id"]]["rss"], abs=1e-6) for r in again)


def near(rows, size):
    return min(rows, key=lambda r: abs(r["rtime"] - place(size)))


def test_peaks_are_called_checked_and_binned(run):
    rows = run["peaks"].collect()
    assert {r["assay_id"] for r in rows} == {1, 3}  # assay 2 failed
    of = lambda c: [r for r in rows if r["channel_id"] == c]
    assert (near(of(11), 212)["value"], near(of(11), 212)["peak_type"]) == (212, "peak-bin")
    assert near(of(11), 212)["size"] == pytest.approx(212, abs=0.5)
    assert near(of(11), 560)["peak_type"] == near(of(11), 30)["peak_type"] == "peak-unassigned"
    assert near(of(13), 240.2)["peak_type"] == "peak-bin" and near(of(12), 301)["value"] in (299, 302)
    assert all(r["peak_type"] in ("peak-called", "peak-unassigned") for r in of(31))  # an excluded marker has no bins


def test_hidden_peaks(spark):
    """A lower peak is hidden where it is lower than the other channel's signal at its time."""
    y = np.zeros(100)
    high, low = y.copy(), y.copy()
    high[40:60], low[45] = 50.0, 30.0
    channels = spark.createDataFrame([(1, 1, high.tolist()), (1, 2, low.tolist()), (1, 3, y.tolist())], "assay_id bigint, channel_id bigint, data array<double>")
    rows = [(1, 1, 1, 50, 40, 60, 50.0), (2, 1, 2, 45, 43, 47, 30.0), (3, 1, 3, 61, 58, 64, 20.0), (4, 2, 9, 50, 40, 60, 1.0)]
    peaks = spark.createDataFrame(rows, "peak_id bigint, assay_id bigint, channel_id bigint, rtime int, brtime int, ertime int, height double")
    assert sorted(r[0] for r in pk.overlaps(peaks).collect()) == [2, 3]
    assert [r[0] for r in pk.overlaps(peaks, channels).collect()] == [2]


def made_peaks(rng, n, wide=0):
    """Peaks of 4 assays of 5 channels, `wide` of them over the whole trace."""
    rows = []
    for i in range(n):
        b = rng.randrange(8 * n)
        width = 10 * n if i < wide else rng.choice([0, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33])
        rows.append((i, i % 4, 100 * (i % 4) + rng.randrange(5), b, 0 if i < wide else b, b + width, float(rng.randrange(40))))
    return rows


PEAK = "peak_id bigint, assay_id bigint, channel_id bigint, rtime int, brtime int, ertime int, height double"


def test_overlaps_of_peaks_of_all_widths(spark):
    rng = random.Random(5)
    for n, wide in ((60, 0), (60, 3), (25, 25), (1, 1)):
        rows = made_peaks(rng, n, wide) + [(999, 0, 0, 5, 9, 4, 1.0)]  # an interval that ends before it begins
        want = {x[0] for x in rows for y in rows if x[1] == y[1] and x[2] != y[2] and x[4] < y[5] and y[4] < x[5] and x[6] < y[6]}
        assert {r[0] for r in pk.overlaps(spark.createDataFrame(rows, PEAK)).collect()} == want
    assert pk.overlaps(spark.createDataFrame([], PEAK)).count() == 0


def test_a_wide_peak_makes_no_other_peaks_meet(spark):
    met = {}
    for n in (500, 2_000):
        for wide in (0, 2):
            met[n, wide] = pk.overlapping_pairs(spark.createDataFrame(made_peaks(random.Random(6), n, wide), PEAK)).count()
    assert met[2_000, 0] < 6 * met[500, 0]
    # What one wide peak adds is what it covers: the other peaks of its assay.
    assert met[500, 2] - met[500, 0] <= 2 * 500 and met[2_000, 2] - met[2_000, 0] <= 2 * 2_000


def most_rows(df):
    """The most rows that a step of the plan made."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        found = node.metrics().get("numOutputRows")
        if found.isDefined():
            most = max(most, found.get().value())
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_many_peaks_of_one_time_do_not_meet_each_other(spark):
    peaks = spark.range(600).selectExpr("id AS peak_id", "0L AS assay_id", "id AS channel_id", "5 AS rtime", "4 AS brtime", "6 AS ertime", "CAST(id AS double) AS height", "5.0d AS size")
    channels = peaks.filter("channel_id < 300").selectExpr("assay_id", "channel_id", "array_repeat(1000.0d, 10) AS data")
    for found, n in ((pk.overlaps(peaks), 599), (pk.overlaps(peaks, channels), 300), (pk.band_overlaps(peaks), 599)):
        assert found.count() == n and most_rows(found) <= 10 * 600


def test_overlaps_with_signal_of_dense_peaks(spark):
    rng = random.Random(3)
    for n, length in ((60, 40), (120, 12)):
        rows = []
        for i in range(n):
            t = rng.randrange(length)
            rows.append((i, i % 2, 10 * (i % 2) + rng.randrange(4), t, t - rng.choice([0, 0, 1, 2]), t + rng.choice([0, 1, 1, 2, 3, 20]) - rng.choice([0] * 19 + [8]), float(rng.randrange(15))))
        data = {c: [float(rng.randrange(20)) for _ in range(rng.choice([length, length // 2]))] for c in (0, 1, 2, 10, 11, 12, 13)}
        at = lambda c, t: data[c][t] if c in data and t < len(data[c]) else -1.0
        want = {
            x[0] for x in rows for y in rows
            if x[1] == y[1] and x[2] != y[2] and x[4] < y[5] and y[4] < x[5] and x[6] < y[6] and (x[6] < at(y[2], x[3]) or y[6] < at(x[2], y[3]))
        }
        channels = spark.createDataFrame([(c // 10, c, v) for c, v in data.items()], "assay_id bigint, channel_id bigint, data array<double>")
        assert {r[0] for r in pk.overlaps(spark.createDataFrame(rows, PEAK), channels).collect()} == want


def test_gates_by_score(spark):
    ladders = spark.createDataFrame([(1, 0.95), (2, 0.7), (3, 0.3)], "assay_id bigint, score double").withColumn("z", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    ladders = ladders.withColumn("first_rtime", F.lit(0)).withColumn("last_rtime", F.lit(1000))
    rows = [(10 * a + i, a, a, "M", t, t - 2, t + 2, h, "peak-scanned") for a in (1, 2, 3) for i, (t, h) in enumerate(((200, 90.0), (201, 30.0)))]
    peaks = spark.createDataFrame(rows, "peak_id bigint, assay_id bigint, channel_id bigint, marker string, rtime int, brtime int, ertime int, height double, peak_type string")
    called = asy.call_peaks(peaks, ladders)
    got = {r["peak_id"]: r["peak_type"] for r in called.collect()}
    assert got == {10: "peak-called", 11: "peak-stutter", 20: "peak-called", 21: "peak-stutter", 30: "peak-scanned", 31: "peak-scanned"}
    plain = peaks.withColumn("peak_type", F.lit("peak-called")).withColumn("size", F.col("rtime").cast("double"))
    channels = spark.createDataFrame([], "assay_id bigint, channel_id bigint, data array<double>")
    checked = {r["peak_id"]: r["peak_type"] for r in asy.check_peaks(plain, channels, ladders).collect()}
    assert checked == {10: "peak-called", 11: "peak-stutter"} | {i: "peak-called" for i in (20, 21, 30, 31)}


def test_batch_verbs(spark):
    peaks = spark.createDataFrame([(1, 1, "M", 5, "peak-bin"), (2, 1, "M", 6, "peak-bin"), (3, 2, "N", 5, "peak-called")], "peak_id bigint, assay_id bigint, marker string, value int, peak_type string")
    types = lambda df: [r["peak_type"] for r in df.orderBy("peak_id").collect()]
    assert types(asy.set_types(peaks, ["M", "N"], [5], "peak-noise")) == ["peak-noise", "peak-bin", "peak-noise"]
    assert types(asy.set_types(peaks, ["M", "N"], [5], "peak-noise", "peak-bin")) == ["peak-noise", "peak-bin", "peak-called"]
    assert [r["peak_id"] for r in asy.reset(peaks, spark.createDataFrame([(1,)], "assay_id bigint")).collect()] == [3]
    assert types(asy.accept(spark.createDataFrame([(1, -1), (2, 4)], "peak_id bigint, value int"))) == ["peak-noise", "peak-uncalled"]
    lines = spark.createDataFrame([("a.fsa",), ("b.fsa",), ("a.fsa",)], "fsa_file string")
    assert [tuple(r) for r in asy.repeated_files(lines).collect()] == [("a.fsa", 2)]
    assays = spark.createDataFrame([(1, "B1", "s1", "P"), (2, "B1", "s2", "Q"), (3, "B2", "s1", "P")], "assay_id bigint, batch string, sample string, panel string")
    assert [r[0] for r in asy.by_keys(assays, batch="B1", panel=["P", "Q"], sample=None).orderBy("assay_id").collect()] == [1, 2]
    with pytest.raises(ValueError):
        asy.by_keys(assays, town="x")
    got = spark.range(1).select(asy.series_bins(232).alias("b")).first()["b"]
    assert [b["tag"] for b in got] == list(range(202, 400, 3)) and got[0]["pos"] == 202.0


def test_traces_are_dealt_to_tasks(spark):
    from tandemlake.plans.assays import run_traces

    channels = run_traces(spark, "/root/testdata/sf0.001")[0]
    assert channels.rdd.getNumPartitions() >= 4 and {r[0] for r in channels.selectExpr("size(data)").collect()} == {4_800}


def test_ladders_are_aligned_together():
    """Alignments that go on together are those of each alone, whatever the widths; sets of the same peaks are fitted once."""
    rng = np.random.default_rng(5)
    tables = [rng.random((6, m)) for m in (4, 9, 6, 1)]
    wide = np.zeros((4, 6, 9))
    for k, t in enumerate(tables):
        wide[k, :, : t.shape[1]] = t
    scores, pairs = ld.match_all(wide, np.array([t.shape[1] for t in tables]), -0.005)
    assert [(s, p) for s, p in zip(scores.tolist(), pairs)] == [ld.match(t, -0.005) for t in tables]
    sizes, times, heights = np.arange(58.0, 9, -3), np.arange(400.0, 100, -12), rng.uniform(50, 90, 25)
    starts = [(times[:n], heights[:n], p) for n in (17, 20, 25) for p in ld.first_pairs(sizes, times[:n])]
    alone = [ld.align_all(sizes, [s])[0] for s in starts]
    for (a, b, z, p), (c, d, y, q) in zip(ld.align_all(sizes, starts), alone):
        assert (a, b, p) == (c, d, q) and z.tolist() == y.tolist()
    for k in (3, 4, 9, 17):
        t, y = np.sort(rng.uniform(0, 300, k))[::-1], rng.uniform(0, 60, k)
        z, rss = ld.cubic(y, t)
        want = np.polyfit(t, y, min(3, k - 1))
        assert z[4 - len(want) :].tolist() == want.tolist() and rss == ((np.polyval(z, t) - y) ** 2).sum()


def test_a_run_writes_no_traces(spark):
    """Neither shuffles nor checkpoints hold traces: a run writes little beside their size."""
    from pathlib import Path

    from tandemlake.plans.assays import assay_run
    from tandemlake.storage import cut

    cut(spark.range(1))  # sets the checkpoint folder
    context = spark.sparkContext._jsc.sc()
    folder = Path(context.getCheckpointDir().get().removeprefix("file:"))

    def written():
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}, sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())

    (stages, files), traces = written(), 10 * 3 * 4_800 * 8
    assert assay_run(spark, "/root/testdata/sf0.001").count() > 0
    after, more = written()
    assert sum(n for k, n in after.items() if k not in stages) + more - files < traces / 4


def test_one_reading_finds_what_the_steps_find(spark, run):
    """The channels of an assay scanned together give the ladders, peaks and overlaps of the steps one by one."""
    channels = run["channels"]
    scanned = asy.scan_assays(channels.repartition(3)).cache()
    ladders, peaks = asy.scanned_ladders(scanned), asy.scanned_peaks(scanned)
    text = lambda df: sorted(str(r) for r in df.collect())
    fits = asy.scan_ladders(channels).cache()
    steps = asy.scan_channels(channels, fits).cache()
    assert text(ladders) == text(fits) and text(peaks) == text(steps) and peaks.columns == steps.columns
    signals = scanned.select("assay_id", F.inline("signals"))
    assert text(pk.overlaps(peaks, signals)) == text(pk.overlaps(steps, channels)) != []
    # An assay that goes on in the next batch, and more channels than a batch holds.
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for n in ("1", "2", "4"):
        spark.conf.set(name, n)
        try:
            parts = asy.scan_assays(channels.coalesce(1)).cache()
            assert [text(parts.select("assay_id", F.inline(c))) for c in parts.columns[1:]] == [text(scanned.select("assay_id", F.inline(c))) for c in parts.columns[1:]]
        finally:
            spark.conf.unset(name)


def test_scores_of_one_fit(spark):
    rows = [(r, u, n) for r in (-1.0, 0.0, 0.1, 50.0, 51.0, 255.0, 256.0, 1024.0, 2000.0, float("nan")) for u, n in ((36, 36), (35, 36), (30, 36), (0, 36), (37, 36))]
    got = spark.createDataFrame(rows, "rss double, used int, n int").select("*", asy.ladder_score(F.col("rss"), F.col("used"), F.col("n")).alias("score")).collect()
    assert [r["score"] for r in got] == [ld.fit_score(r["rss"], r["used"], r["n"]) for r in got]


def test_odd_traces_are_scanned_together(spark):
    """Missing, empty and gappy traces, channels of an unknown assay, a dye with two markers."""
    low = trace([(100, 500), (240.0, 300.0)], seed=3)
    low[place(240.2) - 2 : place(240.2) + 3] = [None] * 5
    ladder = trace([(s, 600.0) for s in LIZ], seed=1)
    rows = [
        (1, 10, "channel-ladder", "undefined", LIZ, ladder), (1, 11, "channel-clean", "M1", None, None), (1, 12, "channel-clean", "M2", None, []),
        (1, 13, "channel-clean", "M3", None, trace([(240.2, 900.0)], seed=4)), (1, 13, "channel-clean", "M4", None, trace([(240.2, 900.0)], seed=4)), (1, 14, "channel-clean", "M5", None, trace([(200, 800.0)], n=2_100, seed=4)),
        (1, 15, "channel-clean", "M6", None, low),
        (2, 20, "channel-ladder", "undefined", LIZ, None), (2, 21, "channel-clean", "M1", None, low), (None, 30, "channel-unassigned", "undefined", None, low),
    ]
    channels = spark.createDataFrame(rows, "assay_id bigint, channel_id bigint, status string, marker string, sizes array<double>, data array<double>")
    scanned = asy.scan_assays(channels).cache()
    fits = {r["channel_id"]: r for r in asy.scanned_ladders(scanned).collect()}
    assert set(fits) == {10, 20} and fits[10]["score"] > 0.9 and fits[20]["z"] is None and fits[20]["score"] == 0
    peaks = asy.scanned_peaks(scanned).collect()
    assert {(r["channel_id"], r["marker"]) for r in peaks} == {(13, "M3"), (13, "M4"), (14, "M5"), (15, "M6")}
    assert len({(r["peak_id"], r["marker"]) for r in peaks}) == len(peaks)
    levels = {r["channel_id"]: r["levels"] for r in scanned.select(F.inline("signals")).collect()}
    times = {r["rtime"] for r in peaks}
    assert set(levels) == {13, 14, 15} and set(levels[13]) == times and set(levels[14]) == {t for t in times if t < 2_100} != times
    assert all(levels[13][t] == rows[3][5][t] for t in times)
    assert levels[15] == {t: low[t] for t in times if low[t] is not None} and len(levels[15]) < len(times)
