import numpy as np
import pytest

from tandemlake.operators import signal as sg


@pytest.mark.parametrize("seed", range(6))
def test_turning_points_alternate_and_are_extremes(seed):
    rng = np.random.default_rng(seed)
    y, ahead, delta = np.cumsum(rng.normal(size=500)), 6, 1.0
    tops, lows = sg.turning_points(y, ahead, delta)
    kinds = [k for _, k in sorted([(t, "top") for t, _ in tops] + [(t, "low") for t, _ in lows])]
    assert len(kinds) > 4 and all(a != b for a, b in zip(kinds, kinds[1:]))
    for turns, sign in ((tops, 1), (lows, -1)):
        for t, v in turns:
            assert v == y[t]
            fall = next(i for i in range(t + 1, len(y)) if sign * y[i] < sign * v - delta)
            assert (sign * y[t:fall] <= sign * v).all()


def test_turning_points_of_short_and_flat_traces():
    assert sg.turning_points(np.array([1.0, 2.0]), 5, 0.0) == ([], [])
    assert sg.turning_points(np.zeros(50), 5, 0.1) == ([], [])


@pytest.mark.parametrize("length", [1, 2, 3, 63, 64, 65, 300])
def test_flank_stops_where_the_rule_says(length):
    y = 1000 * np.exp(-np.arange(length) / 60.0)
    area, at = sg.flank(y, 5e-2)
    mean = [sum(y[i : i + 3]) / 3 for i in range(length)]
    stops = [i for i in range(length) if not (mean[i] > y[: i + 1].sum() * 2.5e-2 and (i == 0 or mean[i] < mean[i - 1]))]
    assert at == (stops[0] if stops else length - 1) and area == pytest.approx(y[: at + 1].sum())


def test_ridges_of_clean_bumps():
    t = np.arange(5000)
    y = sum(h * np.exp(-(((t - a) / 6.0) ** 2) / 2) for a, h in ((600, 300.0), (2500, 80.0), (4100, 200.0)))
    found = sg.wavelet_peaks(y + np.random.default_rng(1).normal(0, 0.5, 5000), range(5, 15), 2.5)
    assert all(min(abs(f - a) for f in found) <= 2 for a in (600, 2500, 4100))


def test_no_more_peaks_than_asked_for(spark):
    t = np.arange(12000)
    y = sum((10.0 + 3 * i) * np.exp(-(((t - 520 * i - 300) / 4.0) ** 2) / 2) for i in range(22))
    df = spark.createDataFrame([(1, y.tolist())], "channel_id bigint, data array<double>")
    every = sorted(r["height"] for r in sg.scan_peaks(df, sg.ScanParams(max_peaks=0)).collect())
    got = sorted(r["height"] for r in sg.scan_peaks(df, sg.ScanParams(max_peaks=15)).collect())
    low = next(x for x in range(1, 101) if sum(h > x for h in every) <= 15)
    assert len(every) > 15 and got == [h for h in every if h > low]


def test_statistics_of_edge_traces(spark):
    df = spark.createDataFrame([(1, [4.0, 1.0, 3.0, 2.0]), (2, [5.0]), (3, []), (4, None)], "channel_id bigint, data array<double>")
    got = {r["channel_id"]: r for r in sg.channel_stats(df).collect()}
    assert set(got) == {1, 2} and tuple(got[1])[1:] == pytest.approx((2.5, 2.5, 1.0, 4.0, np.std([1, 2, 3, 4]))) and got[2]["median"] == 5.0
    assert [tuple(r) for r in sg.local_maxima(df, 0.0).collect()] == [(1, 2, 3.0)]


def test_tenths_are_percentiles(monkeypatch):
    rng = np.random.default_rng(4)
    gaps = rng.normal(size=400)
    gaps[200] = np.nan
    for y in (rng.normal(size=400), rng.integers(0, 4, 400).astype(float), gaps):
        for n in (1, 2, 3, 5, 10, 11, 15, 16, 120, 399, 400):
            begins = rng.integers(0, 400 - n + 1, 5)
            ends = np.minimum(begins + n + np.arange(5) % 2, 400)  # of two lengths
            want = [np.percentile(y[b:e], 10) for b, e in zip(begins, ends)]
            assert np.array_equal(sg.tenths(y, begins, ends), want, equal_nan=True)
    # The noise of a trace's many ridges takes no call for each window.
    wave = 0.3 * np.sin(np.arange(4_800) * 0.9)
    monkeypatch.setattr(np, "percentile", None)
    assert sg.wavelet_peaks(wave + 50 * np.exp(-(((np.arange(4_800) - 2_000) / 4) ** 2) / 2), range(5, 15), 2.5)
