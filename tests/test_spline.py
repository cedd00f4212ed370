"""Smoothing splines against their own normal equations, and Gaussian fits against made peaks."""

import numpy as np
import pytest

from tandemlake.operators import signal as sg
from tandemlake.operators import spline as sp


def ladder(seed, noise=0.6, n=20):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.uniform(0, 1, n))
    return x, 100 + 300 * x + 20 * np.sin(7 * x) + rng.normal(0, noise, n)


@pytest.mark.parametrize("seed", range(6))
def test_normal_equations_and_bound(seed):
    x, y = ladder(seed)
    knots, c, p = sp.smoothing_spline(x, y)
    b, d = sp.basis(knots, x), sp.jumps(knots)
    assert abs(((y - b @ c) ** 2).sum() - sp.RESIDUALS) <= sp.CLOSE * sp.RESIDUALS and np.isfinite(p)
    # The coefficients solve the normal equations of residuals and weighted jumps.
    left, right = (b.T @ b + d.T @ d / p) @ c, b.T @ y
    assert np.allclose(left, right, rtol=1e-6, atol=1e-6 * np.abs(right).max())
    # With one knot fewer in the way it was built, the bound can't be met without roughness.
    assert len(knots) > 2 * sp.DEGREE + 2


def test_jumps_by_differences():
    knots = np.array([0, 0, 0, 0, 0.3, 0.5, 1, 1, 1, 1])
    h, found = 1e-2, sp.jumps(knots)
    value = lambda t: sp.basis(knots, np.array([t]))[0]
    third = lambda t: (value(t + 1.5 * h) - 3 * value(t + 0.5 * h) + 3 * value(t - 0.5 * h) - value(t - 1.5 * h)) / h**3
    for row, t in zip(found, (0.3, 0.5)):
        assert np.allclose(third(t + 2 * h) - third(t - 2 * h), row, rtol=1e-3, atol=1e-2)


def test_cubics_and_exact_splines():
    x, y = ladder(1)
    knots, _, p = sp.smoothing_spline(x, 5 + x**3)
    assert len(knots) == 8 and np.isinf(p)  # a cubic needs no knots
    knots, c, _ = sp.smoothing_spline(x, y, 1e-9)
    assert np.abs(sp.basis(knots, x) @ c - y).max() < 1e-4
    assert np.allclose(sp.basis(knots, np.linspace(x[0], x[-1], 50)).sum(axis=1), 1)


def test_sizes_of_assays(spark):
    rows, want = [], {}
    for assay in range(3):
        x, y = ladder(assay)
        times = np.round(1000 + 8000 * x)
        rows.append((assay, times.tolist(), y.tolist()))
        z = (times - times[0]) / (times[-1] - times[0])
        knots, c, _ = sp.smoothing_spline(z, y)
        want[assay] = (times, knots, c)
    rows += [(7, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), (8, None, None), (9, [5.0, 5.0, 6.0, 7.0, 8.0, None], [1.0, 3.0, 3.0, 4.0, 5.0, 6.0])]
    ladders = spark.createDataFrame(rows, "assay_id bigint, rtimes array<double>, sizes array<double>")
    peaks = spark.createDataFrame([(i, a, t, 0.0) for i, (a, t) in enumerate((a, t) for a in (0, 1, 2, 7, 8, 9) for t in (0, 5, 1900, 3333, 6000, 20_000))], "peak_id bigint, assay_id bigint, rtime int, size double")
    got = {(r["assay_id"], r["rtime"]): r["size"] for r in sp.size_by_spline(peaks, ladders).collect()}
    assert {a for a, _ in got} == {0, 1, 2, 9} and len(got) == 24
    for (a, t), size in got.items():
        if a == 9:
            assert size == -1.0 if t in (0, 5, 1900, 3333, 6000, 20_000) else True
            continue
        times, knots, c = want[a]
        if not times[0] < t < times[-1]:
            assert size == -1.0
        else:
            assert size == pytest.approx(float((sp.basis(knots, np.array([(t - times[0]) / (times[-1] - times[0])])) @ c)[0]), abs=1e-6)


def test_gaussian_fits(spark):
    x = np.arange(60)
    traces, peaks, want = [], [], {}
    for k, (centre, sigma, top) in enumerate([(30.3, 2.0, 500.0), (10.0, 1.2, 80.0), (1.4, 2.5, 90.0), (58.9, 3.0, 40.0)]):
        traces.append((k, (top * np.exp(-((x - centre) ** 2) / (2 * sigma**2))).tolist()))
        peaks.append((k, round(centre)))
        want[k] = (centre, sigma, top)
    traces += [(10, [1.0] * 9), (11, [0.0, 5.0, -1.0, 0.0, 0.0, 0.0]), (12, [9.0, 1.0, 9.0, 1.0, 9.0])]
    peaks += [(10, 4), (11, 1), (12, 1), (12, 99), (99, 3)]
    got = {(r["channel_id"], r["rtime"]): r for r in sg.peak_fits(spark.createDataFrame(traces, "channel_id bigint, data array<double>"), spark.createDataFrame(peaks, "channel_id bigint, rtime int")).collect()}
    for k, (centre, sigma, top) in want.items():
        r = got[k, round(centre)]
        assert (r["centre"], r["sigma"], r["top"]) == pytest.approx((centre, sigma, top), rel=1e-6)
    assert got[1, 10]["n"] == 7 and got[2, 1]["n"] == 5 and got[12, 99]["n"] == 0
    assert all(got[k]["centre"] is None for k in ((10, 4), (11, 1), (12, 99))) and (99, 3) not in got
