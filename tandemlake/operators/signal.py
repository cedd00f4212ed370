"""Traces: smoothing, baseline, peak scan and ladders. A trace row has channel_id and data (array<double>)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .ladder import fit_ladder


@dataclass(frozen=True)
class ScanParams:
    widths: tuple[int, ...] = tuple(range(5, 15))
    min_snr: float = 2.5
    min_height: float = 0.0
    min_relative_ratio: float = 0.0
    max_relative_ratio: float = 0.0
    min_height_ratio: float = 0.0
    max_peaks: int = 15
    max_beta: float = 17.0
    ignored: tuple[int, ...] = ()


def savgol_weights(window: int = 11, order: int = 7, deriv: int = 0) -> list[float]:
    """Weights of the least-squares polynomial's value (or derivative) in the middle of a window."""
    half = window // 2
    powers = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
    factor = float(np.prod(np.arange(1, deriv + 1))) if deriv else 1.0
    return (np.linalg.pinv(powers)[deriv] * factor).tolist()


def weighted(traces: DataFrame, weights: list[float]) -> DataFrame:
    """Moving weighted sums of the data, the ends mirrored through their points; shorter traces stay as they are."""
    half, data = len(weights) // 2, F.col("data")
    n = F.size(data)
    first, last = F.element_at(data, 1), F.element_at(data, -1)
    head = F.transform(F.reverse(F.slice(data, 2, half)), lambda x: first - F.abs(x - first))
    tail = F.transform(F.reverse(F.slice(data, n - half, half)), lambda x: last + F.abs(x - last))
    wide = traces.withColumn("_wide", F.when(n > half, F.concat(head, data, tail)))

    def at(_: Column, i: Column) -> Column:
        terms = [F.get("_wide", i + k) * w for k, w in enumerate(weights)]
        return sum(terms[1:], terms[0])

    return wide.withColumn("data", F.when(F.col("_wide").isNotNull(), F.transform(data, at)).otherwise(data)).drop("_wide")


def smooth(traces: DataFrame, window: int = 11, order: int = 7) -> DataFrame:
    return weighted(traces, savgol_weights(window, order))


def hanning_weights(window: int = 11) -> list[float]:
    w = np.hanning(window)
    return (w / w.sum()).tolist()


def hanning(traces: DataFrame, window: int = 11) -> DataFrame:
    return weighted(traces, hanning_weights(window))


#: Weights of a window of a length, by name.
WINDOWS = {"flat": np.ones, "hanning": np.hanning, "hamming": np.hamming, "bartlett": np.bartlett, "blackman": np.blackman}


def window_smooth(traces: DataFrame, window: int = 11, name: str = "hanning") -> DataFrame:
    """Moving weighted means over the data with both ends reflected: window - 1 points more than the data.

    Windows below 3, and traces shorter than the window, leave the data as they are.
    """
    if name not in WINDOWS:
        raise ValueError(f"unknown window {name}: one of {sorted(WINDOWS)}")
    if window < 3:
        return traces
    w, data = WINDOWS[name](window), F.col("data")
    w = (w / w.sum()).tolist()
    wide = F.concat(F.reverse(F.slice(data, 2, window - 1)), data, F.reverse(F.slice(data, F.size(data) - window + 2, window - 1)))
    moved = traces.withColumn("_wide", F.when(F.size(data) >= window, wide))

    def at(i: Column) -> Column:
        terms = [F.get("_wide", i + k) * x for k, x in enumerate(w)]
        return sum(terms[1:], terms[0])

    places = F.sequence(F.lit(0), F.size(data) + window - 2)
    return moved.withColumn("data", F.when(F.col("_wide").isNotNull(), F.transform(places, at)).otherwise(data)).drop("_wide")


def top_hat(traces: DataFrame, half: int) -> DataFrame:
    """data less its opening over 2 * half + 1 points (cut off at the ends): the widest minima, then their maxima."""

    def moving(pick):
        def of(data: Column) -> Column:
            return F.transform(data, lambda _, i: pick(F.slice(data, F.greatest(i - half, F.lit(0)) + 1, F.least(i, F.lit(half)) + half + 1)))

        return of

    eroded = traces.withColumn("_low", moving(F.array_min)(F.col("data"))).withColumn("_open", moving(F.array_max)(F.col("_low")))
    return eroded.withColumn("data", F.zip_with("data", "_open", lambda x, o: x - o)).drop("_low", "_open")


def channel_stats(traces: DataFrame) -> DataFrame:
    """Mean, median, least, largest and spread of each trace, within its row; empty traces have none."""
    n, order = F.size("data"), F.array_sort("data")
    total = F.aggregate("data", F.lit(0.0), lambda s, x: s + x)
    around = F.aggregate("data", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))
    middle = (F.get(order, ((n - 1) / 2).cast("int")) + F.get(order, (n / 2).cast("int"))) / 2
    rows = traces.filter("size(data) > 0").withColumn("mean", total / n)
    return rows.select("channel_id", "mean", middle.alias("median"), F.array_min("data").alias("min"), F.array_max("data").alias("max"), F.sqrt(around / n).alias("sd"))


def points(traces: DataFrame) -> DataFrame:
    """channel_id, t, y: a row a point.

    The outer form, as for the plain one the optimizer infers a filter on the size of the array, which repeats all the
    expressions that made it.
    """
    return traces.select("channel_id", F.posexplode_outer("data").alias("t", "y")).filter("t IS NOT NULL")


def local_maxima(traces: DataFrame, min_height: float) -> DataFrame:
    """channel_id, t, y of points above both neighbours and min_height; no shuffle."""
    triples = F.transform("data", lambda y, i: F.struct(i.alias("t"), y.alias("y"), F.get("data", i - 1).alias("a"), F.get("data", i + 1).alias("b")))
    tops = F.filter(triples, lambda p: (p["y"] > p["a"]) & (p["y"] > p["b"]) & (p["y"] > min_height))
    return traces.select("channel_id", F.explode(tops).alias("p")).select("channel_id", "p.t", "p.y")


# Helpers for one trace.


@cache
def ricker(width: int, points: int) -> np.ndarray:
    t = np.arange(points) - (points - 1) / 2
    return 2 / (np.sqrt(3 * width) * np.pi**0.25) * (1 - (t / width) ** 2) * np.exp(-(t**2) / (2 * width**2))


def tenths(y: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """`np.percentile(y[begin:end], 10)` of each window, none of them empty.

    Windows are searched as ranks of the whole trace's points: whole numbers, of which those of one length are searched
    side by side.
    """
    if np.isnan(y).any():
        return np.array([np.percentile(y[b:e], 10) for b, e in zip(begins, ends)])
    order = np.argsort(y)
    values, ranks = y[order], np.empty(len(y), np.int32)
    ranks[order] = np.arange(len(y), dtype=np.int32)
    out, lengths = np.empty(len(begins)), ends - begins

    def tenth(windows: np.ndarray) -> np.ndarray:
        """Between the two points around a tenth of the way, by the steps of `np.percentile`."""
        n = windows.shape[-1]
        at = (n - 1) * 0.1
        k = int(at)
        if n == 1:
            return values[windows[..., 0]]
        share, parts = at - k, np.partition(windows, k + 1, axis=-1)
        low, high = values[parts[..., : k + 1].max(axis=-1)], values[parts[..., k + 1]]
        step = high - low
        return high - step * (1 - share) if share >= 0.5 else low + step * share

    for n in set(lengths.tolist()):
        which = np.flatnonzero(lengths == n)
        if len(which) == 1:
            out[which] = tenth(ranks[begins[which[0]] : ends[which[0]]])
            continue
        windows = np.lib.stride_tricks.sliding_window_view(ranks, n)
        for part in np.array_split(which, -(-len(which) // 1_000)):
            out[part] = tenth(windows[begins[part]])
    return out


def wavelet_peaks(y: np.ndarray, widths, min_snr: float) -> list[int]:
    """Places of ridges of wavelet maxima that run through the widths and stand out of the noise (Du et al. 2006).

    Ridges begin at the largest width; a maximum of the next one goes on with the nearest ridge at most a quarter of the
    width away. A ridge counts with maxima at a quarter of the widths at least, and a coefficient at its end of at least
    min_snr times the noise: the 10th percentile of the least width's coefficients in a window of a twentieth of the
    trace. Noise is looked up at the ends of ridges only.
    """
    n, widths = len(y), np.asarray(widths, float)
    rows = np.array([np.convolve(y, ricker(w, int(min(10 * w, n))), mode="same")[:n] for w in widths])
    inner = (rows[:, 1:-1] > rows[:, :-2]) & (rows[:, 1:-1] >= rows[:, 2:])  # of equal ones the first
    # Of each ridge: its last place, the level of that, the place where its least width begins, and its maxima.
    last = level = end = size = np.empty(0, int)
    patience = np.ceil(widths[0])
    for k in range(len(rows) - 1, -1, -1):
        tops = np.flatnonzero(inner[k]) + 1
        near = np.full(len(tops), -1)
        live = np.flatnonzero(level - k <= patience + 1)
        if len(live) and len(tops):
            # The nearest ridge ends at the place before or behind; of equally near ones the first ridge.
            ends = last[live]
            order = np.argsort(ends, kind="stable")
            ends = ends[order]
            one = np.concatenate(([True], ends[1:] != ends[:-1]))
            ends, first = ends[one], order[one]
            behind = np.minimum(np.searchsorted(ends, tops), len(ends) - 1)
            before = np.maximum(behind - 1, 0)
            a, b = np.abs(tops - ends[before]), np.abs(tops - ends[behind])
            best = np.where(a < b, first[before], np.where(b < a, first[behind], np.minimum(first[before], first[behind])))
            near = np.where(np.minimum(a, b) <= widths[k] / 4, live[best], -1)
        went = near >= 0
        on, places, new = near[went], tops[went], tops[~went]
        # Of several maxima on one ridge the last goes on with it, its least width begins at the first.
        last[on], level[on], end[on[::-1]] = places, k, places[::-1]
        size += np.bincount(on, minlength=len(size))
        last, level, end, size = (np.concatenate(x) for x in ((last, new), (level, np.full(len(new), k)), (end, new), (size, np.ones(len(new), int))))
    half, odd = divmod(-(-n // 20), 2)
    kept = np.flatnonzero(size >= -(-len(rows) // 4))
    places = end[kept]
    noise = tenths(rows[0], np.maximum(places - half, 0), np.minimum(places + half + odd, n))
    loud = np.abs(rows[level[kept], places]) >= min_snr * np.abs(noise)
    return np.unique(places[loud]).tolist()


def flank(y: np.ndarray, share: float) -> tuple[float, int]:
    """(area, steps) of a peak's flank, which begins at the top y[0] and runs outwards.

    The flank ends at the first point where the mean of three points no longer falls, or is at most half the share of
    the area up to there; else at the last point. The trace is read in stretches that double, so a flank costs what it
    is long.
    """
    reach = 64
    while True:
        part = y[: reach + 3]
        mean = np.convolve(part, np.ones(3), "full")[2 : len(part) + 2] / 3  # ends padded with zeros
        area = np.cumsum(part)
        goes_on = (mean > area * (share / 2)) & (mean < np.append(2 * mean[0], mean[:-1]))
        known = len(y) if len(part) == len(y) else reach
        stops = np.flatnonzero(~goes_on[:known])
        if len(stops) or known == len(y):
            at = int(stops[0]) if len(stops) else len(y) - 1
            return float(area[at]), at
        reach *= 2


def find_peaks(y: np.ndarray, p: ScanParams) -> list[tuple[int, float, float, int, int]]:
    """(place, height, area, begin, end) of the peaks that pass the height filters."""
    places = np.array(wavelet_peaks(y, p.widths, p.min_snr), int)
    # The highest point near a place, of equal ones the last.
    inside = (places >= 3) & (places <= len(y) - 3)
    tops = np.empty(len(places), int)
    if inside.any():
        near = np.lib.stride_tricks.sliding_window_view(y, 6)[places[inside] - 3]
        tops[inside] = places[inside] + 2 - np.argmax(near[:, ::-1], axis=1)
    for k in np.flatnonzero(~inside):
        stop = min(len(y), places[k] + 3)
        tops[k] = stop - 1 - np.argmax(y[max(0, places[k] - 3) : stop][::-1])
    tops = tops[y[tops] >= p.min_height]
    found = dict(zip(tops.tolist(), y[tops].tolist()))
    middle = float(np.median(list(found.values()))) if found else 0.0
    highest = max(found.values(), default=0.0)
    kept = [
        (t, h) for t, h in sorted(found.items())
        if (p.min_relative_ratio <= 0 or h > middle * p.min_relative_ratio)
        and (p.max_relative_ratio <= 0 or h < middle * p.max_relative_ratio)
        and (p.min_height_ratio <= 0 or h > highest * p.min_height_ratio)
    ]
    out = []
    for t, h in kept:
        (right, e), (left, b) = flank(y[t:], 5e-2), flank(y[: t + 1][::-1], 5e-2)
        out.append((t, h, left + right - float(y[t]), t - b, t + e))
    return out


def next_turn(z: np.ndarray, ahead: np.ndarray, begin: int, delta: float) -> tuple[int, int] | None:
    """(where it is sure, place) of the first maximum of z from `begin` on.

    It is sure where z has fallen from its running maximum by more than delta and nothing ahead reaches that.
    """
    reach = 64
    while begin < len(z):
        part = z[begin : begin + reach]
        top = np.maximum.accumulate(part)
        sure = np.flatnonzero((part < top - delta) & (ahead[begin : begin + reach] < top))
        if len(sure):
            return begin + int(sure[0]), begin + int(np.argmax(part[: sure[0] + 1]))
        if len(part) < reach:
            return None
        reach *= 2
    return None


def turning_points(y: np.ndarray, lookahead: int, delta: float) -> tuple[list[tuple[int, float]], list[tuple[int, float]]]:
    """(maxima, minima): extremes that nothing within `lookahead` passes and from which the signal moved by `delta`;
    the first hit of all is dropped.

    Minima are maxima of the mirrored signal, and the two kinds take turns: each search begins where the last extreme
    became sure.
    """
    n = len(y) - lookahead
    found: dict[int, list[tuple[int, float]]] = {1: [], -1: []}
    if n <= 0:
        return [], []
    views = np.lib.stride_tricks.sliding_window_view(y, lookahead)[:n] if lookahead else y[:n, None]
    sides = {s: (s * y[:n], (s * views).max(axis=1)) for s in (1, -1)}
    starts = [(hit, -s) for s in (1, -1) if (hit := next_turn(*sides[s], 0, delta))]
    hit, sign = min(starts, default=(None, 0))
    side = -sign
    while hit:
        found[side].append((hit[1], float(y[hit[1]])))
        side = -side
        hit = next_turn(*sides[side], hit[0] + 1, delta)
    if sign:
        found[-sign] = found[-sign][1:]
    return found[1], found[-1]


def peak_rows(channel: int, y: np.ndarray, params: ScanParams) -> list[tuple]:
    """The peaks of a trace in the columns of PEAK."""
    found = find_peaks(y, params)
    if len(found) > params.max_peaks > 0:
        # The least whole height, at most 100, that no more than max_peaks pass.
        next_height = sorted((f[1] for f in found), reverse=True)[params.max_peaks]
        low = min(100, max(1, math.ceil(next_height)))
        found = [f for f in found if f[1] > low]
    out = []
    for t, h, area, b, e in found:
        beta = area / h if h else 0.0
        kind = "peak-noise" if any(abs(t - x) < 5 for x in params.ignored) else "peak-broad" if beta > params.max_beta else "peak-scanned"
        out.append((channel, t, h, area, b, e, e - b, (e - t or 1) / (t - b or 1), beta, kind))
    return out


# The helpers over tables of traces.

PEAK = "channel_id bigint, rtime int, height double, area double, brtime int, ertime int, wrtime int, srtime double, beta double, peak_type string"


def _each(traces: DataFrame, schema: str, rows: Callable[[int, np.ndarray], list[tuple]]) -> DataFrame:
    """Run a helper on every trace, in Arrow batches; Spark partitions the traces."""
    ship(traces.sparkSession)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [r for k, y in zip(f["channel_id"], f["data"]) if y is not None and len(y) for r in rows(k, np.asarray(y, float))]
            yield pd.DataFrame(got, columns=names)

    return traces.select("channel_id", "data").mapInPandas(run, schema)


def scan_peaks(traces: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """Peaks with area, width, skew and beta (area for height); ignored places are noise, large beta is broad."""
    return _each(traces, PEAK, lambda k, y: peak_rows(k, y, params))


def detect_turning_points(traces: DataFrame, lookahead: int = 5, delta: float = 0.0) -> DataFrame:
    """channel_id, t, y, kind of maxima and minima."""

    def rows(k, y):
        tops, lows = turning_points(y, lookahead, delta)
        return [(k, t, v, "max") for t, v in tops] + [(k, t, v, "min") for t, v in lows]

    return _each(traces, "channel_id bigint, t int, y double, kind string", rows)


def align_ladders(peaks: DataFrame, sizes: list[float]) -> DataFrame:
    """assay_id, score, rss, z, n_peaks of each assay's ladder channel; assays are dealt to tasks.

    score is that of the alignment (-1 and an empty z without one); see `ladder.fit_ladder`.
    """

    ship(peaks.sparkSession)

    def one(f: pd.DataFrame) -> pd.DataFrame:
        fit = fit_ladder(sizes, f["rtime"].to_numpy(float), f["height"].to_numpy(float))
        return pd.DataFrame([(f["assay_id"].iloc[0], fit.dpscore, fit.rss, fit.z, len(f))], columns=["assay_id", "score", "rss", "z", "n_peaks"])

    return peaks.select("assay_id", "rtime", "height").groupBy("assay_id").applyInPandas(one, "assay_id bigint, score double, rss double, z array<double>, n_peaks bigint")


def peak_fits(traces: DataFrame, peaks: DataFrame, reach: int = 3) -> DataFrame:
    """channel_id, rtime, n, centre, sigma, top of each peak (channel_id, rtime): the Gaussian through its surroundings.

    The logarithm of a Gaussian is a parabola, so the fit is closed: the least-squares parabola of the log heights of the
    n points above 0 within `reach` places, from its normal equations. Where fewer than three points are there, or the
    parabola is not open downwards, the last three are null. Peaks outside their trace have no points.
    """
    rows = peaks.select("channel_id", "rtime").join(traces.select("channel_id", "data"), "channel_id")
    near = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda u: F.struct(u.cast("double").alias("u"), F.get("data", (F.col("rtime") + u).cast("int")).alias("y")))
    kept = F.filter(near, lambda e: e["y"] > 0)
    rows = rows.select("channel_id", "rtime", F.transform(kept, lambda e: F.struct(e["u"].alias("u"), F.log(e["y"]).alias("z"))).alias("e"))
    total = lambda term: F.aggregate("e", F.lit(0.0), lambda acc, e: acc + term(e))
    u = lambda k: total(lambda e: F.pow(e["u"], F.lit(float(k))) if k else F.lit(1.0))
    z = lambda k: total(lambda e: e["z"] * (F.pow(e["u"], F.lit(float(k))) if k else F.lit(1.0)))
    sums = rows.select("channel_id", "rtime", F.size("e").cast("bigint").alias("n"), *[u(k).alias(f"s{k}") for k in range(5)], *[z(k).alias(f"t{k}") for k in range(3)])

    def det(a, b, c) -> Column:
        """The determinant of three columns."""
        (a0, a1, a2), (b0, b1, b2), (c0, c1, c2) = ([F.col(x) for x in v] for v in (a, b, c))
        return a0 * (b1 * c2 - b2 * c1) - b0 * (a1 * c2 - a2 * c1) + c0 * (a1 * b2 - a2 * b1)

    one, two, three, right = ("s0", "s1", "s2"), ("s1", "s2", "s3"), ("s2", "s3", "s4"), ("t0", "t1", "t2")
    whole = F.when(F.col("n") >= 3, det(one, two, three))
    c, b, a = (F.try_divide(d, whole) for d in (det(right, two, three), det(one, right, three), det(one, two, right)))
    fitted = sums.select("channel_id", "rtime", "n", a.alias("a"), b.alias("b"), c.alias("c"))
    shown = lambda x: F.when(F.col("a") < 0, x)
    return fitted.select(
        "channel_id", "rtime", "n", shown(F.col("rtime") - F.col("b") / (2 * F.col("a"))).alias("centre"), shown(F.sqrt(-1 / (2 * F.col("a")))).alias("sigma"),
        shown(F.exp(F.col("c") - F.col("b") * F.col("b") / (4 * F.col("a")))).alias("top"),
    )
