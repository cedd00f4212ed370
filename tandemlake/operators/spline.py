"""Sizes by a smoothing spline: the cubic spline of least roughness whose squared residuals sum to a bound.

Roughness is the sum of squared jumps of the third derivative at the knots. Knots are added where the residuals are
largest until a least-squares spline stays within the bound; then the weight of the roughness is raised until the bound
is just met. A ladder has some tens of peaks, so a fit is a small task of its own assay; the pieces of the fitted spline
are a column, and the sizes of all other peaks are computed from it by built-in functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

DEGREE = 3
#: Fixed value: the bound of the sum of squared residuals that sizes are made with.
RESIDUALS = 3.0
#: How closely the bound is met.
CLOSE = 1e-3


def basis(knots: np.ndarray, x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The B-splines of a knot sequence at the places x, a column each; the last interval is closed."""
    last = np.flatnonzero(knots < knots[-1])[-1]
    rows = (x[:, None] >= knots[None, :-1]) & (x[:, None] < knots[None, 1:])
    rows[x == knots[-1], last] = True
    b = rows.astype(float)
    for d in range(1, degree + 1):
        rise, fall = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
        up = np.divide(x[:, None] - knots[None, : -d - 1], rise, out=np.zeros((len(x), len(rise))), where=rise > 0)
        down = np.divide(knots[None, d + 1 :] - x[:, None], fall, out=np.zeros((len(x), len(fall))), where=fall > 0)
        b = up * b[:, :-1] + down * b[:, 1:]
    return b


def jumps(knots: np.ndarray) -> np.ndarray:
    """The jump of each B-spline's third derivative at each inner knot, a row a knot."""
    c = np.eye(len(knots) - DEGREE - 1)
    for d in range(DEGREE, 0, -1):
        t = knots[DEGREE - d : len(knots) - DEGREE + d]  # a derivative has one knot less at each end
        width = t[d + 1 : -1] - t[1 : -d - 1]
        c = d * np.diff(c, axis=0) / width[:, None]
    return np.diff(c, axis=0)


def _solve(x: np.ndarray, y: np.ndarray, knots: np.ndarray, p: float) -> tuple[np.ndarray, float]:
    """(coefficients, sum of squared residuals) with the squared jumps weighted by 1 / p; without jumps for infinite p."""
    b = basis(knots, x)
    a, rhs = b, y
    if np.isfinite(p):
        d = jumps(knots) / np.sqrt(p)
        a, rhs = np.vstack([b, d]), np.append(y, np.zeros(len(d)))
    c = np.linalg.lstsq(a, rhs, rcond=None)[0]
    return c, float(((y - b @ c) ** 2).sum())


def smoothing_spline(x: np.ndarray, y: np.ndarray, bound: float = RESIDUALS) -> tuple[np.ndarray, np.ndarray, float]:
    """(knots, coefficients, p) of the smoothing spline of points in rising order of different x, at least four."""
    # Unit length keeps the jumps' scale from the units of x.
    ends = lambda inner: np.concatenate([[x[0]] * (DEGREE + 1), inner, [x[-1]] * (DEGREE + 1)])
    inner: list[float] = []
    c, least = _solve(x, y, ends(inner), np.inf)
    while least > bound and len(inner) < len(x) - DEGREE - 1:
        r = (y - basis(ends(inner), x) @ c) ** 2
        borders = [x[0], *inner, x[-1]]
        parts = [np.flatnonzero((x > a) & (x < b)) for a, b in zip(borders, borders[1:])]
        free = [(r[part].sum(), -i, part) for i, part in enumerate(parts) if len(part)]
        if not free:
            break
        part = max(free, key=lambda f: f[:2])[2]
        inner = sorted([*inner, x[part[len(part) // 2]]])
        c, least = _solve(x, y, ends(inner), np.inf)
    knots = ends(inner)
    if not inner or least >= bound:
        return knots, c, np.inf
    low, high = -60.0, 60.0  # of log p; residuals fall as p rises
    for _ in range(200):
        p = (low + high) / 2
        c, sum_ = _solve(x, y, knots, float(np.exp(p)))
        if abs(sum_ - bound) <= CLOSE * bound:
            break
        low, high = (p, high) if sum_ > bound else (low, p)
    return knots, c, float(np.exp(p))


def pieces(knots: np.ndarray, c: np.ndarray) -> list[tuple[float, float, float, float, float]]:
    """(from, c0, c1, c2, c3) of each interval: its cubic in powers of the distance from its begin."""
    borders = np.unique(knots)
    u = np.array([0.0, 1 / 3, 2 / 3, 1.0])
    out = []
    for a, b in zip(borders, borders[1:]):
        values = basis(knots, a + u * (b - a)) @ c
        if b < borders[-1]:  # a half-open interval's end belongs to the next one, where the spline is the same
            values[-1] = (basis(knots, np.array([b])) @ c)[0]
        power = np.linalg.solve(np.vander(u, increasing=True), values) / (b - a) ** np.arange(4)
        out.append((float(a), *map(float, power)))
    return out


def fit_splines(ladders: DataFrame, bound: float = RESIDUALS) -> DataFrame:
    """assay_id, pieces, first_rtime, last_rtime of each assay's ladder (assay_id, rtimes, sizes: arrays side by side).

    Peaks of one time count once, with their mean size. Ladders of fewer than four times, and nulls, have no pieces.
    """
    ship(ladders.sparkSession)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for assay, times, sizes in zip(f["assay_id"], f["rtimes"], f["sizes"]):
                at: dict[float, list[float]] = {}
                for t, s in zip([] if times is None else times, [] if sizes is None else sizes):
                    if t is not None and s is not None and np.isfinite(t) and np.isfinite(s):
                        at.setdefault(float(t), []).append(float(s))
                x = np.array(sorted(at))
                if len(x) <= DEGREE:
                    out.append((assay, None, None, None))
                    continue
                y = np.array([np.mean(at[t]) for t in x])
                # Times are shifted and scaled for the fit; pieces are in the times' own units.
                knots, c, _ = smoothing_spline((x - x[0]) / (x[-1] - x[0]), y, bound)
                wide = x[-1] - x[0]
                scaled = [(x[0] + a * wide, *(v / wide**k for k, v in enumerate(p))) for a, *p in pieces(knots, c)]
                out.append((assay, scaled, float(x[0]), float(x[-1])))
            yield pd.DataFrame(out, columns=["assay_id", "pieces", "first_rtime", "last_rtime"])

    kind = ladders.schema["assay_id"].dataType.simpleString()
    piece = "array<struct<at:double,c0:double,c1:double,c2:double,c3:double>>"
    return ladders.select("assay_id", "rtimes", "sizes").mapInPandas(fit, f"assay_id {kind}, pieces {piece}, first_rtime double, last_rtime double")


def spline_size(time: Column, found: Column) -> Column:
    """The size at a time by the pieces; beyond the ends the first or last piece goes on."""
    before = F.filter(found, lambda p: p["at"] <= time)
    p = F.when(F.size(before) > 0, F.element_at(before, -1)).otherwise(F.get(found, F.lit(0)))
    u = time - p["at"]
    return ((p["c3"] * u + p["c2"]) * u + p["c1"]) * u + p["c0"]


def size_by_spline(peaks: DataFrame, ladders: DataFrame, bound: float = RESIDUALS) -> DataFrame:
    """The peaks (assay_id, rtime, ...) of fitted assays with size: strictly within the ladder by its spline, else -1."""
    fits = fit_splines(ladders, bound).filter("pieces IS NOT NULL")
    x = F.col("rtime").cast("double")
    inside = (x > F.col("first_rtime")) & (x < F.col("last_rtime"))
    kept = [c for c in peaks.columns if c != "size"]
    return peaks.select(*kept).join(fits, "assay_id").select(*kept, F.when(inside, spline_size(x, F.col("pieces"))).otherwise(-1.0).alias("size"))
