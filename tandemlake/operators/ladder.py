"""The ladder of a trace: which of its peaks are the known sizes, and the cubic from time to size. One channel at a time;
`signal` and `assay` run it over tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class LadderParams:
    """least_share and most_share: peaks of a candidate set, for each size of the ladder. height: only peaks above it
    are one candidate set, if positive. separation: seconds for a base pair, estimated unless given."""

    least_share: float = 0.85
    most_share: float = 1.5
    height: float = -1.0
    separation: float = -1.0
    gap: float = -0.005
    tolerance: float = 4.0


@dataclass(frozen=True)
class LadderFit:
    """z: the cubic, highest power first; pairs: (size, place in the given peaks)."""

    dpscore: float = -1.0
    rss: float = -1.0
    z: list[float] = field(default_factory=list)
    pairs: list[tuple[float, int]] = field(default_factory=list)
    height: float = 0.0
    report: str = ""


def candidate_sets(heights: np.ndarray, sizes: int) -> list[tuple[float, np.ndarray]]:
    """(height, places) of the peaks at or above each whole height up to 5,000 that changes their number.

    From twice as many peaks as sizes down to the first set with fewer than the ladder has, one set after the first at
    least.
    """
    whole = np.minimum(np.floor(heights), 5_000)
    out: list[tuple[float, np.ndarray]] = []
    for h in np.unique(whole[whole >= 1]):
        places = np.flatnonzero(whole >= h)
        if len(places) <= 2 * sizes:
            out.append((float(h), places))
            if len(out) > 1 and len(places) < sizes:
                break
    return out


def seconds_per_base(sizes: np.ndarray, times: np.ndarray) -> float:
    """Mean spacing of peaks over mean spacing of sizes, of the middle third of each by spacing. The end of the sizes'
    third counts peaks, as results depend on it."""
    own, other = np.sort(np.abs(np.diff(np.sort(sizes)))), np.sort(np.diff(np.sort(times)))
    n, m = len(sizes), len(times)
    own, other = own[int(n * 0.33) : int(m * 0.66)], other[int(m * 0.33) : int(m * 0.66)]
    return float(other.mean() / own.mean()) if len(own) and len(other) and own.mean() else 0.0


def separate(times: np.ndarray, heights: np.ndarray, least: float) -> np.ndarray:
    """Places of peaks more than `least` apart, by falling time: of two nearer ones the higher stays."""
    kept: list[int] = []
    for i in np.argsort(-times, kind="stable").tolist():
        if kept and times[kept[-1]] - times[i] <= least:
            if heights[kept[-1]] <= heights[i]:
                kept[-1] = i
        else:
            kept.append(i)
    return np.array(kept, int)


def cubic(sizes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """(z, rss) of the least-squares cubic; of fewer pairs than it has terms, the power that they determine.

    The steps of `np.polyfit`, without its checks.
    """
    terms = min(3, len(sizes) - 1) + 1
    left = np.vander(times, terms)
    scale = np.sqrt((left * left).sum(axis=0))
    z = np.linalg.lstsq(left / scale, sizes, len(times) * np.finfo(float).eps)[0] / scale
    return np.append(np.zeros(4 - terms), z), float(((np.polyval(z, times) - sizes) ** 2).sum())


def match_all(s: np.ndarray, widths: np.ndarray, gap: float) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """(scores, pairs) of the global alignments of rows and columns with the highest sums, one for each table of `s`.

    A table has as many columns as its width says, others don't count. Columns are left out for nothing, rows for `gap`,
    a quarter of it before the first and after the last column. So a row of a table is a running maximum, and all
    tables go on together.
    """
    size, n, most = s.shape
    d = np.zeros((size, n + 1, most + 1))
    d[:, 1:, 0] = 0.25 * gap
    skip = np.where(np.arange(most) == widths[:, None] - 1, 0.25 * gap, gap)
    for i in range(1, n + 1):
        np.maximum(d[:, i - 1, :-1] + s[:, i - 1], d[:, i - 1, 1:] + skip, out=d[:, i, 1:])
        np.maximum.accumulate(d[:, i], axis=1, out=d[:, i])
    paired, skipped = d[:, :-1, :-1] + s == d[:, 1:, 1:], d[:, :-1, 1:] + skip[:, None, :] == d[:, 1:, 1:]
    steps = np.where(paired, 0, np.where(skipped, 1, 2)).tolist()
    out = []
    for table, j in zip(steps, widths.tolist()):
        i, pairs = n, []
        while i and j:
            step = table[i - 1][j - 1]
            i, j = i - (step != 2), j - (step != 1)
            if step == 0:
                pairs.append((i, j))
        out.append(pairs[::-1])
    return d[np.arange(size), n, widths], out


def match(s: np.ndarray, gap: float) -> tuple[float, list[tuple[int, int]]]:
    """`match_all` of one table."""
    scores, pairs = match_all(s[None], np.array([s.shape[1]]), gap)
    return float(scores[0]), pairs[0]


def align_all(sizes: np.ndarray, starts: list[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]], params: LadderParams = LadderParams()) -> list[tuple[float, float, np.ndarray, list[tuple[int, int]]]]:
    """(score, rss, z, pairs) for each start (times, heights, pairs): sizes matched to peaks until the score no longer
    rises. Sizes and times descend. All starts go on together, so a round takes a few operations on their tables.

    A pair scores by how near the peak's size, as fitted so far, is to the ladder's, low peaks a little less.
    """
    known: dict[tuple, tuple[np.ndarray, float]] = {}

    def fitted(times: np.ndarray, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, float]:
        i, j = (list(x) for x in zip(*pairs))
        at = times[j]
        key = (at.tobytes(), *i)
        if key not in known:
            known[key] = cubic(sizes[i], at)
        return known[key]

    best = [(-1.0, -1.0, np.zeros(4), [])] * len(starts)
    if not starts:
        return best
    widths = np.array([len(t) for t, _, _ in starts])
    times, weight = np.zeros((len(starts), widths.max())), np.zeros((len(starts), widths.max()))
    for k, (t, h, _) in enumerate(starts):
        times[k, : len(t)] = t
        weight[k, : len(t)] = (np.log10(np.maximum(h / h.max(), 1e-9)) + len(sizes)) / len(sizes)
    z = np.array([fitted(t, pairs)[0] for t, _, pairs in starts])
    going = np.arange(len(starts))
    for _ in range(100):
        fit = np.zeros((len(going), times.shape[1]))
        for power in range(4):
            fit = fit * times[going] + z[going, power, None]
        near = (fit[:, None, :] - sizes[None, :, None]) / params.tolerance
        scores, found = match_all(weight[going, None, :] * np.exp(-(near**2) / 2), widths[going], params.gap)
        on = []
        for k, score, pairs in zip(going.tolist(), scores.tolist(), found):
            if score > best[k][0] and len(pairs) >= 2:
                z[k], rss = fitted(starts[k][0], pairs)
                best[k] = (score, rss, z[k].copy(), pairs)
                on.append(k)
        if not on:
            break
        going = np.array(on)
    return best


def first_pairs(sizes: np.ndarray, times: np.ndarray) -> list[list[tuple[int, int]]]:
    """Sizes and peaks paired in order, up to three of the longest peaks or seven of the largest sizes left out: the
    three pairings with the least squares. Both descend."""
    starts = []
    for skip in range(-3, 8):
        i, j = max(skip, 0), max(-skip, 0)
        n = min(len(sizes) - i, len(times) - j)
        if n >= 2:
            starts.append((cubic(sizes[i : i + n], times[j : j + n])[1], skip, [(i + k, j + k) for k in range(n)]))
    return [pairs for _, _, pairs in sorted(starts)[:3]]


def fit_ladder(ladder: list[float], times: np.ndarray, heights: np.ndarray, params: LadderParams = LadderParams()) -> LadderFit:
    """Candidate sets by height, thinned out by time, each aligned from several first pairings; the highest score wins,
    then the least squares. Sets that thin out to the same peaks are one."""
    sizes = np.sort(np.asarray(ladder, float))[::-1]
    if params.height > 0:
        sets = [(params.height, np.flatnonzero(heights > params.height))]
    else:
        sets = candidate_sets(heights, len(sizes))
    if not any(len(places) for _, places in sets):
        return LadderFit(report="Not enough initial signals|Too much noises or too few signals")
    kept_sets: dict[bytes, tuple[float, np.ndarray]] = {}
    for height, places in sets:
        if len(places) < 2:
            continue
        pace = params.separation if params.separation >= 0 else seconds_per_base(sizes, times[places])
        kept = places[separate(times[places], heights[places], 0.9 * pace * float(np.abs(np.diff(sizes)).min()))]
        if params.least_share * len(sizes) <= len(kept) <= params.most_share * len(sizes):
            kept_sets.setdefault(kept.tobytes(), (height, kept))
    starts = [(height, kept, pairs) for height, kept in kept_sets.values() for pairs in first_pairs(sizes, times[kept])]
    tried = align_all(sizes, [(times[kept], heights[kept], pairs) for _, kept, pairs in starts], params)
    fits = [
        LadderFit(score, rss, z.tolist(), [(float(sizes[i]), int(kept[j])) for i, j in pairs], height)
        for (height, kept, _), (score, rss, z, pairs) in zip(starts, tried) if pairs
    ]
    return min(fits, key=lambda f: (-f.dpscore, f.rss), default=LadderFit(report="Not enough filtered peaks|Bad peak separation time"))


def fit_score(rss: float, used: int, sizes: int) -> float:
    """`functions.scalar.ladder_score` of one fit."""
    cost = 0.25 if rss <= 0 else 0.0
    for limit, minus in ((50, 0.05), (255, 0.10), (1024, 0.10)):
        cost += 0.0 if rss <= limit else minus
    missing = sizes - used
    return 1.0 - cost - (0.025 * (missing - 1) if missing > 0 else 0.0)


def assign_nearest(ladder: list[float], times: np.ndarray, predicted: np.ndarray) -> list[tuple[float, int]]:
    """(size, place): each size takes the peak nearest to its predicted time; of sizes with one peak the nearest keeps
    it, of equally near ones the first."""
    far = np.abs(times[None, :] - predicted[:, None])
    best = far.argmin(axis=1)
    own: dict[int, int] = {}
    for i, j in enumerate(best.tolist()):
        if j not in own or far[own[j], j] > far[i, j]:
            own[j] = i
    return sorted((float(ladder[i]), j) for j, i in own.items())
