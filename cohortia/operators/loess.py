"""Local regression (M25): at every point of a grid a straight line, weighted
by tricube weights, through the ``frac`` of the rows that are nearest.

The weights are polynomials on either side of the point, so a point needs only
sums of powers of x, with and without y, over the ranges left and right of it.
The ends of all ranges cut the axis into cells; one pass over the rows adds up
the powers per cell (about the cell's centre, in units of its width), and each
grid point puts its cells together. So rows are read once, whatever the grid,
and no row is copied per grid point. How far the ranges reach, the distance of
the ``frac`` n-th nearest row, comes from exact quantiles.
"""

from __future__ import annotations

import math
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import SKETCH_ACCURACY, _cell, quantile_counts

POWERS = 11  # tricube weights have degree 9; x² and x·y add two


def _reaches(df: DataFrame, x: str, grid: np.ndarray, frac: float, n: int) -> np.ndarray:
    """Distance from each grid point to its k-th nearest row, k = ceil(frac n):
    that to the farther end of the nearest k neighbours in order. Their first
    rank is bracketed by a sketch of x (checked, else all ranks are open) and
    found by bisection, for all points at once."""
    k = min(n, max(2, math.ceil(frac * n - 1e-9)))

    def at(*ranks: np.ndarray) -> list[np.ndarray]:
        share = [np.clip(r, 0, n - 1) / max(n - 1, 1) for r in ranks]
        probs = sorted({float(p) for s in share for p in s})
        got = dict(zip(probs, (v[0] for v in quantile_counts(df, {x: probs})[x])))
        return [np.array([got[float(p)] for p in s]) for s in share]

    def moves(first: np.ndarray) -> np.ndarray:
        """The row after the window is nearer than the window's first."""
        below, above = at(first, first + k)
        return (grid - below > above - grid) & (first < n - k)
    steps = 1000
    sketch = np.array(df.agg(F.percentile_approx(x, F.array(*[F.lit(i / steps) for i in range(steps + 1)]),
                                                 SKETCH_ACCURACY)).first()[0], float)
    ranks = np.arange(n - k + 1)[::max(1, (n - k) // steps)]
    near = [np.interp(r / max(n - 1, 1), np.linspace(0, 1, steps + 1), sketch) for r in (ranks, ranks + k)]
    guess = [int(ranks[(g - near[0] > near[1] - g).sum() - 1]) if (g - near[0] > near[1] - g).any() else 0
             for g in grid]
    room = 4 * (n // steps) + 2
    lo, hi = np.maximum(np.array(guess) - room, 0), np.minimum(np.array(guess) + room, n - k)
    lo = np.where(moves(lo - 1) | (lo == 0), lo, 0)
    hi = np.where(moves(hi), n - k, hi)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        go = moves(mid)
        lo, hi = np.where(go & (lo < hi), mid + 1, lo), np.where(go | (lo >= hi), hi, mid)
    below, above = at(lo, lo + k - 1)
    return np.maximum(grid - below, above - grid)


def _moments(df: DataFrame, x: str, y: str, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per cell between two cuts: centre, half width, and the sums of
    u^p and u^p y for p = 0 .. POWERS with u = (x - centre) / half width. A row
    on a cut is in the cell that ends there."""
    centre, half = (cuts[1:] + cuts[:-1]) / 2, np.maximum((cuts[1:] - cuts[:-1]) / 2, 1e-300)
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    cell = F.floor(_cell(xs, [(c, c) for c in cuts.tolist()]) / 2).cast("int") - 1
    cell = F.least(F.greatest(cell, F.lit(0)), F.lit(len(cuts) - 2))
    at = df.where(xs.isNotNull() & ys.isNotNull()).select(cell.alias("cell"), xs.alias("x"), ys.alias("y"))
    places = F.array(*[F.lit(float(c)) for c in centre]), F.array(*[F.lit(float(h)) for h in half])
    u = (F.col("x") - F.element_at(places[0], F.col("cell") + 1)) / F.element_at(places[1], F.col("cell") + 1)
    at = at.withColumn("u", u)
    rows = at.groupBy("cell").agg(*[F.sum(F.pow("u", F.lit(p)) * w).alias(f"{n}{p}") for p in range(POWERS + 1)
                                    for n, w in (("s", F.lit(1.0)), ("t", F.col("y")))]).collect()
    out = np.zeros((2, len(centre), POWERS + 1))
    for r in rows:
        for p in range(POWERS + 1):
            out[0, r["cell"], p], out[1, r["cell"], p] = r[f"s{p}"], r[f"t{p}"]
    return centre, half, out


def loess(df: DataFrame, x: str, y: str, frac: float = 0.6, points: int = 50) -> DataFrame:
    """``x, smooth`` on ``points`` even steps from the smallest to the largest
    x; rows with a null are left out, a table without rows gives no points."""
    spark = df.sparkSession
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n, lo, hi = full.agg(F.count(F.lit(1)), F.min(x).cast("double"), F.max(x).cast("double")).first()
    if not n:
        return spark.createDataFrame([], "x double, smooth double")
    grid = np.linspace(lo, hi, points) if hi > lo else np.array([lo])
    reach = _reaches(full, x, grid, frac, n)
    reach = np.where(reach > 0, reach, max(hi - lo, 1.0) * 1e-9)
    cuts = np.unique(np.concatenate([[lo, hi], grid, np.clip(grid - reach, lo, hi), np.clip(grid + reach, lo, hi)]))
    if len(cuts) == 1:
        return full.agg(F.lit(float(lo)).alias("x"), F.avg(y).alias("smooth"))
    centre, half, sums = _moments(full, x, y, cuts)
    out = []
    for g, h in zip(grid, reach):
        S, T = np.zeros(3), np.zeros(2)
        for c in np.flatnonzero((cuts[:-1] >= g - h - 1e-12 * h) & (cuts[1:] <= g + h + 1e-12 * h)):
            # v = (x - g) / h = a + b u; the weight is (1 - |v|³)³
            a, b, sign = (centre[c] - g) / h, half[c] / h, 1.0 if centre[c] >= g else -1.0
            power = np.zeros((POWERS + 1, POWERS + 1))  # v^p in powers of u
            for p in range(POWERS + 1):
                for q in range(p + 1):
                    power[p, q] = comb(p, q) * a ** (p - q) * b ** q
            s, t = power @ sums[0, c], power @ sums[1, c]
            for k, w in enumerate((1.0, -3.0, 3.0, -1.0)):
                w *= sign ** (3 * k)
                S += w * s[3 * k:3 * k + 3]
                T += w * t[3 * k:3 * k + 2]
        det = S[0] * S[2] - S[1] ** 2
        if S[0] <= 0:
            value = None
        elif det <= 1e-12 * S[0] ** 2:
            value = float(T[0] / S[0])
        else:
            value = float((S[2] * T[0] - S[1] * T[1]) / det)
        out.append((float(g), value))
    return spark.createDataFrame(out, "x double, smooth double")
