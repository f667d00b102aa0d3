"""Continuous budget allocation (X18, X19) on S-shaped response curves.

A brand's problem is small (its channels), brands are many: each brand is solved
on its own rows. A curve s^a / (s^a + i^a) is convex up to its turning point and
concave beyond. For a price on spend every channel has one best answer: its
lower limit, or the spend on the concave part where the slope equals the price,
whichever gains more (the upper envelope of the curve decides). Spend falls as
the price rises, so bisection finds the price that uses the budget up. At that
price a channel may jump from its lower limit across the convex part; no more
than one channel can stay on a convex part. So the answers with the jumping
channels down, with them up, and with each channel in turn on the way between
are compared, the others sharing what is left at one slope. The grid allocation
is one more start, refined in the same way: the result is never below it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mix import allocate_budget, response

HALVINGS = 50
PLACES, ROWS = 13, 4  # of the search on a convex part


class Brand:
    """Curves and limits of one brand's channels."""

    def __init__(self, beta, alpha, inflexion, low, high):
        self.beta, self.alpha, self.inflexion = (np.asarray(v, float) for v in (beta, alpha, inflexion))
        self.low, self.high = np.asarray(low, float), np.asarray(high, float)
        a = np.maximum(self.alpha, 1.0)
        turn = self.inflexion * ((a - 1) / (a + 1)) ** (1 / a)
        self.turn = np.clip(turn, self.low, self.high)  # concave from here on
        self.grows = self.beta > 0

    def value(self, s: np.ndarray) -> np.ndarray:
        sa, ia = s ** self.alpha, self.inflexion ** self.alpha
        return self.beta * np.divide(sa, sa + ia, out=np.zeros_like(sa), where=sa + ia > 0)

    def slope(self, s: np.ndarray) -> np.ndarray:
        s = np.maximum(s, 1e-12 * np.maximum(self.inflexion, 1e-300))
        ratio = (self.inflexion / s) ** self.alpha
        return self.beta * self.alpha * ratio / (s * (1 + ratio) ** 2)

    def at_price(self, price: float, start: np.ndarray) -> np.ndarray:
        """Spend from ``start`` (on the concave part) to where the slope falls
        to the price."""
        lo, hi = start.copy(), self.high.copy()
        for _ in range(HALVINGS):
            mid = (lo + hi) / 2
            steep = self.slope(mid) > price
            lo, hi = np.where(steep, mid, lo), np.where(steep, hi, mid)
        stop = np.where(self.slope(start) <= price, start, (lo + hi) / 2)
        return np.where(self.slope(self.high) >= price, self.high, stop)

    def answer(self, price: float) -> np.ndarray:
        up = self.at_price(price, self.turn)
        gains = self.value(up) - price * up > self.value(self.low) - price * self.low
        return np.where(gains & self.grows, up, self.low)

    def filled(self, budget: float, up: np.ndarray, fixed: np.ndarray) -> np.ndarray | None:
        """The best spends with the channels ``up`` on their concave parts and
        the others ``fixed``; None if the budget does not reach."""
        def spend(price: float) -> np.ndarray:
            return np.where(up, self.at_price(price, self.turn), fixed)
        least = np.where(up, self.turn, fixed)
        if least.sum() > budget * (1 + 1e-12):
            return None
        if not up.any() or spend(0.0).sum() <= budget:
            return spend(0.0)
        lo, hi = 0.0, float(self.slope(self.turn)[up].max())
        for _ in range(HALVINGS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if spend(mid).sum() > budget else (lo, mid)
        return spend(hi)


def best_spends(brand: Brand, budget: float, start: np.ndarray | None = None) -> np.ndarray | None:
    """The spends of largest total response within the limits and the budget."""
    if brand.low.sum() > budget * (1 + 1e-12):
        return None
    lo, hi = 0.0, float(max(brand.slope(brand.turn).max(), brand.slope(brand.low).max(), 0.0)) * 2 + 1e-300
    if brand.answer(lo).sum() <= budget:
        return brand.answer(lo)
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if brand.answer(mid).sum() > budget else (lo, mid)
    under, over = brand.answer(hi), brand.answer(lo)
    tried = [under] + ([start] if start is not None else [])
    convex = np.flatnonzero((brand.turn > brand.low) & brand.grows)
    ups = [under > brand.low, over > brand.low]
    if start is not None:
        ups.append((start >= brand.turn) & (start > brand.low) & brand.grows)
    seen = set()
    for up in ups:
        up = up & brand.grows
        tried.append(brand.filled(budget, up, brand.low))
        for j in convex:
            rest = up.copy()
            rest[j] = False
            if (j, rest.tobytes()) in seen:
                continue
            seen.add((j, rest.tobytes()))

            def with_j(s: float, j=j, rest=rest) -> np.ndarray | None:
                fixed = brand.low.copy()
                fixed[j] = s
                return brand.filled(budget, rest, fixed)
            a, b = brand.low[j], brand.high[j]
            for _ in range(ROWS):  # the best of a row of places, then a row about it
                row = np.linspace(a, b, PLACES)
                found = [(brand.value(x).sum(), s, x) for s in row if (x := with_j(s)) is not None]
                if not found:
                    break
                _, s, x = max(found, key=lambda t: t[0])
                tried.append(x)
                step = (b - a) / (PLACES - 1)
                a, b = max(brand.low[j], s - step), min(brand.high[j], s + step)
    fit = [x for x in tried if x is not None and x.sum() <= budget * (1 + 1e-9)]
    return max(fit, key=lambda x: brand.value(x).sum())


def optimise_budget(curves: DataFrame, low: float = 0.7, up: float = 1.5, budget: float | None = None,
                    channel: str = "channel", by: Sequence[str] = (), units: int = 100) -> DataFrame:
    """``allocate_budget`` without its grid: spend per channel within
    [low, up] x its current spend, total at most the budget (default: the
    current total), of largest total response; all brands (``by``) side by side.

    Columns as there, and ``slope``: the response of one more unit of spend,
    equal in all channels that are inside their limits. Channels with a null
    are left out; a budget below the lower limits gives no rows.
    """
    keys = list(by) or ["__all"]
    needed = ["current", "beta", "alpha", "inflexion"]
    base = (curves if by else curves.withColumn("__all", F.lit(0))).dropna(subset=[channel, *needed])
    grid = allocate_budget(base, low, up, units, budget, channel, keys).select(
        *keys, channel, F.col("spend_opt").alias("__grid"))
    rows = base.select(*keys, channel, *[F.col(c).cast("double").alias(c) for c in needed]).join(
        grid, [*keys, channel], "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(channel)
        now = pdf["current"].to_numpy()
        brand = Brand(pdf["beta"], pdf["alpha"], pdf["inflexion"], now * low, now * up)
        start = None if pdf["__grid"].isna().any() else pdf["__grid"].to_numpy()
        spends = best_spends(brand, now.sum() if budget is None else budget, start)
        if spends is None:
            return pdf.assign(spend_opt=0.0, slope=0.0).head(0)
        return pdf.assign(spend_opt=spends, slope=brand.slope(spends))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", spend_opt double, slope double"
    got = rows.groupBy(*keys).applyInPandas(solve, schema)
    of = [F.col(c) for c in ("beta", "alpha", "inflexion")]
    got = got.select(*keys, channel, "current", "spend_opt", response(F.col("current"), *of).alias("response_current"),
                     response(F.col("spend_opt"), *of).alias("response_opt"), "slope")
    total = got.groupBy(*keys).agg(F.sum("response_opt").alias("total_response"))
    return got.join(total, keys).select(*by, channel, "current", "spend_opt", "response_current", "response_opt",
                                        "total_response", "slope")
