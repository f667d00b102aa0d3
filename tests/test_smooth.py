"""Local regression against the quadratic version; trend with change points
against planted breaks and plain least squares."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import loess as lo
from cohortia.operators import trend as tr


def plain_loess(x, y, grid, frac):
    k = max(2, int(np.ceil(frac * len(x) - 1e-9)))
    out = []
    for g in grid:
        d = np.abs(x - g)
        h = np.sort(d)[min(k, len(x)) - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        a = np.column_stack([np.ones_like(x), x - g]) * np.sqrt(w)[:, None]
        out.append(np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0][0])
    return np.array(out)


@pytest.mark.parametrize("kind, frac", [("skewed", 0.3), ("skewed", 0.9), ("ties", 0.6), ("far", 0.5)])
def test_loess_equals_the_quadratic_version(spark, kind, frac):
    rng = np.random.default_rng(4)
    x = {"skewed": rng.exponential(2, 700), "ties": rng.integers(0, 30, 700).astype(float),
         "far": 1e6 + rng.normal(0, 1, 700)}[kind]
    y = np.sin(x) + 0.1 * x + rng.normal(0, 0.3, 700)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, None)],
                               "x double, y double")
    got = lo.loess(df, "x", "y", frac, 23).orderBy("x").toPandas()
    assert np.allclose(got["x"], np.linspace(x.min(), x.max(), 23))
    assert np.allclose(got["smooth"], plain_loess(x, y, got["x"].to_numpy(), frac), atol=1e-6)


def test_a_wrong_sketch_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(lo, "SKETCH_ACCURACY", 3)
    rng = np.random.default_rng(5)
    x = np.sort(rng.exponential(1, 3000))
    y = x ** 2
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = lo.loess(df, "x", "y", 0.2, 9).orderBy("x").toPandas()
    assert np.allclose(got["smooth"], plain_loess(x, y, got["x"].to_numpy(), 0.2), atol=1e-6)


def test_loess_of_small_tables(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "x double, y double")
        return [(r["x"], round(r["smooth"], 9)) for r in lo.loess(df, "x", "y", 0.6, 3).orderBy("x").collect()]
    assert run([]) == [] and run([(2.0, 5.0)]) == [(2.0, 5.0)]
    assert run([(2.0, 5.0), (2.0, 7.0)]) == [(2.0, 6.0)]
    assert run([(0.0, 1.0), (1.0, 3.0), (2.0, 5.0), (3.0, 7.0)]) == [(0.0, 1.0), (1.5, 4.0), (3.0, 7.0)]


def weeks(spark, values, brand="a"):
    start = dt.date(2020, 1, 6)
    return spark.createDataFrame([(brand, start + dt.timedelta(weeks=i), None if v is None else float(v))
                                  for i, v in enumerate(values)], "brand string, week date, sales double")


def test_planted_breaks_are_recovered(spark):
    t = np.arange(200) / 199
    rng = np.random.default_rng(3)
    kinks = [0.8 * 6 / 26, 0.8 * 17 / 26]  # at two of the points
    y = 50 + 10 * t + 60 * np.maximum(t - kinks[0], 0) - 90 * np.maximum(t - kinks[1], 0)
    noisy = y + 3 * np.sin(2 * np.pi * np.arange(200) / tr.PERIOD) + rng.normal(0, 0.2, 200)
    got = tr.trend_changes(weeks(spark, noisy), "sales", by=["brand"], penalty=0.01).orderBy("week").toPandas()
    assert np.abs(got.trend - y).max() < 1.5 and np.abs(got.trend - y).mean() < 0.4
    change = got.assign(p=np.floor(t * 26 / 0.8).clip(max=25)).groupby("p").slope_change.first()
    assert (change.loc[4:8].sum() > 40) and (change.loc[15:19].sum() < -60)
    away = change.drop([0, *range(4, 9), *range(15, 20)])
    assert away.abs().max() < 8 and (away == 0).any()


def test_without_penalty_it_is_least_squares(spark):
    rng = np.random.default_rng(7)
    y = np.cumsum(rng.normal(size=160))
    got = tr.trend_changes(weeks(spark, y), "sales", changes=6, penalty=0.0).orderBy("week").toPandas()
    t = np.arange(160.0)
    x = np.column_stack([np.ones(160), t / 159, *[f(2 * np.pi * k * t / tr.PERIOD) for k in (1, 2)
                                                  for f in (np.sin, np.cos)],
                         *[np.maximum(t / 159 - 0.8 * (j + 1) / 7, 0) for j in range(6)]])
    assert np.allclose(got.fitted, x @ np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)


def test_full_penalty_is_one_straight_line_and_series_are_apart(spark):
    rng = np.random.default_rng(8)
    a, b = np.arange(60.0) + rng.normal(size=60), -2.0 * np.arange(80) + rng.normal(size=80)
    df = weeks(spark, [*a[:30], None, *a[31:]]).unionByName(weeks(spark, b, "b")).unionByName(weeks(spark, [4.0], "c"))
    got = tr.trend_changes(df, "sales", by=["brand"], order=0, penalty=1.0).toPandas().sort_values(["brand", "week"])
    assert len(got) == 141 and (got.slope_change == 0).all()
    for name, y in (("a", a), ("b", b)):
        t = np.arange(len(y), dtype=float)
        keep = np.ones(len(y), bool)
        keep[30] = name != "a"
        line = np.polyval(np.polyfit(t[keep], y[keep], 1), t)
        assert np.allclose(got[got.brand == name].trend, line, atol=1e-6)
    assert got[got.brand == "c"].trend.iloc[0] == pytest.approx(4.0)


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(80, 9)), rng.normal(size=80)
    b = tr.lasso_on_gram(x.T @ x, x.T @ y, 3, 4.0)
    slope = x.T @ (y - x @ b)
    assert np.allclose(slope[:3], 0, atol=1e-8)
    for g, v in zip(slope[3:], b[3:]):
        assert abs(g) <= 4 + 1e-8 and (v == 0 or g == pytest.approx(4 * np.sign(v), abs=1e-7))
    assert (b[3:] == 0).any() and (b[3:] != 0).any()
