"""Continuous budget: optimality conditions, never below the grid, brands."""
import itertools

import numpy as np
import pytest

from cohortia.operators import budget as bu
from cohortia.operators import mix as mm


def brands(seed, n=16, channels=4):
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(n):
        for c in range(channels if b else 1):
            rows.append((f"b{b}", f"c{c}", float(rng.uniform(1, 10)), float(rng.uniform(0.5, 20)),
                         float(rng.choice([0.6, 1.0, 2.0, 3.0])), float(rng.uniform(1, 15))))
    return rows


SCHEMA = "brand string, channel string, current double, beta double, alpha double, inflexion double"


def test_optimality_conditions_and_grid(spark):
    rows = brands(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = bu.optimise_budget(df, 0.2, 2.5, by=["brand"]).toPandas()
    grid = mm.allocate_budget(df, 0.2, 2.5, 100, by=["brand"]).toPandas().groupby("brand").total_response.first()
    assert len(got) == len(rows)
    better = 0
    for name, g in got.groupby("brand"):
        lo, hi, s, slope = (v.to_numpy() for v in (0.2 * g.current, 2.5 * g.current, g.spend_opt, g.slope))
        assert (s >= lo - 1e-9).all() and (s <= hi + 1e-9).all() and s.sum() <= g.current.sum() * (1 + 1e-9)
        assert g.total_response.iloc[0] >= grid[name] - 1e-9
        better += g.total_response.iloc[0] > grid[name] * (1 + 1e-6)
        inside = (s > lo * (1 + 1e-5)) & (s < hi * (1 - 1e-5))
        if s.sum() < g.current.sum() * (1 - 1e-7):
            assert not inside.any() or slope[inside].max() < 1e-6
            continue
        if inside.any():
            price = slope[inside].mean()
            assert np.allclose(slope[inside], price, rtol=1e-3)
            assert (slope[s >= hi * (1 - 1e-5)] >= price * (1 - 1e-3)).all()
    assert better > 8


@pytest.mark.parametrize("seed", range(4))
def test_no_fine_grid_is_better(seed):
    rng = np.random.default_rng(seed)
    b = bu.Brand(rng.uniform(1, 20, 3), rng.choice([0.7, 1.0, 2.5, 4.0], 3), rng.uniform(1, 12, 3),
                 np.full(3, 0.5), np.full(3, 12.0))
    for budget in (3.0, 9.0, 20.0):
        coarse = np.linspace(0.5, 12, 24)
        start = max((np.array([x, y, z]) for x, y, z in itertools.product(coarse, coarse, coarse)
                     if x + y + z <= budget), key=lambda x: b.value(x).sum())
        s = bu.best_spends(b, budget, start)
        steps = np.linspace(0.5, 12, 47)
        best = max(b.value(np.array([x, y, min(12.0, budget - x - y)])).sum()
                   for x, y in itertools.product(steps, steps) if 0.5 <= budget - x - y)
        assert s.sum() <= budget * (1 + 1e-9) and b.value(s).sum() >= best - 1e-9


def test_edges(spark):
    rows = [("low", "a", 1.0, 5.0, 2.0, 3.0), ("none", "a", 4.0, -1.0, 1.0, 2.0), ("none", "b", 4.0, 3.0, 1.0, 2.0),
            ("null", "a", None, 1.0, 1.0, 1.0), ("null", "b", 2.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["brand"], r["channel"]): r["spend_opt"]
           for r in bu.optimise_budget(df, 0.5, 1.5, by=["brand"]).collect()}
    assert got == {("low", "a"): pytest.approx(1.0), ("none", "a"): pytest.approx(2.0),
                   ("none", "b"): pytest.approx(6.0), ("null", "b"): pytest.approx(2.0)}
    one = df.filter("brand = 'low'").drop("brand")
    assert bu.optimise_budget(one, 0.5, 1.5, budget=0.4).count() == 0
    assert bu.optimise_budget(one, 0.5, 1.5, budget=100.0).first()["spend_opt"] == pytest.approx(1.5)
    assert bu.optimise_budget(one.limit(0)).count() == 0
