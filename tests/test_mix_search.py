"""Adaptive search: repeatable, inside its ranges, better than as many
independent draws, and each generation as a plain version makes it."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortia.operators import mix as mm
from cohortia.operators import mix_search as ms

RANGES = {"a b": (0.0, 1.0), "c": (-5.0, 5.0), "d": (10.0, 11.0), "e": (0.0, 1.0)}


def fit(candidates):
    """A valley with its floor at (0.2, 3, 10.9, anything)."""
    q = (F.col("`a b`") - 0.2) ** 2 + ((F.col("c") - 3) / 10) ** 2 + (F.col("d") - 10.9) ** 2
    return candidates.select("candidate", "trial", "iteration", F.when(F.col("candidate") == 4, float("nan"))
                             .otherwise(q).alias("nrmse"))


@pytest.fixture(scope="module")
def found(spark):
    return ms.adaptive_search(spark, RANGES, fit, F.col("nrmse"), size=12, generations=14, trials=3, seed=1).toPandas()


def test_better_than_independent_draws(spark, found):
    assert len(found) == 504 and found.candidate.is_unique
    assert (found.groupby(["trial", "generation"]).size() == 12).all()
    assert (found.candidate == found.iteration * 3 + found.trial).all()
    for n, (lo, hi) in RANGES.items():
        assert found[n].between(lo, hi).all()
    drawn = fit(mm.candidate_params(spark, RANGES, 168, 1, 3)).toPandas()
    for t in range(3):
        assert found[found.trial == t].loss.min() < 0.5 * drawn[drawn.trial == t].nrmse.min()


def test_same_search_again(spark, found):
    again = ms.adaptive_search(spark, RANGES, fit, F.col("nrmse"), size=12, generations=14, trials=3, seed=1).toPandas()
    order = ["candidate"]
    pd.testing.assert_frame_equal(found.sort_values(order, ignore_index=True),
                                  again.sort_values(order, ignore_index=True))
    other = ms.adaptive_search(spark, RANGES, fit, F.col("nrmse"), size=12, generations=2, trials=3, seed=2).toPandas()
    assert not np.isclose(other.sort_values(order).loss.iloc[0], found.sort_values(order).loss.iloc[0])


def test_members_come_from_the_best_so_far(spark, found):
    """Replays the selection: every new member lies between its parent, the
    best and a difference of two other members of its trial."""
    names = list(RANGES)
    for t in range(3):
        own = found[found.trial == t].assign(slot=lambda f: f.iteration % 12)
        pop = own[own.generation == 0].set_index("slot").sort_index()
        for g in range(1, 14):
            new = own[own.generation == g].set_index("slot").sort_index()
            x, best = pop[names].to_numpy(), pop.loc[pop.loss.idxmin(), names].to_numpy(float)
            for s in range(12):
                y = new.loc[s, names].to_numpy(float)
                fits = False
                for a in range(12):
                    for b in range(12):
                        to = x[s] + ms.STEP * (best - x[s]) + ms.STEP * (x[a] - x[b])
                        back = [min(max(2 * lo - v if v < lo else 2 * hi - v if v > hi else v, lo), hi)
                                for v, (lo, hi) in zip(to, RANGES.values())]
                        fits |= all(np.isclose(v, p) or np.isclose(v, q) for v, p, q in zip(y, x[s], back))
                assert fits and not np.allclose(y, x[s], atol=0)
            better = new.loss < pop.loss
            pop = pd.concat([pop[~better], new[better]]).sort_index()


def test_failed_fits_never_win(found):
    assert np.isinf(found[found.candidate == 4].loss.iloc[0])


def test_population_size(spark):
    with pytest.raises(ValueError):
        ms.adaptive_search(spark, RANGES, fit, F.col("nrmse"), size=2)
