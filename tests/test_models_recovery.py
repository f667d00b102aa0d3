"""Recovery tests: fit data drawn from known coefficients."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import linear as lm
from cohortia.operators import mixed as mx


@pytest.fixture(scope="module")
def sim(spark):
    rng = np.random.default_rng(7)
    G, per = 40, 60
    g = np.repeat(np.arange(G), per)
    u = rng.normal(0, 1.0, G)[g]
    x = rng.normal(0, 1, G * per)
    f = rng.choice(["a", "b", "c"], G * per)
    y = 1.0 + 2.0 * x + np.where(f == "b", 0.5, 0.0) + np.where(f == "c", -1.0, 0.0) + u \
        + rng.normal(0, 0.5, G * per)
    rows = [(int(a), float(b), str(c), float(d)) for a, b, c, d in zip(g, x, f, y)]
    return spark.createDataFrame(rows, "grp int, x double, f string, y double"), (g, x, f, y)


def test_ols_matches_numpy(spark, sim):
    df, (g, x, f, y) = sim
    fit, d, gr = lm.ols_fit(df, "y", ["x"], ["f"], [("x", "f")])
    X = np.column_stack([np.ones_like(x), x, f == "b", f == "c", x * (f == "b"), x * (f == "c")]).astype(float)
    beta, rss, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert np.allclose(fit.beta, beta, atol=1e-8)
    assert fit.names[:4] == ["Intercept", "x", "C(f)[T.b]", "C(f)[T.c]"]
    assert abs(fit.rss - float(rss[0])) / float(rss[0]) < 1e-8


def test_mixed_recovers_variances(spark, sim):
    df, _ = sim
    d = lm.design(df, "y", ["x"], ["f"], keep=["grp"])
    m = mx.mixed_fit(d, "grp")
    assert abs(m.beta[1] - 2.0) < 0.05
    assert 0.4 < m.tau2 < 2.0 and abs(m.sigma2 - 0.25) < 0.03
    red = mx.reduced_ols(d)
    lr = mx.likelihood_ratio(m.loglik, red.loglik)
    assert lr["statistic"] > 100 and lr["p_value"] < 1e-10
    r2 = mx.nakagawa_r2(m, d)
    assert 0 < r2["r2_marginal"] < r2["r2_conditional"] < 1


def test_mixed_loglik_matches_dense_covariance(spark, sim):
    df, _ = sim
    d = lm.design(df, "y", ["x"], keep=["grp"])
    m = mx.mixed_fit(d, "grp")
    t = d.df.select("grp", *[F.col(c).cast("double") for c in d.cols], d.y).toPandas()
    ll = 0.0
    for _, g in t.groupby("grp"):
        v = m.sigma2 * np.eye(len(g)) + m.tau2
        e = g[d.y].to_numpy() - m.beta[0] - g[d.cols].to_numpy() @ m.beta[1:]
        ll -= (len(g) * np.log(2 * np.pi) + np.linalg.slogdet(v)[1] + e @ np.linalg.solve(v, e)) / 2
    assert abs(ll - m.loglik) < 1e-6 * abs(ll)


def test_backward_select_drops_noise(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x1, x2, x3 = rng.normal(size=(3, n))
    y = 3 * x1 - 2 * x2 + rng.normal(0, 1, n)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for a, b, c, d in zip(x1, x2, x3, y)],
                               "x1 double, x2 double, x3 double, y double")
    g = lm.gram(lm.design(df, "y", ["x1", "x2", "x3"]))
    fit, dropped = lm.backward_select(g)
    assert [t for t, _ in dropped] == ["x3"]
    v = dict((t, gv) for t, gv, _, _ in lm.vif(g))
    assert all(0.99 < v[t] < 1.05 for t in ("x1", "x2", "x3"))


def test_gram_keeps_digits_when_means_are_large(spark):
    rng = np.random.default_rng(5)
    x = 1e8 + rng.normal(size=2000)
    y = 1e8 + 2 * (x - 1e8) + rng.normal(0, 0.1, 2000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit, _, _ = lm.ols_fit(df, "y", ["x"])
    dx, dy = x - x.mean(), y - y.mean()
    slope = dx @ dy / (dx @ dx)
    assert abs(fit.beta[1] - slope) < 1e-8 and abs(fit.rss / ((dy - slope * dx) ** 2).sum() - 1) < 1e-6
    empty = lm.gram(lm.design(df.limit(0), "y", ["x"]))
    assert empty.n == 0 and not empty.sxx.any()


def test_pca_scores_are_the_projections(spark):
    from cohortia.operators import models as md
    rng = np.random.default_rng(6)
    a = rng.normal(size=(300, 3)) @ np.array([[1, 0.8, 0], [0, 0.6, 0.3], [0, 0, 1.0]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "i int, a double, b double, c double")
    got = np.array([[r["PC1"], r["PC2"]] for r in md.pca_scores(df, ["a", "b", "c"], 2).orderBy("i").collect()])
    z = (a - a.mean(0)) / a.std(0, ddof=1)
    value, vector = np.linalg.eigh(np.corrcoef(z.T))
    for j, k in enumerate((2, 1)):
        v = vector[:, k] * np.sign(vector[np.argmax(np.abs(vector[:, k])), k])
        assert np.allclose(got[:, j], z @ v, atol=1e-8)


def _selection_table(spark, seed=4, n=1500):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 30, n)
    cols = {f"x{k}": rng.normal(0, 1, n) for k in range(5)}
    f = rng.choice(["a", "b", "c"], n)
    y = (2 + 1.5 * cols["x0"] + 0.06 * cols["x1"] + 0.3 * cols["x0"] * cols["x2"] + rng.normal(0, 1, 30)[g]
         + rng.normal(0, 1, n))
    rows = [(int(a), *(float(v[i]) for v in cols.values()), str(f[i]), float(y[i])) for i, a in enumerate(g)]
    return spark.createDataFrame(rows, "grp int, x0 double, x1 double, x2 double, x3 double, x4 double, "
                                       "f string, y double")


@pytest.mark.parametrize("test", ["wald", "chisq"])
def test_mixed_elimination_equals_refits_from_scratch(spark, test):
    df = _selection_table(spark).persist()
    numeric, products = [f"x{k}" for k in range(5)], [("x0", "x2"), ("x3", "x4")]
    d = lm.design(df, "y", numeric, ["f"], products, keep=["grp"])
    fit, dropped, kept = mx.backward_select_mixed(mx.mixed_sums(d, "grp"), test=test)

    def refit(terms):
        dd = lm.design(df, "y", [t for t in terms if t in numeric], ["f"] if "f" in terms else [],
                       [p for p in products if ":".join(p) in terms], keep=["grp"])
        return mx.mixed_fit(dd, "grp"), dd

    active, order = [*numeric, "f", "x0:x2", "x3:x4"], []
    while True:
        m, dd = refit(active)
        p = {}
        for t in active:
            if any(":" in o and t in o.split(":") for o in active if o != t):
                continue
            own = [i + 1 for i, u in enumerate(dd.terms) if u == t]
            if test == "wald":
                b, v = m.beta[own], m.cov[np.ix_(own, own)]
                stat = float(b @ np.linalg.solve(v, b))
            else:
                stat = 2 * (m.loglik - refit([u for u in active if u != t])[0].loglik)
            p[t] = mx.chi2_sf(max(stat, 0.0), len(own))
        worst = max(p, key=p.get)
        if p[worst] < 0.05:
            break
        active.remove(worst)
        order.append((worst, p[worst]))
    assert [t for t, *_ in dropped] == [t for t, _ in order]
    assert np.allclose([x[-1] for x in dropped], [v for _, v in order], rtol=1e-5)
    assert set(active) == set(fit.names[1:]) | ({"f"} & set(active)) and "x0:x2" in active
    assert np.allclose(fit.loglik, m.loglik) and set(kept) == set(p)
    df.unpersist()


def test_mixed_elimination_knows_its_tests():
    with pytest.raises(ValueError):
        mx.term_tests(mx.MixedSums({}, [], []), [], "f")
