"""Covariance structure model: recovery, derivatives, standard errors, edges."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortia.operators import covariance as cs
from cohortia.operators import survey as sv

BLOCKS = {"A": ["a1", "a2", "a3"], "B": ["b1", "b2", "b3"], "C": ["c1", "c2", "c3"]}
PATHS = [("A", "C")]
S = cs.structure(BLOCKS, PATHS)
# loadings, path, variances of A, B, C, covariance of A and B, item variances
TRUE = np.array([0.8, 1.2, 0.9, 1.1, 0.7, 1.3, 0.6, 1.0, 0.8, 0.5, 0.3] + [0.4, 0.5, 0.6] * 3)


def sample(n, seed=5):
    x = np.random.default_rng(seed).multivariate_normal(np.zeros(9), cs.implied(S, TRUE), n)
    return pd.DataFrame(x + 10.0, columns=S.items).assign(id=range(n))


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame(sample(3000)).cache()


def test_parameters_are_recovered_and_scales_do_not_matter(spark, answers):
    m = cs.covariance_fit(answers, BLOCKS, PATHS)
    assert m.converged and S.names == m.structure.names
    assert np.all(np.abs(m.theta - TRUE) < 4 * m.se)
    # another unit of one item changes its own parameters only
    other = cs.covariance_fit(answers.withColumn("a2", F.col("a2") * 100), BLOCKS, PATHS)
    at = S.names.index(("a2", "~", "A"))
    assert np.isclose(other.theta[at], 100 * m.theta[at], rtol=1e-5)
    assert np.isclose(other.value, m.value, rtol=1e-6)
    fit = cs.covariance_measures(m)
    assert fit["df"] == 45 - S.size and fit["chisq"] < 60 and fit["cfi"] > 0.99 and fit["converged"] == 1
    rows = {(r.lval, r.op, r.rval): r for r in cs.covariance_table(spark, m).collect()}
    assert rows[("a1", "~", "A")].estimate == 1.0 and rows[("a1", "~", "A")].se is None
    assert rows[("C", "~", "A")].p_value < 1e-6 and len(rows) == S.size + 3


def test_gradient_equals_differences():
    r = np.corrcoef(sample(500)[S.items].to_numpy().T)
    value, grad, info = cs.discrepancy(S, TRUE, r)
    step = np.eye(S.size) * 1e-6
    diff = [(cs.discrepancy(S, TRUE + e, r)[0] - cs.discrepancy(S, TRUE - e, r)[0]) / 2e-6 for e in step]
    assert np.allclose(grad, diff, atol=1e-6)
    # at its own covariances the value is zero and the curvature is the information
    sigma = cs.implied(S, TRUE)
    value, grad, info = cs.discrepancy(S, TRUE, sigma)
    assert abs(value) < 1e-9 and np.allclose(grad, 0, atol=1e-9)
    bend = [(cs.discrepancy(S, TRUE + e, sigma)[1] - cs.discrepancy(S, TRUE - e, sigma)[1]) / 2e-6 for e in step]
    assert np.allclose(info, bend, atol=1e-4)


def test_bootstrap_agrees_with_standard_errors(answers):
    m = cs.covariance_fit(answers, BLOCKS, PATHS)
    boot = sv.bootstrap_summary(cs.bootstrap_covariance(answers, "id", m, n_boot=400)).toPandas()
    got = boot.set_index("parameter").boot_se
    assert len(boot) == S.size and (boot.failed == 0).all()
    ratio = np.array([got[" ".join(t)] for t in S.names]) / m.se
    assert np.all((ratio > 0.8) & (ratio < 1.25))


def test_scores_follow_the_latent_variables(spark):
    rng = np.random.default_rng(1)
    n = 2000
    a, b, e = rng.normal(size=(3, n))
    lat = {"A": a, "B": 0.4 * a + b, "C": 0.7 * a + e}
    pdf = pd.DataFrame({c: lat[k] + 0.4 * rng.normal(size=n) for k in BLOCKS for c in BLOCKS[k]}).assign(id=range(n))
    df = spark.createDataFrame(pdf).withColumn("a1", F.when(F.col("id") > 0, F.col("a1")))
    m = cs.covariance_fit(df, BLOCKS, PATHS)
    out = cs.covariance_scores(df, m, "id").orderBy("id").toPandas()
    assert np.isnan(out.A[0]) and m.n == n - 1
    for k in BLOCKS:
        assert np.corrcoef(out[k][1:], lat[k][1:])[0, 1] > 0.95


def test_edges(spark, answers):
    few = answers.limit(50)
    with pytest.raises(ValueError, match="constant items: b2"):
        cs.covariance_fit(few.withColumn("b2", F.lit(3.0)), BLOCKS, PATHS)
    with pytest.raises(ValueError, match="linear combinations"):
        cs.covariance_fit(few.withColumn("b2", F.col("b1") * 2), BLOCKS, PATHS)
    with pytest.raises(ValueError, match="complete rows"):
        cs.covariance_fit(few.where("id < 0"), BLOCKS, PATHS)
    with pytest.raises(ValueError, match="one block"):
        cs.structure({"A": ["x"], "B": ["x"]}, [])
    # a block of unrelated items: variances stay above their floor
    noise = spark.createDataFrame(pd.DataFrame(
        np.random.default_rng(3).normal(size=(200, 9)), columns=S.items))
    m = cs.covariance_fit(noise, BLOCKS, PATHS)
    assert np.all(m.theta[-9:] > 0) and np.isfinite(m.value)


def test_sums_do_not_depend_on_the_number_of_tasks(answers):
    few = answers.where("id < 300").repartition(20)
    a = sv.bootstrap_moments(few, "id", ["a1", "b1"], 20, tasks=1).orderBy("rep").toPandas()
    b = sv.bootstrap_moments(few, "id", ["a1", "b1"], 20, tasks=6).orderBy("rep").toPandas()
    assert np.allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-12)
