"""Random-intercept linear mixed model by maximum likelihood.

With t = σ_u² / σ², the inverse covariance of a group of size n_g is
(I − t/(1 + t n_g) 11') / σ², so every quantity the likelihood needs is a
sum over groups of that group's n_g, X'1, X'X, X'y, y'1 and y'y. The weight
t/(1 + t n_g) depends on the group's size alone, so groups of one size add up:
one ``groupBy(group)``, then one ``groupBy(size)``. N rows have at most
sqrt(2N) different group sizes; only those rows reach the driver, where the
one-dimensional search over t runs without further passes over the data. A model
with fewer terms needs sub-matrices of the same sums, so backward elimination
reads the data once however many models it fits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf, chi2_sf_1df
from .linear import Design, OlsFit, gram, ols_from_gram


@dataclass
class MixedFit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    sigma2: float
    tau2: float
    loglik: float
    n: float
    groups: int


def _group_sums(d: Design, group: str) -> DataFrame:
    cols = d.cols
    p = len(cols)
    aggs = [F.count(F.lit(1)).alias("ng"), F.sum(d.y).alias("sy"),
            F.sum(F.col(d.y) * F.col(d.y)).alias("syy")]
    for i in range(p):
        aggs += [F.sum(cols[i]).alias(f"s{i}"), F.sum(F.col(cols[i]) * F.col(d.y)).alias(f"sxy{i}")]
        for j in range(i, p):
            aggs.append(F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"c{i}_{j}"))
    return d.df.groupBy(group).agg(*aggs)


def _size_sums(groups: DataFrame, p: int) -> dict[str, np.ndarray]:
    """Per distinct group size: the number of groups and the sums over them of
    X'X, X'y, y'y and of the products of their column totals."""
    tot = ["ng"] + [f"s{i}" for i in range(p)]
    xy = ["sy"] + [f"sxy{i}" for i in range(p)]
    aggs = [F.count(F.lit(1)).alias("groups"), F.sum("syy").alias("yy"),
            F.sum(F.col("sy") * F.col("sy")).alias("tyy")]
    for i in range(p + 1):
        aggs += [F.sum(xy[i]).alias(f"xy{i}"),
                 F.sum(F.col(tot[i]) * F.col("sy")).alias(f"txy{i}")]
        for j in range(i, p + 1):
            xx = tot[j] if i == 0 else f"c{i - 1}_{j - 1}"
            aggs += [F.sum(xx).alias(f"xx{i}_{j}"),
                     F.sum(F.col(tot[i]) * F.col(tot[j])).alias(f"txx{i}_{j}")]
    rows = groups.groupBy(F.col("ng").alias("size")).agg(*aggs).orderBy("size").collect()

    def vector(name):
        return np.array([r[name] for r in rows], dtype=float)

    def matrix(name):
        out = np.zeros((len(rows), p + 1, p + 1))
        for i in range(p + 1):
            for j in range(i, p + 1):
                out[:, i, j] = out[:, j, i] = vector(f"{name}{i}_{j}")
        return out

    return {"size": vector("size"), "groups": vector("groups"), "yy": vector("yy"),
            "tyy": vector("tyy"), "xx": matrix("xx"), "txx": matrix("txx"),
            **{k: np.stack([vector(f"{k}{i}") for i in range(p + 1)], axis=1) for k in ("xy", "txy")}}


@dataclass
class MixedSums:
    """What the likelihood of a design and its sub-designs needs."""
    by_size: dict[str, np.ndarray]
    names: list[str]              # columns, the intercept first
    terms: list[str]

    @property
    def n(self) -> float:
        return float((self.by_size["groups"] * self.by_size["size"]).sum())


def mixed_sums(d: Design, group: str) -> MixedSums:
    """One pass over the rows; see ``_size_sums``."""
    return MixedSums(_size_sums(_group_sums(d, group), len(d.cols)),
                     ["Intercept", *d.names], ["Intercept", *d.terms])


def mixed_fit(d: Design, group: str, tol: float = 1e-10) -> MixedFit:
    """Fixed effects, σ², σ_u² and log-likelihood (ML, not REML)."""
    return mixed_from_sums(mixed_sums(d, group), tol=tol)


def mixed_from_sums(sums: MixedSums, keep: Sequence[int] | None = None,
                    tol: float = 1e-10) -> MixedFit:
    """The model on the columns ``keep`` (positions in ``sums.names``; all if
    not given)."""
    z, n = sums.by_size, sums.n
    at = list(range(len(sums.names))) if keep is None else sorted(keep)
    square = np.ix_(range(len(z["size"])), at, at)
    txx, txy = z["txx"][square], z["txy"][:, at]
    xx, xy, yy = z["xx"][square].sum(0), z["xy"][:, at].sum(0), float(z["yy"].sum())
    G = int(z["groups"].sum())

    def parts(t):
        c = t / (1 + t * z["size"])
        return (xx - np.einsum("g,gij->ij", c, txx), xy - c @ txy,
                yy - float(c @ z["tyy"]), float(z["groups"] @ np.log1p(t * z["size"])))

    def loglik(t):
        a, b, yy, ld = parts(t)
        beta = np.linalg.pinv(a) @ b
        q = max(yy - float(b @ beta), 1e-300)
        s2 = q / n
        return -n / 2 * (math.log(2 * math.pi * s2) + 1) - ld / 2, beta, a, s2

    # golden-section search on log t, plus the boundary t = 0
    lo, hi = -25.0, 12.0
    gr = (math.sqrt(5) - 1) / 2
    x1, x2 = hi - gr * (hi - lo), lo + gr * (hi - lo)
    f1, f2 = loglik(math.exp(x1))[0], loglik(math.exp(x2))[0]
    while hi - lo > tol * 1e3 and abs(hi - lo) > 1e-7:
        if f1 > f2:
            hi, x2, f2 = x2, x1, f1
            x1 = hi - gr * (hi - lo)
            f1 = loglik(math.exp(x1))[0]
        else:
            lo, x1, f1 = x1, x2, f2
            x2 = lo + gr * (hi - lo)
            f2 = loglik(math.exp(x2))[0]
    t_best = math.exp((lo + hi) / 2)
    best = loglik(t_best)
    zero = loglik(0.0)
    if zero[0] >= best[0]:
        t_best, best = 0.0, zero
    ll, beta, a, s2 = best
    return MixedFit([sums.names[i] for i in at], beta, np.linalg.pinv(a) * s2, float(s2),
                    float(t_best * s2), float(ll), n, G)


def mixed_tidy(spark: SparkSession, m: MixedFit) -> DataFrame:
    rows = []
    for i, nm in enumerate(m.names):
        se = math.sqrt(max(m.cov[i, i], 0.0))
        z = m.beta[i] / se if se > 0 else float("nan")
        pv = math.erfc(abs(z) / math.sqrt(2)) if se > 0 else float("nan")
        rows.append((nm, float(m.beta[i]), float(se), float(z), float(pv), "mixed"))
    rows.append(("Group Var", m.tau2, None, None, None, "mixed"))
    rows.append(("Residual Var", m.sigma2, None, None, None, "mixed"))
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, "
                                 "statistic double, p_value double, model string")


def likelihood_ratio(full_loglik: float, reduced_loglik: float, dof: int = 1) -> dict:
    """−2 Δ logLik against χ² (one df for one variance parameter)."""
    stat = max(-2 * (reduced_loglik - full_loglik), 0.0)
    p = chi2_sf_1df(stat) if dof == 1 else chi2_sf(stat, dof)
    return {"statistic": stat, "dof": dof, "p_value": p}


def term_tests(sums: MixedSums, active: Sequence[str], test: str = "wald"
               ) -> tuple[MixedFit, dict[str, tuple[float, int, float]]]:
    """The model of the ``active`` terms and, for every term that may be
    dropped from it, statistic, degrees of freedom and p-value.

    ``test``: "wald" (all columns of the term zero, from this one fit) or
    "chisq" (likelihood ratio against the model without the term, refitted).
    The intercept stays, and so does a term while a product with it is active.
    """
    if test not in ("wald", "chisq"):
        raise ValueError("test must be 'wald' or 'chisq'")

    def columns(terms):
        return [i for i, t in enumerate(sums.terms) if t in terms]

    at = columns(active)
    full = mixed_from_sums(sums, at)
    out = {}
    for term in active:
        inside = any(":" in o and term in o.split(":") for o in active if o != term)
        if term == "Intercept" or inside:
            continue
        own = [k for k, i in enumerate(at) if sums.terms[i] == term]
        if test == "wald":
            beta = full.beta[own]
            value = float(beta @ np.linalg.pinv(full.cov[np.ix_(own, own)]) @ beta)
        else:
            less = mixed_from_sums(sums, columns([t for t in active if t != term]))
            value = max(2 * (full.loglik - less.loglik), 0.0)
        out[term] = (value, len(own), chi2_sf(value, len(own)))
    return full, out


def backward_select_mixed(sums: MixedSums, alpha: float = 0.05, test: str = "wald"
                          ) -> tuple[MixedFit, list[tuple[str, float, int, float]],
                                     dict[str, tuple[float, int, float]]]:
    """Drop the term with the largest p-value and fit the mixed model
    again, until every term that may be dropped has p < alpha.

    Returns the final fit, the dropped terms in order (term, statistic, degrees
    of freedom, p-value when dropped), and the tests of the terms that stay. Of
    equal p-values the term that comes last in the design goes first.
    """
    active = list(dict.fromkeys(sums.terms))
    dropped = []
    while True:
        fit, tests = term_tests(sums, active, test)
        if not tests:
            return fit, dropped, tests
        worst = max(tests, key=lambda t: (tests[t][2], -tests[t][0], active.index(t)))
        if tests[worst][2] < alpha:
            return fit, dropped, tests
        active.remove(worst)
        dropped.append((worst, *tests[worst]))


def fixed_part(m: MixedFit, d: Design):
    acc = F.lit(float(m.beta[0]))
    for i, c in enumerate(d.cols):
        acc = acc + F.col(c) * float(m.beta[i + 1])
    return acc


def nakagawa_r2(m: MixedFit, d: Design) -> dict:
    """Marginal and conditional R² with the variance of the fixed part
    (population variance over rows, one aggregate pass)."""
    vf = float(d.df.agg(F.var_pop(fixed_part(m, d))).first()[0] or 0.0)
    tot = vf + m.tau2 + m.sigma2
    return {"var_fixed": vf, "var_random": m.tau2, "var_resid": m.sigma2,
            "r2_marginal": vf / tot, "r2_conditional": (vf + m.tau2) / tot}


def mixed_residuals(m: MixedFit, d: Design, group: str) -> DataFrame:
    """Fitted values with the predicted group effects (BLUPs):
    u_g = t n_g / (1 + t n_g) · mean fixed-part residual of the group."""
    t = m.tau2 / m.sigma2 if m.sigma2 > 0 else 0.0
    r = d.df.withColumn("__fx", fixed_part(m, d)).withColumn("__r", F.col(d.y) - F.col("__fx"))
    u = r.groupBy(group).agg((F.lit(t) * F.count(F.lit(1)) / (1 + F.lit(t) * F.count(F.lit(1)))
                              * F.avg("__r")).alias("group_effect"))
    return (r.join(u, group)
            .withColumn("fitted", F.col("__fx") + F.col("group_effect"))
            .withColumn("residual", F.col(d.y) - F.col("fitted"))
            .drop("__fx", "__r"))


def reduced_ols(d: Design) -> OlsFit:
    return ols_from_gram(gram(d))
