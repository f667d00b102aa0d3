"""Linear models from one distributed Gram pass.

The design matrix never leaves the cluster: one aggregate computes
n, X'1, X'X, X'y and y'y about a common shift (all JVM-side), the driver
solves the p x p system, and anything per row (fitted values, residuals,
bands) is a column expression with the coefficients as literals. Term
selection reuses the same Gram: dropping a term is a sub-matrix, no rescan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf, quantiles, student_t_sf


# rows averaged for the numeric shift of ``gram``; any number gives the same sums
SHIFT_ROWS = 1000


# ---------------------------------------------------------------- design
@dataclass
class Design:
    df: DataFrame                 # y + design columns, complete rows only
    y: str
    cols: list[str]               # internal column names, intercept excluded
    names: list[str]              # display names (statsmodels style)
    terms: list[str]              # term each column belongs to
    levels: dict[str, list[str]] = field(default_factory=dict)


def _levels(df: DataFrame, f: str) -> list[str]:
    """Sorted distinct levels of a factor: bounded by its cardinality."""
    return sorted(r[0] for r in df.select(f).where(F.col(f).isNotNull()).distinct().collect())


def design(df: DataFrame, y: str, numeric: Sequence[str] = (), factors: Sequence[str] = (),
           interactions: Sequence[tuple[str, str]] = (),
           extra: Sequence[tuple[str, Column]] = (),
           levels: dict[str, list[str]] | None = None, keep: Sequence[str] = ()) -> Design:
    """Numeric columns, treatment-coded factors (first sorted level is the
    reference), and ``a:b`` products; ``a*b`` in a formula is ``a + b + a:b``.
    ``extra`` adds precomputed column expressions (spline bases)."""
    levels = dict(levels or {})
    for f in factors:
        if f not in levels:
            levels[f] = _levels(df, f)
    needed = [y, *numeric, *factors, *keep]
    base = df.select(*[c for c in dict.fromkeys(needed)], *[e.alias(n) for n, e in extra]).dropna()
    cols, names, terms, exprs = [], [], [], []

    def add(expr: Column, name: str, term: str):
        c = f"__x{len(cols)}"
        cols.append(c)
        names.append(name)
        terms.append(term)
        exprs.append(expr.cast("double").alias(c))

    pieces: dict[str, list[tuple[Column, str]]] = {}
    for v in numeric:
        pieces[v] = [(F.col(v), v)]
    for n, _ in extra:
        pieces[n] = [(F.col(n), n)]
    for f in factors:
        pieces[f] = [(F.when(F.col(f) == lv, 1.0).otherwise(0.0), f"C({f})[T.{lv}]")
                     for lv in levels[f][1:]]
    order = [*numeric, *[n for n, _ in extra], *factors]
    for t in order:
        for e, nm in pieces[t]:
            add(e, nm, t)
    for a, b in interactions:
        term = f"{a}:{b}"
        for ea, na in pieces[a]:
            for eb, nb in pieces[b]:
                add(ea * eb, f"{na}:{nb}", term)
    out = base.select(F.col(y).cast("double").alias(y), *keep, *exprs)
    return Design(out, y, cols, names, terms, levels)


# ---------------------------------------------------------------- Gram
@dataclass
class Gram:
    """Sums of products about the means; names and terms open with the
    intercept, the arrays hold the other columns only."""
    n: float
    mean: np.ndarray              # (p,)
    ymean: float
    sxx: np.ndarray               # p x p
    sxy: np.ndarray
    syy: float
    names: list[str]
    terms: list[str]


def gram(d: Design) -> Gram:
    """One aggregate pass over all rows: all cross products of X and y.

    Values are shifted by the averages of the first ``SHIFT_ROWS`` rows before
    they are multiplied, then the sums are moved to the exact means. The result
    does not depend on the shift; it only keeps a mean that is large against
    the SD from cancelling digits.
    """
    cols = [*d.cols, d.y]
    p = len(d.cols)
    near = d.df.limit(SHIFT_ROWS).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shift = np.array([near[f"m{i}"] or 0.0 for i in range(p + 1)], dtype=float)
    moved = [F.col(c) - F.lit(float(k)) for c, k in zip(cols, shift)]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(p + 1):
        aggs.append(F.sum(moved[i]).alias(f"s{i}"))
        for j in range(i, p + 1):
            aggs.append(F.sum(moved[i] * moved[j]).alias(f"c{i}_{j}"))
    r = d.df.agg(*aggs).first().asDict()
    n = float(r["n"])
    total = np.array([r[f"s{i}"] or 0.0 for i in range(p + 1)], dtype=float)
    m = np.zeros((p + 1, p + 1))
    for i in range(p + 1):
        for j in range(i, p + 1):
            m[i, j] = m[j, i] = r[f"c{i}_{j}"] or 0.0
    m -= np.outer(total, total) / max(n, 1)
    mean = shift + total / max(n, 1)
    return Gram(n, mean[:p], float(mean[p]), m[:p, :p], m[:p, p], float(m[p, p]),
                ["Intercept", *d.names], ["Intercept", *d.terms])


# ---------------------------------------------------------------- OLS
@dataclass
class OlsFit:
    names: list[str]
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: float
    rss: float
    tss: float
    model: str = "ols"

    @property
    def p(self) -> int:
        return len(self.beta)

    @property
    def sigma2(self) -> float:
        return self.rss / max(self.n - self.p, 1)

    @property
    def loglik(self) -> float:
        return -self.n / 2 * (math.log(2 * math.pi * self.rss / self.n) + 1)


def ols_from_gram(g: Gram, keep: Sequence[int] | None = None, model: str = "ols") -> OlsFit:
    """Least squares with an intercept on the columns ``keep`` (positions in
    ``g.names``; the intercept, 0, always stays)."""
    idx = [i - 1 for i in (range(len(g.names)) if keep is None else keep) if i > 0]
    sxx, sxy, mean = g.sxx[np.ix_(idx, idx)], g.sxy[idx], g.mean[idx]
    inv = np.linalg.pinv(sxx)
    slope = inv @ sxy
    rss = max(float(g.syy - 2 * slope @ sxy + slope @ sxx @ slope), 0.0)
    beta = np.concatenate([[g.ymean - mean @ slope], slope])
    # inverse of the matrix with the intercept
    at = inv @ mean
    full = np.block([[np.array([[1 / g.n + mean @ at]]), -at[None, :]], [-at[:, None], inv]])
    names = ["Intercept", *[g.names[i + 1] for i in idx]]
    terms = ["Intercept", *[g.terms[i + 1] for i in idx]]
    fit = OlsFit(names, terms, beta, full, g.n, rss, g.syy, model)
    fit.cov = full * fit.sigma2
    return fit


def ols_fit(df: DataFrame, y: str, numeric: Sequence[str] = (), factors: Sequence[str] = (),
            interactions: Sequence[tuple[str, str]] = (), extra=()) -> tuple[OlsFit, Design, Gram]:
    """Ordinary least squares with treatment-coded factors and products."""
    d = design(df, y, numeric, factors, interactions, extra)
    g = gram(d)
    return ols_from_gram(g), d, g


def t_quantile(p: float, dof: float) -> float:
    """Two-sided critical value: t with P(|T| > t) = 1 - p."""
    lo, hi = 0.0, 1e3
    target = 1 - p
    for _ in range(200):
        mid = (lo + hi) / 2
        if student_t_sf(mid, dof) > target:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def tidy(spark: SparkSession, fit: OlsFit, level: float = 0.95) -> DataFrame:
    """Term, estimate, SE, t, p, interval, model name."""
    dof = max(fit.n - fit.p, 1)
    tq = t_quantile(level, dof)
    rows = []
    for i, nm in enumerate(fit.names):
        est = float(fit.beta[i])
        se = float(math.sqrt(max(fit.cov[i, i], 0.0)))
        t = est / se if se > 0 else float("nan")
        p = student_t_sf(abs(t), dof) if se > 0 else float("nan")
        rows.append((nm, est, se, t, p, est - tq * se, est + tq * se, fit.model))
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, "
                                 "statistic double, p_value double, conf_low double, "
                                 "conf_high double, model string")


def model_performance(spark: SparkSession, fit: OlsFit, extra_params: int = 0,
                      loglik: float | None = None) -> DataFrame:
    """N, parameters, RMSE, sigma, R², adjusted R², logLik, AIC, BIC
    (AIC / BIC count the residual variance as a parameter, as R does)."""
    k = fit.p + 1 + extra_params
    ll = fit.loglik if loglik is None else loglik
    r2 = 1 - fit.rss / fit.tss if fit.tss > 0 else float("nan")
    adj = 1 - (1 - r2) * (fit.n - 1) / max(fit.n - fit.p, 1)
    row = (fit.model, int(fit.n), fit.p, math.sqrt(fit.rss / fit.n), math.sqrt(fit.sigma2), r2, adj,
           ll, -2 * ll + 2 * k, -2 * ll + math.log(fit.n) * k)
    return spark.createDataFrame([row], "model string, n long, params int, rmse double, "
                                 "sigma double, r2 double, adj_r2 double, loglik double, "
                                 "aic double, bic double")


def predict_col(fit: OlsFit, d: Design) -> Column:
    """Fitted value x'β as a column expression on the design table."""
    acc = F.lit(float(fit.beta[0]))
    for i, c in enumerate(d.cols):
        if d.names[i] in fit.names:
            acc = acc + F.col(c) * float(fit.beta[fit.names.index(d.names[i])])
    return acc


def residual_table(fit: OlsFit, d: Design) -> DataFrame:
    """Fitted, residual and the root of the absolute residual per row."""
    f = predict_col(fit, d)
    return (d.df.withColumn("fitted", f)
            .withColumn("residual", F.col(d.y) - F.col("fitted"))
            .withColumn("sqrt_abs_resid", F.sqrt(F.abs("residual"))))


def binned_trend(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Mean of y in equal-width bins of x (the smooth behind a
    residual plot; one aggregate instead of a local regression)."""
    mm = df.agg(F.min(x).alias("__mn"), F.max(x).alias("__mx"))
    w = (F.col("__mx") - F.col("__mn")) / bins
    b = F.coalesce(F.least(F.floor(F.try_divide(F.col(x) - F.col("__mn"), w)), F.lit(bins - 1)),
                   F.lit(0)).cast("int")
    return (df.crossJoin(F.broadcast(mm)).groupBy(b.alias("bin"))
            .agg(F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"), F.count(F.lit(1)).alias("n")))


def breusch_pagan(fit: OlsFit, d: Design, regressors: Sequence[str] | None = None) -> dict:
    """n·R² of squared residuals on the regressors (all design columns,
    as the Python reference; ``regressors=['fitted']`` gives the R form)."""
    r = residual_table(fit, d).withColumn("__e2", F.col("residual") ** 2)
    cols = list(regressors) if regressors else d.cols
    aux = Design(r.select("__e2", *cols), "__e2", cols, cols, cols)
    g = gram(aux)
    af = ols_from_gram(g)
    r2 = 1 - af.rss / af.tss if af.tss > 0 else 0.0
    lm = fit.n * r2
    dof = len(cols)
    return {"statistic": lm, "dof": dof, "p_value": chi2_sf(lm, dof)}


def vif(g: Gram) -> list[tuple[str, float, int, float]]:
    """M4: (generalised) variance inflation per term from the Gram matrix:
    GVIF = det(R_tt) det(R_oo) / det(R); reported with GVIF^(1/(2 df))."""
    p = len(g.names) - 1
    sd = np.sqrt(np.clip(np.diag(g.sxx), 1e-300, None))
    r = g.sxx / np.outer(sd, sd)
    terms = g.terms[1:]
    out = []
    det_all = np.linalg.det(r)
    for t in dict.fromkeys(terms):
        idx = [i for i in range(p) if terms[i] == t]
        oth = [i for i in range(p) if terms[i] != t]
        d1 = np.linalg.det(r[np.ix_(idx, idx)])
        d2 = np.linalg.det(r[np.ix_(oth, oth)]) if oth else 1.0
        gv = float(d1 * d2 / det_all)
        out.append((t, gv, len(idx), gv ** (1 / (2 * len(idx)))))
    return out


def backward_select(g: Gram, alpha: float = 0.05, protect: Sequence[str] = ("Intercept",)
                    ) -> tuple[OlsFit, list[tuple[str, float]]]:
    """Drop the least significant term (likelihood-ratio p over all its
    columns) until every term has p < alpha. A main effect stays while an
    interaction containing it remains. Works on sub-matrices of one Gram."""
    active = [t for t in dict.fromkeys(g.terms)]
    dropped = []

    def cols_of(ts):
        return [i for i, t in enumerate(g.terms) if t in ts]

    while True:
        full = ols_from_gram(g, cols_of(active))
        cand = []
        for t in active:
            if t in protect:
                continue
            if any(":" in o and t in o.split(":") for o in active if o != t):
                continue
            red = ols_from_gram(g, cols_of([a for a in active if a != t]))
            k = len(cols_of([t]))
            lr = full.n * math.log(max(red.rss, 1e-300) / max(full.rss, 1e-300))
            cand.append((chi2_sf(lr, k), t))
        if not cand:
            return full, dropped
        p, worst = max(cand)
        if p < alpha:
            return full, dropped
        active.remove(worst)
        dropped.append((worst, p))


# ---------------------------------------------------------------- splines
def natural_spline_knots(df: DataFrame, col: str, dof: int = 3) -> list[float]:
    """Boundary knots at min / max, ``dof - 1`` interior knots at quantiles."""
    inner = [k / dof for k in range(1, dof)]
    q = quantiles(df, col, [0.0, *inner, 1.0])
    return q


def natural_spline_cols(x: Column, knots: Sequence[float], prefix: str) -> list[tuple[str, Column]]:
    """Natural cubic spline basis (linear beyond the boundary knots),
    truncated-power form: N1 = x, N(k+2) = d_k - d_(K-1),
    d_k = ((x - ξ_k)+³ - (x - ξ_K)+³) / (ξ_K - ξ_k)."""
    k = list(knots)
    big = k[-1]

    def pos3(c):
        return F.pow(F.greatest(c, F.lit(0.0)), 3)

    def dk(xi):
        return (pos3(x - xi) - pos3(x - big)) / (big - xi)

    out = [(f"{prefix}1", x.cast("double"))]
    last = dk(k[-2])
    for j in range(len(k) - 2):
        out.append((f"{prefix}{j + 2}", dk(k[j]) - last))
    return out


def spline_effect(spark: SparkSession, fit: OlsFit, d: Design, var: str, knots: Sequence[float],
                  prefix: str, lo: int, hi: int, level: float = 0.95,
                  named: Sequence[float] = (25, 50)) -> DataFrame:
    """Prediction and band on a one-unit grid of ``var``; factors at
    their reference level, other numeric inputs at 0. ``is_named`` marks the
    values that a report names. x'(X'X)^-1 x uses the p x p covariance as
    literals."""
    grid = spark.range(lo, hi + 1).select(F.col("id").cast("double").alias(var))
    basis = dict(natural_spline_cols(F.col(var), knots, prefix))
    vec = []
    for nm in fit.names:
        if nm == "Intercept":
            vec.append(F.lit(1.0))
        elif nm in basis:
            vec.append(basis[nm])
        else:
            vec.append(F.lit(0.0))
    g = grid.select(var, *[v.alias(f"__v{i}") for i, v in enumerate(vec)])
    pred = sum((F.col(f"__v{i}") * float(fit.beta[i]) for i in range(fit.p)), F.lit(0.0))
    var_e = sum((F.col(f"__v{i}") * F.col(f"__v{j}") * float(fit.cov[i, j])
                 for i in range(fit.p) for j in range(fit.p) if fit.cov[i, j] != 0), F.lit(0.0))
    tq = t_quantile(level, max(fit.n - fit.p, 1))
    se = F.sqrt(F.greatest(var_e, F.lit(0.0)))
    return g.select(var, pred.alias("prediction"), se.alias("se"),
                    (pred - tq * se).alias("lower"), (pred + tq * se).alias("upper"),
                    F.col(var).isin(*[float(v) for v in named]).alias("is_named"))
