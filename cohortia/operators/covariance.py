"""Covariance structure model of survey items (V1-V3): latent variables
measured by item blocks and joined by paths, fitted by maximum likelihood.

The likelihood needs the item covariances only, so the data pass is the one
aggregate of ``survey.item_moments``; the fit runs on the k x k matrix. Every
parameter moves the implied covariance by one symmetric pair u v' + v u', so
the gradient and the whole information matrix are a few products of k x q
matrices. Replicates of the bootstrap are weighted sums (``bootstrap_moments``)
and are fitted by the tasks that hold them, started at the full-sample result.

Rows with a null item are left out. A constant item, items that are linear
combinations of each other, a block without items and a table without complete
rows raise ``ValueError``; a replicate without a solution has null estimates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .survey import bootstrap_moments, corr_from_moments, item_moments

# Variances stay at or above this share of the item's variance.
FLOOR = 1e-6


@dataclass
class Structure:
    """Free parameters in a fixed order: loadings but the first of a block
    (which is 1), paths, latent variances and covariances, item variances."""
    items: list[str]
    latents: list[str]
    marker: list[int]                       # per latent, the item with loading 1
    loads: list[tuple[int, int]]            # item, latent
    paths: list[tuple[int, int]]            # target, source
    psi: list[tuple[int, int]]              # latent, latent (equal: variance)
    names: list[tuple[str, str, str]] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.loads) + len(self.paths) + len(self.psi) + len(self.items)


def structure(blocks: Mapping[str, Sequence[str]], paths: Sequence[tuple[str, str]],
              covariances: Sequence[tuple[str, str]] | None = None) -> Structure:
    """The parameters of a model. Unless ``covariances`` lists the pairs,
    latents without a predecessor covary, and so do the disturbances of latents
    that have one but no successor."""
    items = [c for b in blocks.values() for c in b]
    if any(not b for b in blocks.values()) or len(set(items)) < len(items):
        raise ValueError("every block needs items and an item belongs to one block")
    latents = list(blocks)
    pos = {c: i for i, c in enumerate(items)}
    lat = {b: j for j, b in enumerate(latents)}
    marker = [pos[blocks[b][0]] for b in latents]
    loads = [(pos[c], lat[b]) for b in latents for c in blocks[b][1:]]
    arrows = [(lat[t], lat[a]) for a, t in paths]
    if covariances is None:
        targets, sources = {t for t, _ in arrows}, {a for _, a in arrows}
        outer = [j for j in range(len(latents)) if j not in targets]
        ends = [j for j in range(len(latents)) if j in targets and j not in sources]
        pairs = [(g[i], g[k]) for g in (outer, ends) for i in range(len(g)) for k in range(i + 1, len(g))]
    else:
        pairs = [(lat[a], lat[b]) for a, b in covariances]
    psi = [(j, j) for j in range(len(latents))] + pairs
    names = ([(items[i], "~", latents[j]) for i, j in loads]
             + [(latents[t], "~", latents[a]) for t, a in arrows]
             + [(latents[a], "~~", latents[b]) for a, b in psi] + [(c, "~~", c) for c in items])
    return Structure(items, latents, marker, loads, arrows, psi, names)


def _matrices(s: Structure, theta: np.ndarray):
    """Loadings, (I - B)^-1, latent covariances and item variances."""
    p, m = len(s.items), len(s.latents)
    lam, b, psi = np.zeros((p, m)), np.zeros((m, m)), np.zeros((m, m))
    lam[s.marker, range(m)] = 1.0
    cut = np.cumsum([len(s.loads), len(s.paths), len(s.psi)])
    for (i, j), v in zip(s.loads, theta):
        lam[i, j] = v
    for (t, a), v in zip(s.paths, theta[cut[0]:]):
        b[t, a] = v
    for (i, j), v in zip(s.psi, theta[cut[1]:]):
        psi[i, j] = psi[j, i] = v
    inv = np.linalg.inv(np.eye(m) - b)
    return lam, inv, inv @ psi @ inv.T, theta[cut[2]:]


def implied(s: Structure, theta: np.ndarray) -> np.ndarray:
    """The covariance matrix of the items that the parameters imply."""
    lam, _, c, err = _matrices(s, theta)
    return lam @ c @ lam.T + np.diag(err)


def discrepancy(s: Structure, theta: np.ndarray, r: np.ndarray):
    """log|Sigma| + tr(R Sigma^-1) - log|R| - k with its gradient and expected
    second derivatives; None where Sigma is not positive definite."""
    lam, inv, c, err = _matrices(s, theta)
    sigma = lam @ c @ lam.T + np.diag(err)
    try:
        chol = np.linalg.cholesky(sigma)
    except np.linalg.LinAlgError:
        return None
    si = np.linalg.inv(sigma)
    value = (2 * np.log(np.diag(chol)).sum() + np.sum(r * si)
             - np.linalg.slogdet(r)[1] - len(r))
    eye, la, lc = np.eye(len(r)), lam @ inv, lam @ c
    u = np.column_stack([eye[:, i] for i, _ in s.loads] + [la[:, t] for t, _ in s.paths]
                        + [la[:, i] for i, _ in s.psi] + [eye])
    v = np.column_stack([lc[:, j] for _, j in s.loads] + [lc[:, a] for _, a in s.paths]
                        + [la[:, j] for _, j in s.psi] + [eye])
    half = np.array([1.0] * (len(s.loads) + len(s.paths))
                    + [0.5 if i == j else 1.0 for i, j in s.psi] + [0.5] * len(r))
    w = si @ (sigma - r) @ si
    grad = 2 * half * np.einsum("ik,ik->k", u, w @ v)
    uu, vv, uv = u.T @ si @ u, v.T @ si @ v, u.T @ si @ v
    info = 2 * np.outer(half, half) * (uu * vv + uv * uv.T)
    return value, grad, info


def _start(s: Structure, r: np.ndarray) -> np.ndarray:
    """Loadings from the first principal component of each block."""
    lead = np.ones(len(s.items))
    for j, mark in enumerate(s.marker):
        block = [mark] + [i for i, k in s.loads if k == j]
        vec = np.linalg.eigh(r[np.ix_(block, block)])[1][:, -1]
        ratio = vec / (vec[0] if abs(vec[0]) > 0.1 else np.copysign(0.1, vec[0]))
        lead[block] = np.clip(ratio, -2, 2)
    return np.array([lead[i] for i, _ in s.loads] + [0.0] * len(s.paths)
                    + [0.5 if i == j else 0.0 for i, j in s.psi] + [0.5] * len(s.items))


def minimise(s: Structure, r: np.ndarray, start: np.ndarray | None = None,
             tol: float = 1e-7, max_iter: int = 500):
    """Damped scoring on an item correlation matrix with variances held at
    ``FLOOR`` or above: (parameters, value, information, converged)."""
    theta = _start(s, r) if start is None else start.copy()
    low = np.full(s.size, -np.inf)
    first = len(s.loads) + len(s.paths)
    low[first:first + len(s.latents)] = FLOOR
    low[first + len(s.psi):] = FLOOR
    theta = np.maximum(theta, low)
    now = discrepancy(s, theta, r)
    if now is None:
        theta = np.maximum(_start(s, r), low)
        now = discrepancy(s, theta, r)
    damp = 1e-3
    for _ in range(max_iter):
        value, grad, info = now
        free = ~((theta <= low) & (grad > 0))
        if np.max(np.abs(grad[free]), initial=0.0) < tol:
            return theta, value, info, True
        part = info[np.ix_(free, free)]
        while damp < 1e12:
            step = np.linalg.solve(part + damp * np.diag(np.diag(part) + 1e-8), -grad[free])
            cand = theta.copy()
            cand[free] += step
            cand = np.maximum(cand, low)
            new = discrepancy(s, cand, r)
            if new is not None and new[0] <= value:
                break
            damp *= 4
        else:
            return theta, value, info, False
        theta, now, damp = cand, new, max(damp / 4, 1e-12)
    return theta, now[0], now[2], False


def _scales(s: Structure, sd: np.ndarray) -> np.ndarray:
    """What turns parameters of standardised items into those of the items."""
    mk = sd[s.marker]
    return np.array([sd[i] / mk[j] for i, j in s.loads] + [mk[t] / mk[a] for t, a in s.paths]
                    + [mk[i] * mk[j] for i, j in s.psi] + list(sd ** 2))


@dataclass
class CovarianceModel:
    structure: Structure
    theta: np.ndarray                   # in units of the items
    se: np.ndarray                      # nan where the information is singular or a variance at its floor
    value: float
    n: float
    means: np.ndarray
    sds: np.ndarray
    corr: np.ndarray
    converged: bool

    def standardised(self) -> np.ndarray:
        return self.theta / _scales(self.structure, self.sds)


def _correlations(n: float, s: np.ndarray, c: np.ndarray, items: Sequence[str]):
    r, mean, sd = corr_from_moments(n, s, c)
    sd = sd * np.sqrt((n - 1) / n)
    flat = [items[i] for i in np.flatnonzero(~(np.diag(c) - n * mean ** 2 > 1e-12 * np.diag(c)))]
    if flat:
        raise ValueError(f"constant items: {', '.join(flat)}")
    if np.linalg.eigvalsh(r)[0] < 1e-10:
        raise ValueError("items are linear combinations of each other")
    return r, mean, sd


def covariance_fit(df: DataFrame, blocks: Mapping[str, Sequence[str]], paths: Sequence[tuple[str, str]],
                   covariances: Sequence[tuple[str, str]] | None = None) -> CovarianceModel:
    """V1: the fitted model from one aggregate over the rows."""
    s = structure(blocks, paths, covariances)
    if df.select(*s.items).dropna().limit(2).count() < 2:
        raise ValueError("fewer than two complete rows")
    n, sums, cross = item_moments(df, s.items)
    r, mean, sd = _correlations(n, sums, cross, s.items)
    theta, value, info, done = minimise(s, r)
    first = len(s.loads) + len(s.paths)
    variance = np.zeros(s.size, dtype=bool)
    variance[first:first + len(s.latents)] = True
    variance[first + len(s.psi):] = True
    free = ~(variance & (theta <= FLOOR))
    se = np.full(s.size, np.nan)
    part = info[np.ix_(free, free)] * n / 2
    if np.linalg.cond(part) < 1e14:
        se[free] = np.sqrt(np.clip(np.diag(np.linalg.inv(part)), 0, None))
    scale = _scales(s, sd)
    return CovarianceModel(s, theta * scale, se * scale, float(value), n, mean, sd, r, done)


ESTIMATES = ("lval string, op string, rval string, estimate double, std_est double, se double, "
             "z_stat double, p_value double")


def covariance_table(spark: SparkSession, m: CovarianceModel) -> DataFrame:
    """Estimates with standard errors, z and two-sided p; first loadings are
    fixed to 1 and have none. ``std_est`` has latents and items of variance 1."""
    s = m.structure
    _, _, c, _ = _matrices(s, m.theta)
    unit = dict(zip(s.latents, np.sqrt(np.diag(c)))) | dict(zip(s.items, np.sqrt(np.diag(implied(s, m.theta)))))

    def std(lval, op, rval, v):
        return float(v * unit[rval] / unit[lval] if op == "~" else v / (unit[lval] * unit[rval]))

    rows = [(s.items[i], "~", b, 1.0, std(s.items[i], "~", b, 1.0), None, None, None)
            for b, i in zip(s.latents, s.marker)]
    for (a, op, b), v, e in zip(s.names, m.theta, m.se):
        known = np.isfinite(e) and e > 0
        z = float(v / e) if known else None
        rows.append((a, op, b, float(v), std(a, op, b, v), float(e) if known else None, z,
                     erfc(abs(z) / sqrt(2)) if known else None))
    return spark.createDataFrame(rows, ESTIMATES)


def covariance_measures(m: CovarianceModel) -> dict[str, float]:
    """Chi-square against the free covariances, its degrees of freedom, CFI and
    TLI against unrelated items, RMSEA, SRMR, AIC and BIC up to a constant."""
    s, k = m.structure, len(m.structure.items)
    chisq, df = m.n * m.value, k * (k + 1) // 2 - s.size
    base, base_df = -m.n * float(np.linalg.slogdet(m.corr)[1]), k * (k - 1) // 2
    over, base_over = max(chisq - df, 0.0), max(base - base_df, chisq - df, 0.0)
    gap = m.corr - implied(s, m.theta) / np.outer(m.sds, m.sds)
    low = np.tril_indices(k)
    out = {"n": m.n, "parameters": float(s.size), "chisq": chisq, "df": float(df), "baseline_chisq": base,
           "baseline_df": float(base_df), "cfi": 1 - over / base_over if base_over > 0 else 1.0,
           "srmr": float(np.sqrt(np.mean(gap[low] ** 2))), "aic": chisq + 2 * s.size,
           "bic": chisq + np.log(m.n) * s.size, "converged": float(m.converged)}
    if df > 0:
        out["rmsea"] = float(np.sqrt(over / (df * m.n)))
        if base > base_df > 0:
            out["tli"] = (base / base_df - chisq / df) / (base / base_df - 1)
    return {name: float(v) for name, v in out.items()}


def covariance_scores(df: DataFrame, m: CovarianceModel, key: str) -> DataFrame:
    """V3: expected latent values given the items of a row (a projection);
    null where an item is null."""
    s = m.structure
    lam, _, c, _ = _matrices(s, m.theta)
    weight = c @ lam.T @ np.linalg.inv(implied(s, m.theta))
    cols = [sum((float(w) * (F.col(i) - float(mu)) for w, i, mu in zip(weight[j], s.items, m.means)),
                F.lit(0.0)).alias(b) for j, b in enumerate(s.latents)]
    return df.select(key, *cols)


def bootstrap_covariance(df: DataFrame, key: str, m: CovarianceModel, n_boot: int = 5000,
                         seed: int = 42) -> DataFrame:
    """V2: the model refitted on ``n_boot`` weighted resamples; long output
    (rep, parameter, estimate) for ``survey.bootstrap_summary``. Resamples that
    did not converge have null estimates."""
    s, start = m.structure, m.standardised()
    k = len(s.items)
    names = [" ".join(t) for t in s.names]
    at = [(i, j) for i in range(k) for j in range(i, k)]

    def fit_one(row: dict) -> list[float | None]:
        c = np.zeros((k, k))
        for i, j in at:
            c[i, j] = c[j, i] = row[f"c{i}_{j}"]
        try:
            r, _, sd = _correlations(row["w"], np.array([row[f"s{i}"] for i in range(k)]), c, s.items)
            theta, _, _, done = minimise(s, r, start)
        except (ValueError, np.linalg.LinAlgError):
            return [None] * s.size
        return list(theta * _scales(s, sd)) if done else [None] * s.size

    def fit(it):
        for pdf in it:
            fitted = [fit_one(row) for row in pdf.to_dict("records")]
            yield pd.DataFrame({"rep": np.repeat(pdf["rep"].to_numpy(), s.size),
                                "parameter": names * len(pdf),
                                "estimate": [v for f in fitted for v in f]})

    mom = bootstrap_moments(df, key, s.items, n_boot, seed)
    return mom.mapInPandas(fit, "rep long, parameter string, estimate double").persist()
