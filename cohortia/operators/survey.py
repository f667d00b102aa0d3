"""Latent-variable survey scores.

Everything the PLS path model needs is in the item correlation matrix, so
the data pass is one aggregate of item sums and cross products; the outer /
inner weight iteration runs on that k x k matrix. The bootstrap draws
Poisson(1) row weights from a hash of (row id, replicate) — the same on any
partitioning — sums weighted moments per partition for all replicates at
once, adds them up per replicate, and fits the small per-replicate PLS
models partition by partition (``mapInPandas``). Rows are never copied per
replicate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import grouped_quantiles

MODE_A, MODE_B = "A", "B"


@dataclass
class PlsModel:
    blocks: dict[str, list[str]]
    modes: dict[str, str]
    paths: list[tuple[str, str]]
    weights: dict[str, np.ndarray]       # per construct, on standardised items
    loadings: dict[str, np.ndarray]
    path_coefs: dict[tuple[str, str], float]
    r2: dict[str, float]
    means: dict[str, float]
    sds: dict[str, float]
    iterations: int
    corr: np.ndarray | None = None
    items: list[str] | None = None


def item_moments(df: DataFrame, items: Sequence[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """One aggregate pass: n, Σx, Σxx' over complete rows."""
    items = list(items)
    d = df.select(*items).dropna()
    k = len(items)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(f"s{i}") for i, c in enumerate(items)]
    aggs += [F.sum(F.col(items[i]) * F.col(items[j])).alias(f"c{i}_{j}")
             for i in range(k) for j in range(i, k)]
    r = d.agg(*aggs).first()
    s = np.array([r[f"s{i}"] for i in range(k)], dtype=float)
    c = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            c[i, j] = c[j, i] = r[f"c{i}_{j}"]
    return float(r["n"]), s, c


def corr_from_moments(n: float, s: np.ndarray, c: np.ndarray):
    mean = s / n
    cov = (c - n * np.outer(mean, mean)) / (n - 1)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-300, None))
    return cov / np.outer(sd, sd), mean, sd


def pls_from_corr(r: np.ndarray, items: Sequence[str], blocks: Mapping[str, Sequence[str]],
                  modes: Mapping[str, str], paths: Sequence[tuple[str, str]],
                  tol: float = 1e-7, max_iter: int = 300):
    """Wold's PLS algorithm on a correlation matrix (path weighting scheme).

    Mode A: weights are the item correlations with the inner proxy; Mode B:
    the regression of the proxy on the block's items. Weights are scaled so
    every construct score has unit variance.
    """
    pos = {c: i for i, c in enumerate(items)}
    names = list(blocks)
    idx = {b: [pos[c] for c in blocks[b]] for b in names}
    w = {b: np.ones(len(idx[b])) for b in names}

    def norm(b, v):
        rr = r[np.ix_(idx[b], idx[b])]
        return v / np.sqrt(v @ rr @ v)

    def ccor(a, b):
        return float(w[a] @ r[np.ix_(idx[a], idx[b])] @ w[b])

    w = {b: norm(b, w[b]) for b in names}
    preds = {b: [a for a, t in paths if t == b] for b in names}
    succs = {b: [t for a, t in paths if a == b] for b in names}
    it = 0
    for it in range(1, max_iter + 1):
        # inner weights (path scheme): regression on predecessors, correlation with successors
        inner = {}
        for b in names:
            e = {}
            if preds[b]:
                p = preds[b]
                rpp = np.array([[ccor(x, y) for y in p] for x in p])
                rpb = np.array([ccor(x, b) for x in p])
                coef = np.linalg.solve(rpp, rpb)
                for x, v in zip(p, coef):
                    e[x] = e.get(x, 0.0) + v
            for t in succs[b]:
                e[t] = e.get(t, 0.0) + ccor(b, t)
            inner[b] = e
        new = {}
        for b in names:
            # correlation of the block's items with the inner proxy Σ e_k Y_k
            rz = sum(v * (r[np.ix_(idx[b], idx[k])] @ w[k]) for k, v in inner[b].items())
            if isinstance(rz, float) or not np.any(rz):
                rz = r[np.ix_(idx[b], idx[b])] @ w[b]
            if modes.get(b, MODE_A) == MODE_B:
                raw = np.linalg.solve(r[np.ix_(idx[b], idx[b])], rz)
            else:
                raw = rz
            new[b] = norm(b, raw)
        delta = max(float(np.max(np.abs(new[b] - w[b]))) for b in names)
        w = new
        if delta < tol:
            break
    loadings = {b: r[np.ix_(idx[b], idx[b])] @ w[b] for b in names}
    coefs, r2 = {}, {}
    for b in names:
        p = preds[b]
        if not p:
            continue
        rpp = np.array([[ccor(x, y) for y in p] for x in p])
        rpb = np.array([ccor(x, b) for x in p])
        beta = np.linalg.solve(rpp, rpb)
        for x, v in zip(p, beta):
            coefs[(x, b)] = float(v)
        r2[b] = float(beta @ rpb)
    return w, loadings, coefs, r2, it


def pls_fit(df: DataFrame, blocks: Mapping[str, Sequence[str]], modes: Mapping[str, str],
            paths: Sequence[tuple[str, str]]) -> PlsModel:
    """V1: PLS path model from one distributed moment pass."""
    items = [c for b in blocks.values() for c in b]
    n, s, c = item_moments(df, items)
    r, mean, sd = corr_from_moments(n, s, c)
    w, load, coefs, r2, it = pls_from_corr(r, items, blocks, modes, paths)
    return PlsModel({b: list(v) for b, v in blocks.items()}, dict(modes), list(paths), w, load, coefs,
                    r2, dict(zip(items, mean)), dict(zip(items, sd)), it, r, list(items))


def pls_consistent(m: PlsModel) -> dict:
    """Consistent PLS correction for reflective (Mode A) constructs.

    Reliability rho_A = (w'w)² · w'(S − diag S)w / w'(ww' − diag ww')w per
    reflective block (composites keep 1); construct correlations are divided
    by sqrt(rho_A,i · rho_A,j); paths are re-estimated on the corrected
    correlations; consistent loadings are w · sqrt(rho_A) / (w'w). A block
    without a positive reliability has no correction: its paths, their targets'
    R² and its loadings are None, and ``reason`` says which block it is.
    Works on the stored item correlation matrix only (no data pass).
    """
    r = m.corr
    pos = {c: i for i, c in enumerate(m.items)}
    names = list(m.blocks)
    idx = {b: [pos[c] for c in m.blocks[b]] for b in names}
    rho = {}
    for b in names:
        w = m.weights[b]
        if m.modes.get(b, MODE_A) != MODE_A or len(w) < 2:
            rho[b] = 1.0
            continue
        s = r[np.ix_(idx[b], idx[b])]
        ww = np.outer(w, w)
        num = w @ (s - np.diag(np.diag(s))) @ w
        den = w @ (ww - np.diag(np.diag(ww))) @ w
        rho[b] = float((w @ w) ** 2 * num / den)
    failed = {b for b in names if not rho[b] > 0}
    cc = {}
    for a in names:
        for b in names:
            raw = float(m.weights[a] @ r[np.ix_(idx[a], idx[b])] @ m.weights[b])
            cc[(a, b)] = raw if a == b or {a, b} & failed else raw / np.sqrt(rho[a] * rho[b])
    coefs, r2, reason = {}, {}, {b: f"rho_A of {b} is not positive" for b in failed}
    for b in names:
        p = [a for a, t in m.paths if t == b]
        if not p:
            continue
        bad = sorted(failed & {b, *p})
        if bad:
            reason[b] = f"rho_A of {', '.join(bad)} is not positive"
            coefs |= {(x, b): None for x in p}
            r2[b] = None
            continue
        rpp = np.array([[cc[(x, y)] if x != y else 1.0 for y in p] for x in p])
        rpb = np.array([cc[(x, b)] for x in p])
        beta = np.linalg.solve(rpp, rpb)
        for x, v in zip(p, beta):
            coefs[(x, b)] = float(v)
        r2[b] = float(beta @ rpb)
    loadings = {b: (m.loadings[b] if m.modes.get(b, MODE_A) != MODE_A else None if b in failed
                    else m.weights[b] * np.sqrt(rho[b]) / (m.weights[b] @ m.weights[b])) for b in names}
    return {"rho_a": rho, "path_coefs": coefs, "r2": r2, "loadings": loadings,
            "reason": reason}


def pls_tables(spark: SparkSession, m: PlsModel) -> tuple[DataFrame, DataFrame]:
    """(outer weights and loadings per item, path coefficients with R²)."""
    rows = [(b, it, float(m.weights[b][i]), float(m.loadings[b][i]), m.modes.get(b, MODE_A))
            for b in m.blocks for i, it in enumerate(m.blocks[b])]
    outer = spark.createDataFrame(rows, "construct string, item string, weight double, "
                                  "loading double, mode string")
    prow = [(a, b, v, m.r2.get(b)) for (a, b), v in m.path_coefs.items()]
    inner = spark.createDataFrame(prow, "source string, target string, path_coef double, r2 double")
    return outer, inner


def construct_scores(df: DataFrame, m: PlsModel, key: str) -> DataFrame:
    """V3: latent score per row = Σ weight · standardised item (projection,
    no shuffle)."""
    cols = []
    for b, items in m.blocks.items():
        acc = F.lit(0.0)
        for i, it in enumerate(items):
            acc = acc + float(m.weights[b][i]) * (F.col(it) - m.means[it]) / m.sds[it]
        cols.append(acc.alias(b))
    return df.select(key, *cols)


def cronbach_alpha(df: DataFrame, blocks: Mapping[str, Sequence[str]]) -> DataFrame:
    """V5: k/(k−1) · (1 − Σ var(item) / var(Σ items)) per block, one pass."""
    aggs = []
    for b, items in blocks.items():
        aggs += [F.var_samp(i).alias(f"{b}__{i}") for i in items]
        aggs.append(F.var_samp(sum((F.col(i) for i in items), F.lit(0.0))).alias(f"{b}__total"))
    row = df.agg(*aggs)
    out = []
    for b, items in blocks.items():
        k = len(items)
        sv = sum((F.col(f"{b}__{i}") for i in items), F.lit(0.0))
        out.append(F.struct(F.lit(b).alias("construct"), F.lit(k).alias("items"),
                            (F.lit(k / (k - 1)) * (1 - sv / F.col(f"{b}__total"))).alias("alpha")))
    return row.select(F.explode(F.array(*out)).alias("s")).select("s.*")


def construct_r2(scores: DataFrame, paths: Sequence[tuple[str, str]]) -> DataFrame:
    """V6: share of variance explained per path (squared score correlation;
    each target has one predictor here)."""
    row = scores.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in paths])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"),
                 (F.col(f"{a}__{b}") ** 2).alias("r2")) for a, b in paths])).alias("s")).select("s.*")


# ---------------------------------------------------------------- bootstrap
def _poisson1(u: np.ndarray) -> np.ndarray:
    """Poisson(1) draws from uniforms by the inverse CDF."""
    cdf = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(0, 16)])
    return np.searchsorted(cdf, u, side="right").astype(float)


def _uniform(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Repeatable uniforms from (row id, replicate, seed) (splitmix-style)."""
    x = (ids[:, None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
         ^ (reps[None, :].astype(np.uint64) + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def bootstrap_moments(df: DataFrame, key: str, items: Sequence[str], n_boot: int,
                      seed: int = 42, batch: int = 512, tasks: int | None = None) -> DataFrame:
    """Weighted moment sums per replicate: (rep, w, s_i..., c_i_j...).

    The input's partitions are read by ``tasks`` tasks (the cores of the
    cluster, if not given), without a shuffle. Each adds up its rows'
    contributions for every replicate in row batches, so the shuffle holds
    n_boot rows a task, however large the data and many its partitions are.
    Replicates are summed in as many partitions: a number given by hand keeps
    the small table from being merged into a few tasks, so that all cores fit
    replicates.
    """
    items = list(items)
    k = len(items)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = ["w"] + [f"s{i}" for i in range(k)] + [f"c{i}_{j}" for i, j in pairs]
    schema = "rep long, " + ", ".join(f"{n} double" for n in names)
    reps = np.arange(n_boot)

    def part(it):
        acc = np.zeros((n_boot, len(names)))
        seen = False
        for pdf in it:
            if pdf.empty:
                continue
            seen = True
            for start in range(0, len(pdf), batch):
                b = pdf.iloc[start:start + batch]
                ids = b[key].to_numpy(np.int64)
                x = b[items].to_numpy(float)
                w = _poisson1(_uniform(ids, reps, seed))          # rows x reps
                feats = np.column_stack([np.ones(len(b)), x] +
                                        [x[:, i] * x[:, j] for i, j in pairs])
                acc += w.T @ feats
        if seen:
            out = pd.DataFrame(acc, columns=names)
            out.insert(0, "rep", reps)
            yield out

    d = df.select(key, *items).dropna()
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    sums = d.coalesce(tasks).mapInPandas(part, schema)
    return sums.repartition(tasks, "rep").groupBy("rep").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_pls(df: DataFrame, key: str, blocks: Mapping[str, Sequence[str]],
                  modes: Mapping[str, str], paths: Sequence[tuple[str, str]],
                  n_boot: int = 5000, seed: int = 42) -> DataFrame:
    """V2: one PLS fit per replicate; long output (rep, parameter, estimate)."""
    items = [c for b in blocks.values() for c in b]
    k = len(items)
    mom = bootstrap_moments(df, key, items, n_boot, seed)
    blocks_ = {b: list(v) for b, v in blocks.items()}
    modes_ = dict(modes)
    paths_ = list(paths)
    targets = list(dict.fromkeys(t for _, t in paths_))
    parameters = ([f"{a} -> {b}" for a, b in paths_]
                  + [f"{b} <- {it}" for b in blocks_ for it in blocks_[b]] + [f"R2 {b}" for b in targets])

    def fit_one(r) -> list[tuple[str, float | None]]:
        n = float(r["w"])
        s = np.array([r[f"s{i}"] for i in range(k)])
        c = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                c[i, j] = c[j, i] = r[f"c{i}_{j}"]
        try:
            rr, _, _ = corr_from_moments(n, s, c)
            w, load, coefs, r2, _ = pls_from_corr(rr, items, blocks_, modes_, paths_)
        except np.linalg.LinAlgError:
            # a replicate without a solution shows as missing estimates
            return [(name, None) for name in parameters]
        rows = [(f"{a} -> {b}", v) for (a, b), v in coefs.items()]
        rows += [(f"{b} <- {it}", float(w[b][i])) for b in blocks_ for i, it in enumerate(blocks_[b])]
        rows += [(f"R2 {b}", v) for b, v in r2.items()]
        return rows

    def fit(it):
        # replicates are independent rows: a partition fits all of its own
        for pdf in it:
            reps, params, ests = [], [], []
            for r in pdf.to_dict("records"):
                for p, v in fit_one(r):
                    reps.append(int(r["rep"]))
                    params.append(p)
                    ests.append(v if v is None else float(v))
            yield pd.DataFrame({"rep": reps, "parameter": params, "estimate": ests})

    # small (replicates x parameters) and read by several summary passes
    return mom.mapInPandas(fit, "rep long, parameter string, estimate double").persist()


def bootstrap_summary(boot: DataFrame, param: str = "parameter", value: str = "estimate") -> DataFrame:
    """Per parameter mean, SD and the 2.5 / 97.5 percentiles (exact) over
    the replicates with an estimate, and the number without one (``failed``)."""
    mom = boot.groupBy(param).agg(F.avg(value).alias("boot_mean"),
                                  F.stddev_samp(value).alias("boot_se"),
                                  F.count(value).alias("replicates"),
                                  F.count_if(F.col(value).isNull()).alias("failed"))
    q = grouped_quantiles(boot, [param], value, [0.025, 0.975])
    return (mom.join(q, param, "left")
            .select(param, "boot_mean", "boot_se", F.col("q")[0].alias("ci_lower"),
                    F.col("q")[1].alias("ci_upper"), "replicates", "failed"))
