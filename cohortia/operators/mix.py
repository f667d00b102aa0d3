"""Marketing-mix modelling.

Long weekly tables ``(series..., channel, week, value)`` are the currency.
A (series, channel) history is bounded by the calendar (52 rows a year), so
recursive carry-over runs as one sorted array per history with ``aggregate``
— parallel over histories, no Python. Candidate models are rows; each batch of
rows is fitted in ``mapInPandas`` on the weekly table (one row per week).
Budget allocation is an exact search on a common spend grid, channel by
channel, as joins and grouped maxima.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import grouped_quantiles
from .evaluate import unit_hash


def safe_name(c: str) -> str:
    return c.replace("-", "_").replace(" ", "_")


# ---------------------------------------------------------------- transforms
def half_life_theta(h: float, inverse: bool = False) -> float:
    """θ = 0.5^h as printed; ``inverse=True`` gives the usual 0.5^(1/h)."""
    return 0.5 ** (1.0 / h) if inverse else 0.5 ** h


def fill_grid(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Every (keys, order) pair present, missing values 0."""
    grid = df.select(*keys).distinct().crossJoin(df.select(order).distinct())
    return (grid.join(df.select(*keys, order, value), [*keys, order], "left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(0.0))))


def adstock_geometric(df: DataFrame, keys: Sequence[str], order: str, value: str,
                      theta: float | Column | str, out: str = "adstock") -> DataFrame:
    """x'_t = x_t + θ x'_(t−1) within each history, in ``order``.

    ``theta`` may be a number, a column, or the name of a column (one value
    per history, e.g. joined from a parameter table).
    """
    keys = list(keys)
    th = F.col(theta) if isinstance(theta, str) else (theta if isinstance(theta, Column)
                                                      else F.lit(float(theta)))
    g = (df.withColumn("__th", th.cast("double"))
         .groupBy(*keys)
         .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                   F.col(value).cast("double").alias("v"))))
              .alias("__s"), F.first("__th").alias("__th")))
    scan = F.aggregate(
        "__s", F.array().cast("array<double>"),
        lambda acc, e: F.concat(acc, F.array(
            e["v"] + F.col("__th") * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))
    g = g.withColumn("__a", scan)
    return (g.select(*keys, F.posexplode("__s").alias("__i", "__e"), "__a")
            .select(*keys, F.col("__e.o").alias(order), F.col("__e.v").alias(value),
                    F.element_at("__a", F.col("__i") + 1).alias(out)))


def saturation_hill(df: DataFrame, keys: Sequence[str], x: str, alpha, gamma,
                    out: str = "saturated") -> DataFrame:
    """x^α / (x^α + i^α) with inflexion i = (1−γ)·min + γ·max of the
    history (per ``keys``). ``alpha`` / ``gamma`` are numbers or column names."""
    def col(v):
        return F.col(v) if isinstance(v, str) else F.lit(float(v))
    w = Window.partitionBy(*keys)
    a, g = col(alpha), col(gamma)
    infl = (1 - g) * F.min(x).over(w) + g * F.max(x).over(w)
    xa = F.pow(F.col(x), a)
    return df.withColumn(out, F.coalesce(F.try_divide(xa, xa + F.pow(infl, a)), F.lit(0.0)))


def median_weekly(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per (keys), e.g. competitor GRP per week; the
    distributed exact quantile keeps a hot group from landing in one task."""
    q = grouped_quantiles(df, list(keys), value, [0.5])
    return q.select(*keys, F.col("q")[0].alias(out))


# ---------------------------------------------------------------- regressors
# The holidays the calendar rule generates (month, day, name).
HOLIDAY_RULES = [(1, 1, "NEWYEAR"), (8, 15, "MIDAUGUST"), (12, 25, "CHRISTMAS"),
                 (12, 31, "NEWYEARSEVE")]


def holiday_calendar(weekly: DataFrame, week: str = "week") -> DataFrame:
    """A (ds, holiday, country) calendar for every year in the data."""
    years = weekly.select(F.year(week).alias("y")).distinct()
    rules = weekly.sparkSession.createDataFrame(HOLIDAY_RULES, "m int, d int, holiday string")
    return (years.crossJoin(F.broadcast(rules))
            .select(F.make_date("y", "m", "d").alias("ds"), "holiday", F.lit("IT").alias("country")))


def holiday_join(weekly: DataFrame, holidays: DataFrame, week: str = "week") -> DataFrame:
    """Holidays falling in each week, as 0/1 columns (range join done as
    an equi-join on the week start; the calendar is broadcast)."""
    # every name of the calendar becomes a column
    names = sorted(r[0] for r in holidays.select("holiday").dropna().distinct().collect())
    h = (holidays.select(F.date_trunc("week", "ds").cast("date").alias(week), "holiday")
         .groupBy(week).pivot("holiday", names or [""]).agg(F.lit(1)))
    out = weekly.join(F.broadcast(h), week, "left")
    return out.fillna(0, subset=names) if names else out.drop("")


def trend_season(weekly: DataFrame, week: str = "week", order: int = 2,
                 period: float = 365.25 / 7) -> DataFrame:
    """Trend (weeks since the first week) and yearly sin / cos pairs."""
    first = weekly.agg(F.min(week).alias("__w0"))
    t = F.datediff(week, "__w0") / 7.0
    out = weekly.crossJoin(F.broadcast(first)).withColumn("trend", t + 1)
    for k in range(1, order + 1):
        out = (out.withColumn(f"season_sin{k}", F.sin(2 * math.pi * k * t / period))
               .withColumn(f"season_cos{k}", F.cos(2 * math.pi * k * t / period)))
    return out.drop("__w0")


def time_split(df: DataFrame, order: str, train_share: float, keys: Sequence[str] = ()) -> DataFrame:
    """First share of periods → train; the rest split equally into
    validation then test. Periods of a history are bounded by the calendar."""
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys)) if keys else F.count(F.lit(1)).over(Window.partitionBy())
    r = F.row_number().over(w)
    ntrain = F.floor(n * train_share)
    nval = F.floor((n - ntrain) / 2)
    return df.withColumn("split", F.when(r <= ntrain, "train")
                         .when(r <= ntrain + nval, "validation").otherwise("test"))


# ---------------------------------------------------------------- fit quality
def nrmse(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """RMSE divided by the range of the target."""
    e = F.col(y) - F.col(yhat)
    return df.agg((F.sqrt(F.avg(e * e)) / (F.max(y) - F.min(y))).alias("nrmse"))


def decomp_rssd(effects: DataFrame, channel: str = "channel", effect: str = "effect",
                spend: str = "spend") -> DataFrame:
    """Sqrt Σ (effect share − spend share)² over paid channels."""
    tot = effects.agg(F.sum(effect).alias("__e"), F.sum(spend).alias("__s"))
    d = effects.crossJoin(F.broadcast(tot)).select(
        ((F.col(effect) / F.col("__e")) - (F.col(spend) / F.col("__s"))).alias("__d"))
    return d.agg(F.sqrt(F.sum(F.col("__d") ** 2)).alias("decomp_rssd"))


def decompose(long: DataFrame, coefs: DataFrame, channel: str = "channel", x: str = "x"
              ) -> DataFrame:
    """X11: effect of each channel = Σ_t coef · x_t, and its share of the
    total of all effects (base plus incremental)."""
    e = (long.join(F.broadcast(coefs), channel)
         .groupBy(channel).agg(F.sum(F.col("coef") * F.col(x)).alias("effect")))
    tot = e.agg(F.sum("effect").alias("__t"))
    return e.crossJoin(F.broadcast(tot)).withColumn("share", F.col("effect") / F.col("__t")).drop("__t")


def base_incremental(effects: DataFrame, weekly: DataFrame, target: str = "sales",
                     effect: str = "effect") -> DataFrame:
    """X11: one row: what the channels explain together (incremental), the
    rest of the target (base), and the share of both."""
    inc = effects.agg(F.sum(effect).alias("incremental"))
    tot = weekly.agg(F.sum(F.col(target).cast("double")).alias("__t"))
    return inc.crossJoin(F.broadcast(tot)).select(
        (F.col("__t") - F.col("incremental")).alias("base"), "incremental",
        F.try_divide(F.col("__t") - F.col("incremental"), F.col("__t")).alias("base_share"),
        F.try_divide(F.col("incremental"), F.col("__t")).alias("incremental_share"))


def pair_effects(long: DataFrame, pairs: DataFrame, channel: str = "channel", week: str = "week",
                 x: str = "x") -> DataFrame:
    """Σ_t coef · x_a(t) · x_b(t) per channel pair. ``pairs``: ``a, b, coef``."""
    left = long.select(F.col(channel).alias("a"), F.col(week).alias("__w"), F.col(x).alias("__xa"))
    right = long.select(F.col(channel).alias("b"), F.col(week).alias("__w"), F.col(x).alias("__xb"))
    return (left.join(F.broadcast(pairs), "a").join(right, ["b", "__w"])
            .groupBy("a", "b").agg(F.sum(F.col("coef") * F.col("__xa") * F.col("__xb")).alias("effect")))


def roi(effects: DataFrame, spend: DataFrame, channel: str = "channel") -> DataFrame:
    """Effect / spend per channel."""
    return (effects.join(spend, channel)
            .withColumn("roi", F.try_divide(F.col("effect"), F.col("spend"))))


def conditional_roi(effects: DataFrame, pair_effects: DataFrame, spend: DataFrame,
                    channel: str = "channel") -> DataFrame:
    """ROI of a channel with half of each pair term it takes part in
    (the text gives no split; halves are our choice)."""
    halves = (pair_effects.select(F.col("a").alias(channel), (F.col("effect") / 2).alias("__h"))
              .unionByName(pair_effects.select(F.col("b").alias(channel), (F.col("effect") / 2).alias("__h")))
              .groupBy(channel).agg(F.sum("__h").alias("pair_effect")))
    return (effects.join(halves, channel, "left").join(spend, channel)
            .withColumn("pair_effect", F.coalesce("pair_effect", F.lit(0.0)))
            .withColumn("conditional_roi",
                        F.try_divide(F.col("effect") + F.col("pair_effect"), F.col("spend"))))


# ---------------------------------------------------------------- model search
def candidate_params(spark: SparkSession, ranges: Mapping[str, tuple[float, float]], n: int,
                     seed: int = 0, trials: int = 1) -> DataFrame:
    """``n`` x ``trials`` parameter sets drawn uniformly inside the
    ranges from a mixing hash of the candidate id, salted by parameter and
    seed, so parameters vary independently."""
    ids = spark.range(n * trials).withColumnRenamed("id", "candidate")
    cols = [F.col("candidate"), (F.col("candidate") % trials).cast("int").alias("trial"),
            (F.col("candidate") / trials).cast("long").alias("iteration")]
    for j, (name, (lo, hi)) in enumerate(ranges.items()):
        u = unit_hash("candidate", seed * 1000 + j)
        cols.append((F.lit(lo) + (hi - lo) * u).alias(name))
    return ids.select(*cols)


def _adstock_np(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Carry-over of one history for several θ: one row per θ."""
    out = np.empty((len(theta), len(x)))
    acc = np.zeros(len(theta))
    for i, v in enumerate(x):
        acc = v + theta * acc
        out[:, i] = acc
    return out


def _hill_np(x: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Saturation of each row of ``x`` with its own α and γ."""
    infl = (1 - gamma) * x.min(axis=1) + gamma * x.max(axis=1)
    xa = np.power(x, alpha[:, None])
    den = xa + (infl ** alpha)[:, None]
    return np.where(den > 0, xa / np.where(den > 0, den, 1), 0.0)


def ridge_signed(x: np.ndarray, y: np.ndarray, lam: float, nonneg: Sequence[bool],
                 iters: int = 500) -> tuple[float, np.ndarray]:
    """Ridge on standardised columns, unpenalised intercept, chosen
    coefficients kept ≥ 0 (projected coordinate descent on the Gram matrix)."""
    mu, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    z = (x - mu) / sd
    n, p = z.shape
    gram, c = z.T @ z, z.T @ (y - y.mean())
    b = np.zeros(p)
    for _ in range(iters):
        delta = 0.0
        for j in range(p):
            new = (c[j] - gram[j] @ b + gram[j, j] * b[j]) / (gram[j, j] + lam * n)
            if nonneg[j]:
                new = max(new, 0.0)
            delta = max(delta, abs(new - b[j]))
            b[j] = new
        if delta < 1e-10:
            break
    beta = b / sd
    return float(y.mean() - mu @ beta), beta


def _error(y: np.ndarray, yhat: np.ndarray) -> float:
    """NRMSE (X9); NaN for an empty or constant target."""
    return float(np.sqrt(np.mean((y - yhat) ** 2)) / np.ptp(y)) if len(y) and np.ptp(y) > 0 else math.nan


def fit_candidates(candidates: DataFrame, weekly_long: DataFrame, channels: Sequence[str],
                   target: DataFrame, lam: float = 0.1, train_share_col: str | None = None,
                   controls: Sequence[str] = ()) -> DataFrame:
    """The candidates fitted by ``candidate_fitter``."""
    return candidate_fitter(weekly_long, channels, target, lam, train_share_col, controls)(candidates)


def candidate_fitter(weekly_long: DataFrame, channels: Sequence[str], target: DataFrame, lam: float = 0.1,
                     train_share_col: str | None = None, controls: Sequence[str] = ()
                     ) -> Callable[[DataFrame], DataFrame]:
    """A function that fits any table of candidates. Per candidate: adstock and saturation per channel, signed ridge on
    the training weeks, then NRMSE over all weeks and per split (X8, X9),
    decomp.RSSD (X10), R² and per-channel ROI.

    ``target`` holds ``week, sales`` and the ``controls`` (trend, season,
    holidays; free sign). The weekly table (one row per week, bounded by the
    calendar) goes to the tasks once; candidates stay where they are and are
    fitted batch by batch, without a shuffle.
    """
    ch, ctl = list(channels), list(controls)
    wide = (weekly_long.groupBy("week").pivot("channel", ch).agg(F.first("spend"))
            .fillna(0.0).join(target, "week").orderBy("week")
            .select(*[F.col(f"`{c}`").cast("double") for c in [*ch, "sales", *ctl]]).toPandas())
    y = wide["sales"].to_numpy()
    spends = [wide[c].to_numpy() for c in ch]
    fixed = wide[ctl].to_numpy()
    total = np.array([s.sum() for s in spends])
    spend_share = total / total.sum() if total.sum() > 0 else np.zeros(len(ch))
    signs = [True] * len(ch) + [False] * len(ctl)
    names = ["nrmse", "nrmse_train", "nrmse_val", "nrmse_test", "decomp_rssd", "r2",
             *[f"roi_{safe_name(c)}" for c in ch]]
    out_schema = "candidate long, trial int, iteration long, " + ", ".join(f"{n} double" for n in names)

    def fit_one(media: np.ndarray, share: float) -> list[float]:
        n = len(y)
        train = math.floor(n * share)
        val = train + (n - train) // 2
        x = np.column_stack([media, fixed])
        b0, b = ridge_signed(x[:train], y[:train], lam, signs)
        yhat = b0 + x @ b
        effect = (media * b[:len(ch)]).sum(0)
        share_of = effect / effect.sum() if effect.sum() > 0 else np.zeros(len(ch))
        sst = ((y - y.mean()) ** 2).sum()
        return [_error(y, yhat), _error(y[:train], yhat[:train]), _error(y[train:val], yhat[train:val]),
                _error(y[val:], yhat[val:]), float(np.sqrt(((share_of - spend_share) ** 2).sum())),
                float(1 - ((y - yhat) ** 2).sum() / sst) if sst > 0 else math.nan,
                *[float(e / s) if s > 0 else math.nan for e, s in zip(effect, total)]]

    def fit(batches):
        for g in batches:
            media = np.stack([_hill_np(_adstock_np(s, g[f"{c}_theta"].to_numpy()),
                                       g[f"{c}_alpha"].to_numpy(), g[f"{c}_gamma"].to_numpy())
                              for c, s in zip(ch, spends)], axis=2)
            shares = g[train_share_col] if train_share_col else [1.0] * len(g)
            res = pd.DataFrame([fit_one(m, s) for m, s in zip(media, shares)], columns=names)
            yield pd.concat([g[["candidate", "trial", "iteration"]].reset_index(drop=True), res], axis=1)

    return lambda candidates: candidates.mapInPandas(fit, out_schema)


def pareto_fronts(models: DataFrame, fronts: int = 2, x: str = "nrmse", y: str = "decomp_rssd",
                  key: str = "candidate", buckets: int = 64) -> DataFrame:
    """Non-dominated models on (x, y), both minimised; front 2 is the
    front of what remains. A model is kept when its y is below the minimum y
    of every model before it in (x, y, key) order. The running minimum is
    bucketed on x (a sketch of x), so no single task sees every model."""
    remaining = models.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = None
    for f in range(1, fronts + 1):
        cuts = remaining.agg(F.percentile_approx(x, F.array(*[F.lit(i / buckets)
                                                              for i in range(1, buckets)]),
                                                 10 * buckets).alias("__c"))
        b = (remaining.crossJoin(F.broadcast(cuts))
             .withColumn("__b", F.size(F.filter("__c", lambda c: c < F.col(x)))).drop("__c"))
        bmin = b.groupBy("__b").agg(F.min(y).alias("__bm"))
        before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        bpre = bmin.select("__b", F.min("__bm").over(before).alias("__pm"))
        w = (Window.partitionBy("__b").orderBy(x, y, key)
             .rowsBetween(Window.unboundedPreceding, -1))
        scored = (b.join(F.broadcast(bpre), "__b")
                  .withColumn("__wm", F.min(y).over(w))
                  .withColumn("__m", F.least("__pm", "__wm")))
        front = scored.where(F.col("__m").isNull() | (F.col(y) < F.col("__m"))).select(
            *models.columns).withColumn("front", F.lit(f))
        out = front if out is None else out.unionByName(front)
        remaining = remaining.join(front.select(key), key, "left_anti")
    return out


def select_model(models: DataFrame, model_id, key: str = "candidate") -> DataFrame:
    """X16."""
    return models.where(F.col(key) == F.lit(model_id))


def convergence(models: DataFrame, blocks: int = 10, error: str = "nrmse",
                trial: str = "trial", order: str = "iteration") -> DataFrame:
    """Best and spread of the error per block of iterations per trial.
    A trial's iterations are the search length (thousands), not data size."""
    w = Window.partitionBy(trial).orderBy(order)
    return (models.withColumn("block", F.ntile(blocks).over(w))
            .groupBy(trial, "block")
            .agg(F.min(error).alias("best_error"), F.stddev_samp(error).alias("sd_error"),
                 F.count(F.lit(1)).alias("models")))


def cluster_models(models: DataFrame, roi_cols: Sequence[str], k: int = 3, seed: int = 1,
                   error: str = "nrmse", key: str = "candidate") -> DataFrame:
    """K-means on the ROI vectors of (Pareto) models; best model per
    cluster. Fewer distinct vectors than ``k`` give fewer clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    v = VectorAssembler(inputCols=list(roi_cols), outputCol="__f", handleInvalid="skip").transform(models)
    cl = KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="cluster").fit(v).transform(v)
    w = Window.partitionBy("cluster").orderBy(error, key)
    return cl.withColumn("__r", F.row_number().over(w)).withColumn("best_in_cluster", F.col("__r") == 1) \
        .drop("__f", "__r")


# ---------------------------------------------------------------- response and budget
def response(s: Column, beta: Column, alpha: Column, inflexion: Column) -> Column:
    """Saturating response β · s^α / (s^α + i^α) of spend s per period."""
    sa = F.pow(s, alpha)
    return beta * F.coalesce(F.try_divide(sa, sa + F.pow(inflexion, alpha)), F.lit(0.0))


def marginal_roas(curves: DataFrame, at: str = "current") -> DataFrame:
    """Slope of the response at the given spend,
    β α i^α s^(α−1) / (s^α + i^α)²."""
    s, a, i, b = F.col(at), F.col("alpha"), F.col("inflexion"), F.col("beta")
    num = b * a * F.pow(i, a) * F.pow(s, a - 1)
    den = F.pow(F.pow(s, a) + F.pow(i, a), 2)
    return curves.withColumn("marginal_roas", F.try_divide(num, den))


def allocate_budget(curves: DataFrame, low: float = 0.7, up: float = 1.5, units: int = 100,
                    budget: float | None = None, channel: str = "channel",
                    by: Sequence[str] = ()) -> DataFrame:
    """Spend per channel maximising total response, each channel within
    [low, up] x its current spend, total at most the budget (default: the
    current total), for every brand (``by``) on its own.

    Exact on a common grid: a brand's budget is cut into ``units`` equal
    steps, and a channel spends its lower limit plus whole steps. The search
    goes channel by channel and keeps the best total per number of steps spent,
    so a brand never has more than ``units`` + 1 states, whatever its channels.
    Equal totals are decided by fewer steps, then by the larger step counts of
    the first channels. A budget below the lower limits gives no rows.
    """
    keys = list(by) or ["__all"]
    base = curves if by else curves.withColumn("__all", F.lit(0))
    brand = base.groupBy(*keys).agg(
        (F.sum("current") if budget is None else F.lit(float(budget))).alias("__budget"),
        F.sum(F.col("current") * low).alias("__least"))
    brand = brand.select(*keys, (F.col("__budget") / units).alias("__unit"), F.floor(
        (F.col("__budget") - F.col("__least")) / (F.col("__budget") / units) + 1e-9).cast("int").alias("__steps"))
    order = Window.partitionBy(*keys).orderBy(channel)
    chans = base.join(brand, keys).withColumn("__i", F.row_number().over(order))
    most = F.least(F.floor(F.col("current") * (up - low) / F.col("__unit") + 1e-9).cast("int"), F.col("__steps"))
    levels = (chans.filter("__steps >= 0")
              .withColumn("__j", F.explode(F.sequence(F.lit(0), most)))
              .withColumn("__spend", F.col("current") * low + F.col("__j") * F.col("__unit"))
              .select(*keys, "__i", "__j", response(
                  F.col("__spend"), F.col("beta"), F.col("alpha"), F.col("inflexion")).alias("__resp")))
    state = brand.filter("__steps >= 0").select(
        *keys, "__steps", F.lit(0).alias("__spent"), F.lit(0.0).alias("__total"),
        F.array().cast("array<int>").alias("__choice"))
    last = chans.agg(F.max("__i")).first()[0] or 0
    for i in range(1, last + 1):
        # a brand with fewer channels keeps its states
        nxt = state.join(levels.filter(F.col("__i") == i).drop("__i"), keys, "left").select(
            *keys, "__steps", (F.col("__spent") + F.coalesce("__j", F.lit(0))).alias("__spent"),
            F.struct((F.col("__total") + F.coalesce("__resp", F.lit(0.0))).alias("t"),
                     F.concat("__choice", F.array(F.coalesce("__j", F.lit(0)))).alias("c")).alias("__s"))
        state = (nxt.filter(F.col("__spent") <= F.col("__steps"))
                 .groupBy(*keys, "__steps", "__spent").agg(F.max("__s").alias("__s"))
                 .select(*keys, "__steps", "__spent", F.col("__s.t").alias("__total"),
                         F.col("__s.c").alias("__choice")))
    best = state.groupBy(*keys).agg(F.max(F.struct(
        F.col("__total").alias("t"), (-F.col("__spent")).alias("s"), F.col("__choice").alias("c"))).alias("__b"))
    res = chans.join(best, keys).withColumn(
        "spend_opt", F.col("current") * low + F.element_at("__b.c", F.col("__i")) * F.col("__unit"))
    return res.select(
        *by, channel, "current", "spend_opt",
        response(F.col("current"), F.col("beta"), F.col("alpha"), F.col("inflexion")).alias("response_current"),
        response(F.col("spend_opt"), F.col("beta"), F.col("alpha"), F.col("inflexion")).alias("response_opt"),
        F.col("__b.t").alias("total_response"))


def budget_scenarios(curves: DataFrame, low: float = 0.7, up: float = 1.5, units: int = 100) -> DataFrame:
    """Initial spend, bounded optimum, and optimum with the bounds
    widened three times, side by side."""
    init = (curves.withColumn("spend_opt", F.col("current"))
            .withColumn("response_opt", response(F.col("current"), F.col("beta"), F.col("alpha"),
                                                 F.col("inflexion")))
            .select("channel", "spend_opt", "response_opt").withColumn("scenario", F.lit("initial")))
    b1 = (allocate_budget(curves, low, up, units).select("channel", "spend_opt", "response_opt")
          .withColumn("scenario", F.lit("bounded")))
    b3 = (allocate_budget(curves, max(0.0, 1 - 3 * (1 - low)), 1 + 3 * (up - 1), units)
          .select("channel", "spend_opt", "response_opt").withColumn("scenario", F.lit("bounded_x3")))
    out = init.unionByName(b1).unionByName(b3)
    tot = out.groupBy("scenario").agg(F.sum("spend_opt").alias("__t"))
    return out.join(tot, "scenario").withColumn("spend_share", F.col("spend_opt") / F.col("__t")).drop("__t")
