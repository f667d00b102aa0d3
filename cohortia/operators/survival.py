"""Survival curves (M26 Kaplan–Meier, M27 log-rank).

Rows are first counted per (group, time); the product-limit recursion then
runs as running sums of logs over those counts. Durations are discrete
(months, days), so a group's distinct times are bounded by the calendar and
the per-group windows stay small whatever the row count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import chi2_sf
from ..session import keep

Z95 = 1.959963984540054


def _counts(df: DataFrame, time: str, event: str, by: str | None) -> tuple[DataFrame, list[str]]:
    keys = [by] if by else []
    g = (df.where(F.col(time).isNotNull() & F.col(event).isNotNull())
         .groupBy(*keys, F.col(time).alias("time"))
         .agg(F.count(F.lit(1)).alias("__c"),
              F.sum(F.col(event).cast("long")).alias("n_event")))
    return g, keys


def kaplan_meier(df: DataFrame, time: str, event: str, by: str | None = None) -> DataFrame:
    """Survival probability per distinct time, with R's default (log) 95 %
    interval: S·exp(±1.96·se), se² = Σ d / (n (n − d))."""
    g, keys = _counts(df, time, event, by)
    desc = Window.partitionBy(*keys).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    asc = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    n, d = F.col("n_risk"), F.col("n_event")
    alive = d < n
    k = (g.withColumn("n_risk", F.sum("__c").over(desc))
         .withColumn("n_censor", F.col("__c") - d)
         .withColumn("__ls", F.sum(F.when(alive, F.log(1 - d / n)).otherwise(0.0)).over(asc))
         .withColumn("__z", F.sum(F.when(alive, 0).otherwise(1)).over(asc))
         .withColumn("__gw", F.sum(F.when(alive, d / (n * (n - d))).otherwise(0.0)).over(asc)))
    s = F.when(F.col("__z") > 0, F.lit(0.0)).otherwise(F.exp("__ls"))
    se = F.when(F.col("__z") > 0, F.lit(None).cast("double")).otherwise(F.sqrt("__gw"))
    return k.select(*keys, "time", "n_risk", "n_event", "n_censor",
                    s.alias("survival"), se.alias("std_err"),
                    (s * F.exp(-Z95 * se)).alias("lower"),
                    F.least(F.lit(1.0), s * F.exp(Z95 * se)).alias("upper"))


def log_rank_table(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """Per group: observed and expected events and the per-time variance
    terms needed by the test; every (group, time) pair is filled in so the
    at-risk counts are correct at every event time."""
    # groups x times rows, read several times below
    g = keep(_counts(df, time, event, by)[0])
    groups = g.select(by).distinct()
    times = g.select("time").distinct()
    grid = (groups.crossJoin(times)
            .join(g, [by, "time"], "left")
            .fillna(0, subset=["__c", "n_event"]))
    desc = Window.partitionBy(by).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("n_risk", F.sum("__c").over(desc))
    tot = grid.groupBy("time").agg(F.sum("n_risk").alias("N"), F.sum("n_event").alias("D"))
    return grid.join(tot, "time")


def log_rank(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """Observed, expected, (O−E)²/E per group, and the G−1 df chi-square
    statistic with its p-value (the G × G variance is inverted on the driver;
    G is the number of groups)."""
    t = log_rank_table(df, time, event, by).where(F.col("N") > 0)
    oe = (t.groupBy(by).agg(F.sum("n_event").alias("observed"),
                            F.sum(F.col("n_risk") * F.col("D") / F.col("N")).alias("expected")))
    # variance terms v_gh = Σ_t D (N − D) / (N − 1) · n_g / N · (δ_gh − n_h / N)
    f = F.when(F.col("N") > 1, F.col("D") * (F.col("N") - F.col("D")) / (F.col("N") - 1)).otherwise(0.0)
    a = t.select("time", F.col(by).alias("g"), (F.col("n_risk") / F.col("N")).alias("pg"), f.alias("f"))
    b = t.select("time", F.col(by).alias("h"), (F.col("n_risk") / F.col("N")).alias("ph"))
    v = (a.join(b, "time")
         .groupBy("g", "h")
         .agg(F.sum(F.col("f") * F.col("pg") *
                    (F.when(F.col("g") == F.col("h"), 1.0).otherwise(0.0) - F.col("ph"))).alias("v")))
    oe_rows = sorted(oe.collect(), key=lambda r: str(r[by]))
    names = [r[by] for r in oe_rows]
    idx = {nm: i for i, nm in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in v.collect():
        m[idx[r["g"]], idx[r["h"]]] = r["v"]
    diff = np.array([r["observed"] - r["expected"] for r in oe_rows], dtype=float)
    if len(names) > 1:
        sub = m[:-1, :-1]
        chisq = float(diff[:-1] @ np.linalg.pinv(sub) @ diff[:-1])
        p = chi2_sf(chisq, len(names) - 1)
    else:
        chisq, p = 0.0, 1.0
    stat = df.sparkSession.createDataFrame([(chisq, p, len(names) - 1)],
                                           "chisq double, p_value double, dof int")
    return (oe.withColumn("oe_term", (F.col("observed") - F.col("expected")) ** 2 / F.col("expected"))
            .crossJoin(stat))
