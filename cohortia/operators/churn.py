"""Churn definition from each customer's own past periods.

Plan shape: transactions are partially aggregated per (customer, period)
(A10), then one shuffle by customer serves all the windows below. A customer
has at most one row per period, so window partitions are bounded by the
calendar (about 12 per year), whatever the customer's share of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .customer import ID, period_metrics

Z95 = 1.96


def period_ci(periods: DataFrame, days: int = 31) -> DataFrame:
    """H1: predicted money and its interval per customer x period.

    predicted = ticket * days / gap; SE = sqrt(sdT^2/n + sdG^2 * (T/gap^2)^2);
    bounds = predicted -/+ 1.96 SE when n > 1, else 0.8 T / 1.2 T; any missing
    bound (one distinct date, zero gap) also falls back to 0.8 T / 1.2 T.
    """
    t, gap = F.col("AVG_Ticket"), F.col("AVG_ipt")
    pred = t * F.try_divide(F.lit(float(days)), gap)
    se = F.sqrt(F.try_divide(F.col("STD_Ticket") ** 2, F.col("Purchases"))
                + F.col("STD_ipt") ** 2 * F.try_divide(t, gap * gap) ** 2)
    multi = F.col("Purchases") > 1
    return (periods
            .withColumn("Predicted_Monetary_Value", pred)
            .withColumn("Std_Error", se)
            .withColumn("CI_Lower", F.coalesce(F.when(multi, pred - Z95 * se), t * 0.8))
            .withColumn("CI_Upper", F.coalesce(F.when(multi, pred + Z95 * se), t * 1.2)))


def running_bounds(periods: DataFrame) -> DataFrame:
    """Cumulative sums of the bounds and the running row count."""
    w = Window.partitionBy(ID).orderBy("Period_ID").rowsBetween(Window.unboundedPreceding, 0)
    return (periods
            .withColumn("Cumulative_Sum_Lower", F.sum("CI_Lower").over(w))
            .withColumn("Cumulative_Sum_Upper", F.sum("CI_Upper").over(w))
            .withColumn("Cumulative_Count", F.count(F.lit(1)).over(w)))


def rolling_ci(periods: DataFrame) -> DataFrame:
    """The previous row's cumulative mean (mean of all earlier periods)."""
    w = Window.partitionBy(ID).orderBy("Period_ID")
    return (periods
            .withColumn("Rolling_CI_Lower",
                        F.lag(F.col("Cumulative_Sum_Lower") / F.col("Cumulative_Count")).over(w))
            .withColumn("Rolling_CI_Upper",
                        F.lag(F.col("Cumulative_Sum_Upper") / F.col("Cumulative_Count")).over(w)))


def combine_ci(periods: DataFrame) -> DataFrame:
    """Least / greatest of own and rolling bound (missing skipped)."""
    return (periods
            .withColumn("Combined_CI_Lower", F.least("CI_Lower", "Rolling_CI_Lower"))
            .withColumn("Combined_CI_Upper", F.greatest("CI_Upper", "Rolling_CI_Upper")))


def underperforming(periods: DataFrame) -> DataFrame:
    """H2: 1 when the period's money is below the combined lower bound."""
    return periods.withColumn(
        "Underperforming",
        F.when(F.col("Monetary_Value") < F.col("Combined_CI_Lower"), 1).otherwise(0))


def last_three_underperform(periods: DataFrame, last: int = 3) -> DataFrame:
    """1 on every row of a customer whose last ``last`` existing periods
    all underperform (needs at least ``last`` periods)."""
    whole = Window.partitionBy(ID)
    desc = Window.partitionBy(ID).orderBy(F.desc("Period_ID"))
    p = periods.withColumn("__rn", F.row_number().over(desc))
    hits = F.sum(F.when(F.col("__rn") <= last, F.col("Underperforming")).otherwise(0)).over(whole)
    n = F.count(F.lit(1)).over(whole)
    return (p.withColumn("Churned", F.when((n >= last) & (hits == last), 1).otherwise(0))
            .drop("__rn"))


def churn_flags(tx: DataFrame, days: int = 31, start: DataFrame | None = None) -> DataFrame:
    """H3: A10 → H1 → W2 → W3 → W4 → H2 → W5 on a transactions table
    (``start``: optional one-row first-date table, see ``with_period_id``)."""
    p = period_ci(period_metrics(tx, days, start), days)
    return last_three_underperform(underperforming(combine_ci(rolling_ci(running_bounds(p)))))


def churned_ids(flags: DataFrame) -> DataFrame:
    """Distinct ids of churned customers (partial distinct before the shuffle)."""
    return flags.where(F.col("Churned") > 0).select(ID).distinct()


def flag_in(df: DataFrame, ids: DataFrame, name: str, key: str = ID) -> DataFrame:
    """Boolean membership of ``key`` in a table of ids (left join on
    distinct ids; the id table is one row per key, so the join cannot grow)."""
    marks = ids.select(key).distinct().withColumn(name, F.lit(True))
    return (df.join(marks, key, "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(False))))


def customer_churn(customers: DataFrame, flags: DataFrame, recency_days: int = 31) -> DataFrame:
    """H4: churn = flagged by H3 or recency above ``recency_days``."""
    c = flag_in(customers, churned_ids(flags), "__flagged")
    return (c.withColumn("Churn", F.when(F.col("__flagged") | (F.col("Recency") > recency_days), 1)
                         .otherwise(0))
            .drop("__flagged"))


def count_distinct_flagged(df: DataFrame, flag: str, key: str = ID) -> DataFrame:
    """Number of distinct ids with a positive flag."""
    return df.where(F.col(flag) > 0).agg(F.count_distinct(key).alias("flagged_ids"))


def attach_segment(customers: DataFrame, segments: DataFrame, seg_col: str = "Final_Segment",
                   missing: str = "Not Clusterized") -> DataFrame:
    """Left join of a segment label on the customer id; missing → label."""
    s = segments.select(ID, seg_col).dropDuplicates([ID])
    return (customers.join(s, ID, "left")
            .withColumn(seg_col, F.coalesce(F.col(seg_col), F.lit(missing))))
