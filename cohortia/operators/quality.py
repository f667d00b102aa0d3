"""Data quality and descriptive tables.

Every report is a single aggregate pass with one ``count_if`` per rule (the
reference scans once per rule), followed by an ``unpivot`` of the one-row
result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

import math

from ..functions.stats import grouped_quantiles, normal_ppf_col, ordered_prefix_sums
from ..session import keep

# The eight transaction rules of the quality report, in the
# reference's order and wording.
ANOMALY_RULES: list[tuple[str, str]] = [
    ("Negative values in net_sales", "net_sales < 0"),
    ("Negative values in gross_sales", "gross_sales < 0"),
    ("Negative values in PL_gross_sales", "PL_gross_sales < 0"),
    ("If number_item_PL is NA, PL_gross_sales different from 0",
     "number_item_PL IS NULL AND PL_gross_sales <> 0"),
    ("PL_gross_sales > net_sales", "PL_gross_sales > net_sales"),
    ("PL_gross_sales > gross_sales", "PL_gross_sales > gross_sales"),
    ("net_sales > gross_sales", "net_sales > gross_sales"),
    ("Both number_item_PL and number_items_other are equal to 0",
     "number_item_PL = 0 AND number_items_other = 0"),
]


def rule_report(df: DataFrame, rules: Sequence[tuple[str, str]],
                name: str = "Anomaly") -> DataFrame:
    """Count rows matching each SQL predicate and their percent of all rows."""
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.expr(pred)).alias(f"__r{i}") for i, (_, pred) in enumerate(rules)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(label).alias(name), F.col(f"__r{i}").alias("Count"),
                 (F.try_divide(F.col(f"__r{i}"), F.col("__n")) * 100).alias("Percentage"))
        for i, (label, _) in enumerate(rules)])).alias("s")).select("s.*")


def anomaly_report(tx: DataFrame) -> DataFrame:
    """A1: eight rule counts and percent of rows."""
    return rule_report(tx, ANOMALY_RULES)


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values per column (one pass, then unpivot)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "missing")


def mode_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill missing values with the column mode (lowest on ties)."""
    modes = df.agg(*[F.mode(c, True).alias(f"__m_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(modes))
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__m_{c}")))
    return out.drop(*[f"__m_{c}" for c in cols])


def histogram(df: DataFrame, col: str, width: float = 1.0) -> DataFrame:
    """Counts of fixed-width bins ``[k*w, (k+1)*w)``."""
    b = F.floor(F.col(col) / F.lit(width))
    return (df.where(F.col(col).isNotNull())
            .groupBy((b * F.lit(width)).cast("double").alias("bin_start"))
            .agg(F.count(F.lit(1)).alias("count")))


def histogram_bins(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """``bins`` equal-width bins between min and max (last bin closed)."""
    mm = df.agg(F.min(col).alias("__mn"), F.max(col).alias("__mx"))
    x = df.select(col).where(F.col(col).isNotNull()).crossJoin(F.broadcast(mm))
    width = (F.col("__mx") - F.col("__mn")) / bins
    idx = F.least(F.floor(F.try_divide(F.col(col) - F.col("__mn"), width)),
                  F.lit(bins - 1))
    idx = F.coalesce(idx, F.lit(0)).cast("int")
    return (x.groupBy(idx.alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"),
                 F.first(F.col("__mn") + idx * width).alias("bin_start")))


def box_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    """Quartiles, whiskers (1.5 IQR) and outlier count per group."""
    q = grouped_quantiles(df, [by], col, [0.25, 0.5, 0.75])
    q = q.select(by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                 F.col("q")[2].alias("q3")).persist()
    q.count()       # its size is known then, so that few groups are broadcast
    j = df.select(by, col).join(q, by)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    x = F.col(col)
    return j.groupBy(by).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(x >= lo, x)).alias("lower_whisker"),
        F.max(F.when(x <= hi, x)).alias("upper_whisker"),
        F.count_if((x < lo) | (x > hi)).alias("outliers"),
        F.count(x).alias("n"))


def proportion_crosstab(df: DataFrame, row: str, target: str) -> DataFrame:
    """Counts per (row, target) and the share within the row."""
    c = df.groupBy(row, target).agg(F.count(F.lit(1)).alias("count"))
    tot = c.groupBy(row).agg(F.sum("count").alias("__t"))
    return (c.join(tot, row)
            .withColumn("proportion", F.col("count") / F.col("__t")).drop("__t"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlations on complete rows, long form (var1, var2, corr).

    One aggregate pass computes every pair's ``corr``.
    """
    cols = list(cols)
    d = df.select(*cols).dropna()
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = d.agg(*[F.corr(a, b).alias(f"__c{i}") for i, (a, b) in enumerate(pairs)])
    items = []
    for i, (a, b) in enumerate(pairs):
        val = F.lit(1.0) if a == b else F.col(f"__c{i}")
        items.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), val.alias("corr")))
        if a != b:
            items.append(F.struct(F.lit(b).alias("var1"), F.lit(a).alias("var2"),
                                  val.alias("corr")))
    return row.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def kde(df: DataFrame, col: str, by: str, grid: DataFrame,
        bandwidth: float | None = None, adjust: float = 1.0) -> DataFrame:
    """Gaussian kernel density per group on a grid of points.

    Bandwidth: the given one, else Scott's rule per group (sample SD times
    n^(-1/5), the default of the Python reference), times ``adjust`` (the R
    variant smooths 1.5 times as much). The grid is small by
    construction (tens of points) and broadcast; the sum over rows is a grouped
    aggregate with partial sums per task.
    """
    x = df.select(by, F.col(col).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    st = x.groupBy(by).agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp("__x").alias("__sd"))
    bw = (F.lit(float(bandwidth)) if bandwidth is not None
          else F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
    st = st.withColumn("__h", bw * F.lit(float(adjust)))
    z = (F.col("point") - F.col("__x")) / F.col("__h")
    dens = (x.join(F.broadcast(st.select(by, "__h")), by)
            .crossJoin(F.broadcast(grid.select("point")))
            .groupBy(by, "point").agg(F.sum(F.exp(-0.5 * z * z)).alias("__s")))
    return (dens.join(st, by)
            .select(by, "point",
                    (F.col("__s") / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi)))
                    .alias("density")))


def even_grid(df: DataFrame, col: str, points: int = 50) -> DataFrame:
    """``points`` evenly spaced values from the column's min to its max."""
    mm = df.agg(F.min(col).cast("double").alias("__mn"), F.max(col).cast("double").alias("__mx"))
    return (df.sparkSession.range(points).crossJoin(mm)
            .select((F.col("__mn") + (F.col("__mx") - F.col("__mn")) * F.col("id") / (points - 1))
                    .alias("point")))


def qq_points(df: DataFrame, col: str) -> DataFrame:
    """Ordered sample values against standard normal quantiles at
    (i - 0.5) / n. Ranks come from a bucketed prefix count over distinct
    values, not from one global window."""
    x = df.select(F.col(col).cast("double").alias("sample")).where(F.col("sample").isNotNull())
    counted = x.groupBy("sample").agg(F.count(F.lit(1)).alias("__c"))
    pre = ordered_prefix_sums(counted, "sample", ["__c"], inclusive=False)
    n = x.agg(F.count(F.lit(1)).alias("__n"))
    # a value repeated many times is emitted in chunks of at most CHUNK ranks,
    # spread over tasks, so a hot value does not expand inside one task
    chunk = 1_000_000
    starts = (pre.crossJoin(F.broadcast(n))
              .withColumn("__s", F.explode(F.sequence(F.lit(0), (F.col("__c") - 1).cast("int"),
                                                      F.lit(chunk))))
              .repartition("sample", "__s"))
    rows = (starts.withColumn("__k", F.explode(F.sequence(
        F.col("__s") + 1, F.least(F.col("__s") + chunk, F.col("__c")).cast("int"))))
            .withColumn("i", (F.col("__c_cum") + F.col("__k")).cast("long")))
    return rows.select("i", "sample",
                       normal_ppf_col((F.col("i") - 0.5) / F.col("__n")).alias("theoretical"))


def data_quality_report(df: DataFrame, rules: Mapping[str, Sequence[tuple[str, str]]] | None = None
                        ) -> DataFrame:
    """Accuracy / completeness / consistency / validity rule counts.

    ``rules`` maps a dimension to (rule label, SQL predicate of a *bad* row).
    The default covers the customer table.
    """
    rules = rules or {
        "completeness": [(f"{c} is missing", f"{c} IS NULL") for c in df.columns],
        "validity": [("negative account balance", "c_acctbal < 0")] if "c_acctbal" in df.columns else [],
        "consistency": [("name does not follow pattern", "NOT c_name RLIKE '^Customer#[0-9]+$'")]
        if "c_name" in df.columns else [],
        "accuracy": [("non-positive key", "id_customer <= 0")] if "id_customer" in df.columns else [],
    }
    flat = [(dim, lab, pred) for dim, rs in rules.items() for lab, pred in rs]
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.expr(p)).alias(f"__r{i}") for i, (_, _, p) in enumerate(flat)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(dim).alias("dimension"), F.lit(lab).alias("rule"),
                 F.col(f"__r{i}").alias("failing"),
                 (F.try_divide(F.col(f"__r{i}"), F.col("__n")) * 100).alias("percent"))
        for i, (dim, lab, _) in enumerate(flat)])).alias("s")).select("s.*")


def profit_by_demographic(tx: DataFrame, customers: DataFrame,
                          group: str = "c_mktsegment") -> DataFrame:
    """Sales, count and mean per demographic group.

    Transactions are aggregated per customer first, so the join carries one
    row per customer instead of one per transaction.
    """
    per_c = tx.groupBy("id_customer").agg(F.sum("gross_sales").alias("__s"),
                                          F.count(F.lit(1)).alias("__k"))
    return (per_c.join(customers.select("id_customer", group), "id_customer")
            .groupBy(group)
            .agg(F.sum("__s").alias("total_sales"),
                 F.sum("__k").alias("transactions"),
                 F.count(F.lit(1)).alias("customers"),
                 (F.sum("__s") / F.sum("__k")).alias("avg_ticket")))


def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column count, missing, distinct, mean, sd, min, quartiles, max.

    Numeric columns get moments and exact quartiles; text columns get count,
    distinct and mode. The quartiles of all numeric columns come from one
    quantile pass over (column, value) rows. All of them read the columns, which
    are made once.
    """
    cols = list(cols or df.columns)
    df = keep(df.select(*dict.fromkeys(cols)))
    fields = {f.name: f.dataType for f in df.schema.fields}
    number = [c for c in cols if isinstance(fields[c], NumericType)]
    parts = []
    for c in cols:
        numeric = c in number
        parts.append(df.agg(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.count_if(F.col(c).isNull()).alias("missing"),
            F.count_distinct(c).alias("distinct"),
            (F.avg(c) if numeric else F.lit(None).cast("double")).alias("mean"),
            (F.stddev_samp(c) if numeric else F.lit(None).cast("double")).alias("sd"),
            (F.min(c) if numeric else F.lit(None)).cast("double").alias("min"),
            (F.max(c) if numeric else F.lit(None)).cast("double").alias("max"),
            (F.lit(None) if numeric else F.mode(c, True)).cast("string").alias("mode")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if number:
        long = df.select(F.explode(F.array(*[F.struct(
            F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in number])).alias("s")).select("s.*")
        q = grouped_quantiles(long, ["column"], "v", [0.25, 0.5, 0.75])
    else:
        q = df.sparkSession.createDataFrame([], "column string, q array<double>")
    return out.join(q, "column", "left").select(
        "column", "count", "missing", "distinct", "mean", "sd", "min", F.get("q", F.lit(0)).alias("q1"),
        F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "max", "mode")
