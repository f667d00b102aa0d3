"""Customer value: outlier rules, RFM labels, segments, summaries.

Quantiles are exact (``functions.stats.quantiles``) and come back as a few
driver scalars; every per-row comparison is then a literal predicate, which
Catalyst folds into the scan filter. Sweeps over many cut-offs (A13-A15) run
as one aggregate with one ``count_if`` per cut-off instead of one scan each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import round_half_even
from ..functions.stats import quantile_counts, quantiles, quantiles_by_col

# Fixed values that must equal the reference: the 27 (recency, frequency,
# money) label triples listed for each segment, in rule order. 25 of the 27
# triples are listed; M/M/H and L/H/L fall through to "Unclassified".
SEGMENT_RULES = {
    "Champions": ["HHH", "HMH", "HHM"],
    "Loyal": ["MHH", "MHM"],
    "Cannot Lose": ["LMH", "LHH", "LHM"],
    "Potential Loyalist": ["HMM", "HML", "HLM", "HHL"],
    "As New": ["HLL", "HLH", "MHL"],
    "To Reactivate": ["MLH", "MLM"],
    "Searching for Attention": ["MMM", "MML"],
    "About to Sleep": ["LLM", "LMM", "LLH"],
    "Bad": ["MLL", "LML", "LLL"],
}
SCORE_MAP = {"H": 3, "M": 2, "L": 1}
CLUSTER_NAMES = ["Low Engagement", "Consistently Moderate", "Highly Active and Recent"]
SUPER_NAME = "Super Customer"


def segment_table(spark: SparkSession) -> DataFrame:
    """The 27-row (triple, segment) table, for broadcast joins."""
    rows = []
    seen = set()
    for seg, triples in SEGMENT_RULES.items():
        for t in triples:
            if t not in seen:
                seen.add(t)
                rows.append((t, seg))
    return spark.createDataFrame(rows, "triple string, Customer_Segment string")


def iqr_bound(df: DataFrame, col: str, lo: float = 0.25, hi: float = 0.75,
              mult: float = 1.5) -> float:
    """q(hi) + mult * (q(hi) - q(lo))."""
    qlo, qhi = quantiles(df, col, [lo, hi])
    return qhi + mult * (qhi - qlo)


def filter_at_most(df: DataFrame, col: str, bound: float) -> tuple[DataFrame, DataFrame]:
    """(kept: col <= bound, rejected: col > bound)."""
    return df.where(F.col(col) <= F.lit(bound)), df.where(F.col(col) > F.lit(bound))


def recency_filter(customers: DataFrame, lo: float = 0.25, hi: float = 0.80,
                   mult: float = 2.0) -> tuple[DataFrame, DataFrame, float]:
    """Drop lapsed customers: Recency above q80 + 2 * (q80 - q25)."""
    bound = iqr_bound(customers, "Recency", lo, hi, mult)
    kept, rejected = filter_at_most(customers, "Recency", bound)
    return kept, rejected, bound


def outlier_sweep(df: DataFrame, col: str, lo: float = 0.25, hi: float = 0.80,
                  mults: Sequence[float] = (1.0, 1.5, 2.0, 2.5, 3.0)) -> DataFrame:
    """Outlier count and percent above q(hi) + m * IQR for each m, in one pass."""
    qlo, qhi = quantiles(df, col, [lo, hi])
    iqr = qhi - qlo
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(F.col(col) > F.lit(qhi + m * iqr)).alias(f"c{i}")
                   for i, m in enumerate(mults)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(float(m)).alias("Multiplier"),
                 F.col(f"c{i}").alias("Outliers_Count"),
                 (F.col(f"c{i}") / F.col("n") * 100).alias("Outlier_Percentage"))
        for i, m in enumerate(mults)])).alias("s")).select("s.*")


def percentile_grid(lo_pct: int = 70, hi_pct: int = 99) -> list[float]:
    """0.70 ... 0.99 built from integers (30 values; see survey section 8)."""
    return [k / 100 for k in range(lo_pct, hi_pct + 1)]


def percentile_sweep(df: DataFrame, cols: Sequence[str] = ("Frequency", "Monetary_Value"),
                     names: Sequence[str] = ("Freq_Outliers", "Monetary_Outliers"),
                     probs: Sequence[float] | None = None) -> DataFrame:
    """Rows strictly above each quantile, per column. The counts come
    with the quantiles, so the rows are not read again."""
    probs = list(probs or percentile_grid())
    found = quantile_counts(df, {c: probs for c in cols})
    rows = [(float(p), *[found[c][i][2] - found[c][i][1] if found[c][i] else 0 for c in cols])
            for i, p in enumerate(probs)]
    return df.sparkSession.createDataFrame(
        rows, "Percentile double, " + ", ".join(f"`{nm}` bigint" for nm in names))


def two_bound_sweep(df: DataFrame, q: float = 0.75,
                    mults: Sequence[float] = (1.0, 1.5, 2.0, 2.5, 3.0)) -> DataFrame:
    """Frequency and money bounds q + m * IQR and the counts above them."""
    qs = quantiles_by_col(df, {c: [0.25, q, 0.75] for c in ("Frequency", "Monetary_Value")})
    f25, fq, f75 = qs["Frequency"]
    m25, mq, m75 = qs["Monetary_Value"]
    fiqr, miqr = f75 - f25, m75 - m25
    fb = [fq + m * fiqr for m in mults]
    mb = [mq + m * miqr for m in mults]
    row = df.agg(*[F.count_if(F.col("Frequency") > F.lit(b)).alias(f"f{i}") for i, b in enumerate(fb)],
                 *[F.count_if(F.col("Monetary_Value") > F.lit(b)).alias(f"m{i}")
                   for i, b in enumerate(mb)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(float(m)).alias("Multiplier"),
                 F.lit(fb[i]).alias("Freq_Upper_Bound"),
                 F.lit(mb[i]).alias("Monetary_Upper_Bound"),
                 F.col(f"f{i}").alias("Freq_Outliers"),
                 F.col(f"m{i}").alias("Monetary_Outliers"))
        for i, m in enumerate(mults)])).alias("s")).select("s.*")


def super_customers(df: DataFrame, q: float = 0.75, mult: float = 1.5
                    ) -> tuple[DataFrame, DataFrame, float, float]:
    """(super, regular, frequency bound, money bound).

    Super: frequency or money above q + mult * IQR; ``anomaly`` says which,
    frequency first. Regular is the complement.
    """
    qs = quantiles_by_col(df, {c: [0.25, q, 0.75] for c in ("Frequency", "Monetary_Value")})
    f25, fq, f75 = qs["Frequency"]
    m25, mq, m75 = qs["Monetary_Value"]
    fb = fq + mult * (f75 - f25)
    mb = mq + mult * (m75 - m25)
    over_f = F.col("Frequency") > F.lit(fb)
    over_m = F.col("Monetary_Value") > F.lit(mb)
    sup = (df.where(over_f | over_m)
           .withColumn("anomaly", F.when(over_f, "frequency").otherwise("monetary")))
    reg = df.where((F.col("Frequency") <= F.lit(fb)) & (F.col("Monetary_Value") <= F.lit(mb)))
    return sup, reg, fb, mb


def rfm_labels(df: DataFrame, lo: float = 0.2, mid: float = 0.5) -> DataFrame:
    """H/M/L labels at the 0.2 and 0.5 quantiles; recency reversed."""
    qs = quantiles_by_col(df, {c: [lo, mid] for c in ("Monetary_Value", "Frequency", "Recency")})
    m1, m2 = qs["Monetary_Value"]
    f1, f2 = qs["Frequency"]
    r1, r2 = qs["Recency"]

    def lab(c, a, b, reverse=False):
        x = F.col(c)
        hi, low = ("L", "H") if reverse else ("H", "L")
        return F.when(x <= F.lit(a), low).when(x <= F.lit(b), "M").otherwise(hi)

    return (df.withColumn("Monetary_Label", lab("Monetary_Value", m1, m2))
            .withColumn("Frequency_Label", lab("Frequency", f1, f2))
            .withColumn("Recency_Label", lab("Recency", r1, r2, reverse=True)))


def rfm_segment(df: DataFrame) -> DataFrame:
    """C4: map the (R, F, M) label triple to one of nine segments.

    A 27-entry literal map: evaluated per row inside generated code, no join.
    """
    pairs = []
    seen = set()
    for seg, triples in SEGMENT_RULES.items():
        for t in triples:
            if t not in seen:
                seen.add(t)
                pairs += [F.lit(t), F.lit(seg)]
    key = F.concat("Recency_Label", "Frequency_Label", "Monetary_Label")
    return df.withColumn("Customer_Segment",
                         F.coalesce(F.try_element_at(F.create_map(*pairs), key),
                                    F.lit("Unclassified")))


def rfm_scores(df: DataFrame) -> DataFrame:
    """H/M/L → 3/2/1 for each label."""
    m = F.create_map(*[x for kv in SCORE_MAP.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return (df.withColumn("Recency_Score", F.try_element_at(m, F.col("Recency_Label")))
            .withColumn("Frequency_Score", F.try_element_at(m, F.col("Frequency_Label")))
            .withColumn("Monetary_Score", F.try_element_at(m, F.col("Monetary_Label"))))


def segment_share(df: DataFrame, col: str = "Customer_Segment",
                  name: str = "Customer_Type") -> DataFrame:
    """Count and percent (2 places) per label, largest first.

    Counts are aggregated first; the grand total is a window over the few
    label rows only.
    """
    counts = df.groupBy(F.col(col).alias(name)).agg(F.count(F.lit(1)).alias("Frequency"))
    total = F.sum("Frequency").over(Window.partitionBy())
    return (counts.withColumn("Percentage", round_half_even(F.col("Frequency") / total * 100, 2))
            .orderBy(F.desc("Percentage"), name))


def count_by(df: DataFrame, col: str) -> DataFrame:
    """Value counts."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def trim_super(sup: DataFrame, q: float = 0.8) -> DataFrame:
    """C11: keep super customers strictly below their own q quantile in
    both money and frequency."""
    qs = quantiles_by_col(sup, {"Monetary_Value": [q], "Frequency": [q]})
    mq, fq = qs["Monetary_Value"][0], qs["Frequency"][0]
    return sup.where((F.col("Monetary_Value") < F.lit(mq)) & (F.col("Frequency") < F.lit(fq)))


def name_clusters(df: DataFrame, cluster_col: str = "Cluster",
                  score_cols: Sequence[str] = ("Recency_Score", "Frequency_Score",
                                               "Monetary_Score"),
                  names: Sequence[str] = CLUSTER_NAMES) -> DataFrame:
    """Name clusters by the order of their centroid sum (low → high).

    Cluster ids from k-means depend on the run; the centroid order does not.
    """
    cent = (df.groupBy(cluster_col)
            .agg(sum(F.avg(c) for c in score_cols).alias("__csum")))
    order = Window.orderBy("__csum", cluster_col)
    named = cent.withColumn("__rk", F.row_number().over(order))
    nm = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__rk").cast("int"))
    named = named.select(cluster_col, F.coalesce(nm, F.lit("Unclassified")).alias("Simplified_Cluster"))
    return df.join(F.broadcast(named), cluster_col, "left")


def final_segments(regular_named: DataFrame, super_trimmed: DataFrame) -> DataFrame:
    """Clusters keep their name, trimmed super customers are added."""
    a = regular_named.withColumn("Final_Segment", F.col("Simplified_Cluster"))
    b = super_trimmed.withColumn("Final_Segment", F.lit(SUPER_NAME))
    return a.unionByName(b, allowMissingColumns=True)


def cluster_summary(df: DataFrame, by: str = "Final_Segment") -> DataFrame:
    """Means per segment, count, and PL share of the item means."""
    g = df.groupBy(by).agg(
        F.avg("Monetary_Value").alias("Avg_Monetary_Value"),
        F.avg("AVG_Ticket").alias("AVG_Ticket"),
        F.avg("Frequency").alias("Avg_Visits"),
        F.avg("Recency").alias("Avg_Recency"),
        F.avg("AVG_ipt").alias("AVG_IPT"),
        F.count("Monetary_Value").alias("Total_Customers"),
        F.avg("Number_item_other").alias("Avg_Number_Item_Other"),
        F.avg("Number_item_PL").alias("Avg_Number_Item_PL"))
    return g.withColumn("PL_on_Tot", F.try_divide(
        F.col("Avg_Number_Item_PL"),
        F.col("Avg_Number_Item_PL") + F.col("Avg_Number_Item_Other")))


def top_prospects(customers: DataFrame, score_col: str, n: int = 1000,
                  id_col: str = "id_customer") -> DataFrame:
    """T4: the n most promising customers, ties broken by id.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps its
    own top n, only n rows per task reach the final merge.
    """
    return customers.orderBy(F.desc(score_col), F.asc(id_col)).limit(n)
