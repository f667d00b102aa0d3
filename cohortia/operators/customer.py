"""Per-customer and per-period metrics.

Plan shape: one ``groupBy(id_customer)`` with map-side partial aggregation.
The distinct purchase dates of a customer travel as a ``collect_set`` — its
size is bounded by the number of calendar days in the data, not by the row
count, so even a customer holding a third of all rows costs one bounded array
per map task. Gaps between consecutive distinct dates are then computed with
array functions inside the same stage (no second shuffle, no window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ID = "id_customer"


# --------------------------------------------------------------------------
# Filters on transactions
def drop_sales_anomaly(tx: DataFrame) -> DataFrame:
    """Keep rows with net < gross (strict; equal rows go too)."""
    return tx.where(F.col("net_sales") < F.col("gross_sales"))


def sales_anomaly_rows(tx: DataFrame) -> DataFrame:
    """P5: rows with net > gross, as a reject table."""
    return tx.where(F.col("net_sales") > F.col("gross_sales"))


def dataset_bounds(tx: DataFrame) -> DataFrame:
    """One row (max_date, min_date)."""
    return tx.agg(F.max("date").alias("max_date"), F.min("date").alias("min_date"))


def tx_per_month(tx: DataFrame) -> DataFrame:
    """Number of transactions per calendar month ``yyyy-MM``."""
    return (tx.groupBy(F.date_format("date", "yyyy-MM").alias("Month"))
            .agg(F.count(F.lit(1)).alias("Transactions")))


# --------------------------------------------------------------------------
# Gap statistics on a sorted array of distinct dates: linear in its length
# (an aggregate named inside a lambda runs again for every element)
def _gap_sd(dates: Column) -> Column:
    """Sample SD of the day gaps between consecutive entries of a sorted date
    array; NULL with fewer than two gaps.

    One walk over the array sums the squared gaps (the gaps themselves add up
    to the days from first to last). Gaps are whole days, so both sums are
    exact and equal gaps give exactly zero.
    """
    start = F.struct(F.lit(None).cast("date").alias("last"), F.lit(0.0).alias("squares"))

    def step(acc, d):
        gap = F.coalesce(F.datediff(d, acc["last"]), F.lit(0))
        return F.struct(d.alias("last"), (acc["squares"] + F.pow(gap, F.lit(2.0))).alias("squares"))

    n = (F.size(dates) - 1).cast("double")
    squares = F.aggregate(dates, start, step, lambda acc: acc["squares"])
    total = F.datediff(F.try_element_at(dates, F.lit(-1)), F.try_element_at(dates, F.lit(1)))
    return F.when(n > 1, F.sqrt(F.greatest(n * squares - F.pow(total, F.lit(2.0)), F.lit(0.0)) / (n * (n - 1))))


def purchase_gaps(tx: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per (keys, distinct date) with days since the previous
    distinct date of the same key (NULL for the first)."""
    keys = keys or [ID]
    w = Window.partitionBy(*keys).orderBy("date")
    return (tx.select(*keys, "date").distinct()
            .withColumn("gap_days", F.datediff("date", F.lag("date").over(w))))


# --------------------------------------------------------------------------
def rfm_customers(tx: DataFrame) -> DataFrame:
    """A2: recency, frequency, money and gap / ticket statistics per customer.

    Recency is measured to the latest date of the whole table, taken as the
    maximum last purchase over customers (a one-row broadcast computed from
    the same aggregate, so the input is scanned once).
    """
    return _customer_agg(tx, extended=False)


def churn_customers(tx: DataFrame) -> DataFrame:
    """A3: A2 plus item means, PL ratio (A4), modal store type (A5), mean
    discount (A6), purchase months (A7), regularity (A8), other-only (P18)."""
    return _customer_agg(tx, extended=True)


def _customer_agg(tx: DataFrame, extended: bool) -> DataFrame:
    aggs = [
        F.sum("gross_sales").alias("Monetary_Value"),
        F.sort_array(F.collect_set("date")).alias("__dates"),
        F.max("date").alias("Last_Purchase"),
        F.min("date").alias("First_Purchase"),
        F.avg("gross_sales").alias("AVG_Ticket"),
        F.stddev_samp("gross_sales").alias("STD_Ticket"),
        F.coalesce(F.sum("number_items_other"), F.lit(0)).cast("bigint").alias("Number_item_other"),
        F.coalesce(F.sum("number_item_PL"), F.lit(0)).cast("bigint").alias("Number_item_PL"),
    ]
    if extended:
        aggs += [
            F.avg("number_items_other").alias("AVG_item_other_per_transaction"),
            F.avg("number_item_PL").alias("AVG_item_PL_per_transaction"),
            F.mode("store_type", True).alias("Store_Type_Variety"),
            F.avg(1 - F.try_divide(F.col("net_sales"), F.col("gross_sales"))).alias("AVG_Discount"),
        ]
    # one row per customer, read twice (the reference date and the rows):
    # persisted so the input is scanned once even though column pruning
    # would give the two branches different scans
    g = tx.groupBy(ID).agg(*aggs).persist()
    # the table's latest date is the latest last purchase
    ref = g.agg(F.max("Last_Purchase").alias("__ref"))
    g = g.crossJoin(F.broadcast(ref))
    dates = F.col("__dates")
    freq = F.size(dates).cast("bigint")
    out = g.select(
        ID, "Monetary_Value",
        freq.alias("Frequency"),
        F.datediff("__ref", "Last_Purchase").alias("Recency"),
        "First_Purchase", "Last_Purchase",
        F.when(freq > 1, F.datediff("Last_Purchase", "First_Purchase") / (freq - 1))
        .alias("AVG_ipt"),
        _gap_sd(dates).alias("STD_ipt"),
        "AVG_Ticket", "STD_Ticket", "Number_item_other", "Number_item_PL",
        *([
            "AVG_item_other_per_transaction", "AVG_item_PL_per_transaction",
            pl_ratio("AVG_item_PL_per_transaction", "AVG_item_other_per_transaction")
            .alias("PL_ratio"),
            "Store_Type_Variety", "AVG_Discount",
            F.size(F.array_distinct(F.transform(
                dates, lambda d: F.floor(F.datediff(d, F.element_at(dates, 1)) / 30))))
            .cast("bigint").alias("Purchase_Months"),
            _gap_sd(dates).alias("Regularity"),
            ((F.col("Number_item_PL") == 0) & (F.col("Number_item_other") > 0))
            .alias("Purchased_Other_Only"),
        ] if extended else []),
    )
    return out


def pl_ratio(pl_mean: str, other_mean: str) -> Column:
    """A4: PL mean / (PL mean + other mean) when that sum is positive."""
    s = F.col(pl_mean) + F.col(other_mean)
    return F.when(s > 0, F.try_divide(F.col(pl_mean), s))


# --------------------------------------------------------------------------
def first_date(customers: DataFrame) -> DataFrame:
    """The table's first date from a customer table (one row, ``min_date``)."""
    return customers.agg(F.min("First_Purchase").alias("min_date"))


def with_period_id(tx: DataFrame, days: int = 31, start: DataFrame | None = None) -> DataFrame:
    """``floor(days since the table's first date / days)``.

    ``start`` is a one-row table holding that first date; pipelines that
    already have the customer table pass ``first_date(customers)`` so the
    transactions are not read a second time just for their minimum date.
    """
    first = (start.select(F.col(start.columns[0]).alias("min_date")) if start is not None
             else dataset_bounds(tx).select("min_date"))
    return (tx.crossJoin(F.broadcast(first))
            .withColumn("Period_ID",
                        F.floor(F.datediff("date", "min_date") / days).cast("int"))
            .drop("min_date"))


def period_metrics(tx: DataFrame, days: int = 31, start: DataFrame | None = None) -> DataFrame:
    """A10: per customer x period: money, rows, gap mean (span / (rows-1)),
    gap SD over distinct dates, ticket mean and SD."""
    t = with_period_id(tx, days, start)
    g = t.groupBy(ID, "Period_ID").agg(
        F.sum("gross_sales").alias("Monetary_Value"),
        F.count(F.lit(1)).alias("Purchases"),
        F.max("date").alias("__last"),
        F.min("date").alias("__first"),
        F.sort_array(F.collect_set("date")).alias("__dates"),
        F.avg("gross_sales").alias("AVG_Ticket"),
        F.stddev_samp("gross_sales").alias("STD_Ticket"),
    )
    n = F.col("Purchases")
    return g.select(
        ID, "Period_ID", "Monetary_Value", "Purchases",
        F.when(n > 1, F.datediff("__last", "__first") / (n - 1)).alias("AVG_ipt"),
        _gap_sd(F.col("__dates")).alias("STD_ipt"),
        "AVG_Ticket", "STD_Ticket")
