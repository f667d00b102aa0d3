"""Transactions → customer segments (survey section 3.1), composed lazily.

The customer table is persisted once: the outlier and label steps read it for
several quantile passes, so it lies in few partitions (``packed``), and the
tables filtered from it lie where it does. Everything up to k-means is one lazy
plan per action.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import customer as cu
from ..operators import segments as sg
from ..session import keep, packed

ROWS_A_PARTITION = 500_000   # of the packed customer table, at most


@dataclass
class RfmResult:
    customers: DataFrame      # all customers (A2)
    kept: DataFrame           # after the recency filter
    lapsed: DataFrame         # recency outliers
    super_: DataFrame         # super customers with their anomaly label
    regular: DataFrame        # labelled, segmented, scored regular customers
    recency_bound: float
    freq_bound: float
    money_bound: float


def rfm_segments(tx: DataFrame, filter_anomaly: bool = True) -> RfmResult:
    clean = cu.drop_sales_anomaly(tx) if filter_anomaly else tx
    customers = packed(cu.rfm_customers(clean), most=ROWS_A_PARTITION)
    kept, lapsed, rb = sg.recency_filter(customers)
    kept = keep(kept)
    sup, reg, fb, mb = sg.super_customers(kept)
    reg = keep(reg)
    labelled = sg.rfm_scores(sg.rfm_segment(sg.rfm_labels(reg)))
    return RfmResult(customers, kept, lapsed, sup, labelled, rb, fb, mb)


def segment_share_of(tx: DataFrame) -> DataFrame:
    """The minimum slice: P4 → W1/A2 → A12 filter → C1 → C3 → C4 → A16."""
    return sg.segment_share(rfm_segments(tx).regular)
