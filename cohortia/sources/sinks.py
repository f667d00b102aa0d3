"""Sinks (S5-S7): tables, multi-table reports and model parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from .workbook import write_workbook


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a result table (CSV with header, or parquet)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_report(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Several result tables side by side, one folder per table; with
    ``xlsx`` as the sheets of one workbook at ``path``."""
    if fmt == "xlsx":
        write_workbook(tables, path)
        return
    for name, df in tables.items():
        write_table(df, f"{path.rstrip('/')}/{name}", fmt=fmt)


def export_model(coefs: DataFrame, path: str) -> None:
    """The chosen model's parameters and coefficients as JSON lines."""
    coefs.coalesce(1).write.mode("overwrite").json(path)
