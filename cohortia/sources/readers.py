"""Typed readers for the analysis inputs.

Every reader takes an explicit schema: no inference pass over the data, and
columns that the source writes as text (decimal commas, numbers with junk)
are parsed with non-raising casts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalar import blank_to_null, parse_decimal_comma, to_int_or_null
from .workbook import read_workbook, workbook_columns

TRANSACTIONS_RAW = ("id_customer BIGINT, date STRING, gross_sales DOUBLE, net_sales DOUBLE, "
                    "PL_gross_sales STRING, number_item_PL STRING, number_items_other STRING, "
                    "store_type STRING")


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Transactions CSV (header) to the typed table: ISO date, decimal
    comma in PL value, non-numeric item counts → NULL."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    raw = spark.read.schema(TRANSACTIONS_RAW).option("header", True).csv(path)
    return raw.select(
        "id_customer",
        F.to_date("date", "yyyy-MM-dd").alias("date"),
        "gross_sales", "net_sales",
        parse_decimal_comma("PL_gross_sales").alias("PL_gross_sales"),
        to_int_or_null("number_item_PL").alias("number_item_PL"),
        to_int_or_null("number_items_other").alias("number_items_other"),
        "store_type")


def read_weekly(spark: SparkSession, path: str, schema: StructType | str | None = None,
                date_col: str = "WEEKSTARTINGSELLOUT", fmt: str = "csv",
                sheet: str | None = None) -> DataFrame:
    """Weekly marketing table; the week text ``dd.MM.yy`` becomes a date.
    Without a schema every other column of a CSV file or workbook (``xlsx``:
    ``sheet``, or the first one) is read as a number (null where it is none)."""
    if fmt == "xlsx":
        if schema is None:
            schema = StructType([StructField(c, StringType()) for c in workbook_columns(spark, path, sheet)])
            return _weekly(read_workbook(spark, path, schema, sheet), date_col, True)
        return _weekly(read_workbook(spark, path, schema, sheet), date_col, False)
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path) if fmt == "parquet" else reader.csv(path)
    return _weekly(df, date_col, schema is None and fmt == "csv")


def _weekly(df: DataFrame, date_col: str, untyped: bool) -> DataFrame:
    if date_col in df.columns and dict(df.dtypes)[date_col] == "string":
        df = df.withColumn(date_col, F.to_date(date_col, "dd.MM.yy"))
    if untyped:
        df = df.select(*[F.col(c) if c == date_col else F.col(c).try_cast("double").alias(c)
                         for c in df.columns])
    return df


def read_table(spark: SparkSession, path: str, schema: StructType | str,
               blanks_to_null: bool = True) -> DataFrame:
    """S3: any other CSV input (survey, students, segments) with a schema."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return blank_to_null(df) if blanks_to_null else df


def holidays(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A user-supplied holiday calendar (ds, holiday, country)."""
    return (spark.createDataFrame(rows, "ds string, holiday string, country string")
            .withColumn("ds", F.to_date("ds")))
