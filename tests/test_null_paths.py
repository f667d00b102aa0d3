"""NULL / blank / zero paths that the test tables do not contain."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortia.functions import scalar as sc
from cohortia.operators import customer as cu
from cohortia.operators import churn as ch
from cohortia.operators import quality as qa

D = dt.date


@pytest.fixture()
def tx(spark):
    rows = [
        (1, D(2020, 1, 1), 100.0, 90.0, 10.0, 1, 2, "A"),
        (1, D(2020, 1, 1), 50.0, 50.0, 0.0, None, 1, "B"),      # same day, net = gross
        (1, D(2020, 1, 11), 0.0, 0.0, 0.0, 0, 0, "B"),          # zero gross: no discount value
        (1, D(2020, 1, 31), 80.0, 60.0, 20.0, 2, None, "A"),
        (2, D(2020, 2, 1), 40.0, 30.0, 0.0, None, None, "C"),   # one purchase, all items NULL
        (3, D(2020, 1, 5), 10.0, 12.0, 13.0, 0, 3, "C"),        # net > gross, PL > net
    ]
    return spark.createDataFrame(rows, "id_customer long, date date, gross_sales double, "
                                 "net_sales double, PL_gross_sales double, number_item_PL long, "
                                 "number_items_other long, store_type string")


def test_customer_metrics_null_rules(tx):
    c = {r["id_customer"]: r for r in cu.churn_customers(tx).collect()}
    a = c[1]
    assert a["Frequency"] == 3 and a["Monetary_Value"] == 230.0
    assert a["AVG_ipt"] == 15.0                       # (31 - 1) days / (3 - 1)
    assert abs(a["STD_ipt"] - 7.0710678118654755) < 1e-12  # gaps 10, 20
    assert a["Number_item_PL"] == 3 and a["Number_item_other"] == 3
    assert a["Store_Type_Variety"] == "A"             # tie A/B → lowest
    # discount: 0.1, 0.0, (0/0 skipped), 0.25 → mean of three
    assert abs(a["AVG_Discount"] - (0.1 + 0.0 + 0.25) / 3) < 1e-12
    b = c[2]
    assert b["STD_ipt"] is None and b["AVG_ipt"] is None and b["STD_Ticket"] is None
    assert b["Number_item_PL"] == 0 and b["Number_item_other"] == 0   # sums of nothing are 0
    assert b["PL_ratio"] is None and b["Purchased_Other_Only"] is False
    assert c[3]["Purchased_Other_Only"] is True


def test_anomaly_report_counts_nulls(tx):
    rep = {r["Anomaly"]: r["Count"] for r in qa.anomaly_report(tx).collect()}
    assert rep["If number_item_PL is NA, PL_gross_sales different from 0"] == 0
    assert rep["net_sales > gross_sales"] == 1
    assert rep["PL_gross_sales > net_sales"] == 1
    assert rep["Both number_item_PL and number_items_other are equal to 0"] == 1


def test_strict_anomaly_filter_drops_equal_rows(tx):
    kept = cu.drop_sales_anomaly(tx).collect()
    assert len(kept) == 3                     # equal, zero and net > gross rows go


def test_period_bounds_fallbacks(spark, tx):
    flags = ch.churn_flags(tx, 31).orderBy("id_customer", "Period_ID").collect()
    for r in flags:
        assert r["CI_Lower"] is not None and r["CI_Upper"] is not None
    first = flags[0]                           # customer 1, period 0: 4 rows, 3 dates
    assert first["Purchases"] == 4
    assert first["AVG_ipt"] == pytest.approx(10.0)          # span 30 days / (rows - 1)
    assert first["STD_ipt"] == pytest.approx(7.0710678118654755)
    assert first["Predicted_Monetary_Value"] == pytest.approx(first["AVG_Ticket"] * 3.1)
    single = [r for r in flags if r["id_customer"] == 2][0]  # one purchase → 0.8 T / 1.2 T
    assert single["CI_Lower"] == pytest.approx(single["AVG_Ticket"] * 0.8)
    assert single["CI_Upper"] == pytest.approx(single["AVG_Ticket"] * 1.2)


def test_text_parsing(spark):
    df = spark.createDataFrame([("12,5", "7"), ("abc", "x1"), (None, " 3 "), ("", "4.0")],
                               "a string, b string")
    got = df.select(sc.parse_decimal_comma("a").alias("a"), sc.to_int_or_null("b").alias("b")).collect()
    assert [r["a"] for r in got] == [12.5, None, None, None]
    assert [r["b"] for r in got] == [7, None, 3, 4]


def test_blank_to_null_and_mode_impute(spark):
    df = spark.createDataFrame([("a", ""), ("b", "x"), ("", "y"), ("b", "x")], "p string, q string")
    clean = sc.blank_to_null(df)
    assert clean.where(F.col("p").isNull()).count() == 1
    imp = qa.mode_impute(clean, ["p", "q"]).collect()
    assert [r["p"] for r in imp].count("b") == 3 and [r["q"] for r in imp].count("x") == 3


def test_minmax_constant_column_is_50(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    out = sc.minmax_scale_0_100(df, ["a", "b"]).collect()
    assert [r["a_index"] for r in out] == [0.0, 100.0] and [r["b_index"] for r in out] == [50.0, 50.0]
