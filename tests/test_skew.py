"""A hot customer holding a third of all rows: results must stay whole and exact."""
import datetime as dt

import numpy as np
import pandas as pd

from cohortia.functions import stats as st
from cohortia.operators import churn as ch
from cohortia.operators import customer as cu


def test_hot_customer_metrics_match_pandas(spark):
    rng = np.random.default_rng(9)
    n = 9000
    ids = np.where(np.arange(n) < n // 3, 1, rng.integers(2, 300, n))
    days = rng.integers(0, 400, n)
    gross = np.round(rng.uniform(1, 100, n), 2)
    base = dt.date(2021, 1, 1)
    pdf = pd.DataFrame({"id_customer": ids.astype("int64"),
                        "date": [base + dt.timedelta(days=int(d)) for d in days],
                        "gross_sales": gross, "net_sales": gross * 0.9,
                        "PL_gross_sales": 0.0, "number_item_PL": 1, "number_items_other": 2,
                        "store_type": np.where(days % 2 == 0, "A", "B")})
    df = spark.createDataFrame(pdf).repartition(16)
    got = cu.rfm_customers(df).toPandas().set_index("id_customer")
    hot = pdf[pdf.id_customer == 1]
    d = np.sort(hot.date.unique())
    gaps = np.diff(d).astype("timedelta64[D]").astype(float)
    r = got.loc[1]
    assert r["Frequency"] == len(d)
    assert abs(r["Monetary_Value"] - hot.gross_sales.sum()) < 1e-6
    assert abs(r["STD_ipt"] - np.std(gaps, ddof=1)) < 1e-9
    assert r["Recency"] == (pdf.date.max() - hot.date.max()).days
    assert len(got) == pdf.id_customer.nunique()
    flags = ch.churn_flags(df, 31).toPandas()
    hot_periods = flags[flags.id_customer == 1]
    first = pdf.date.min()
    want = hot.assign(p=[(x - first).days // 31 for x in hot.date]).groupby("p").gross_sales.sum()
    assert np.allclose(hot_periods.sort_values("Period_ID").Monetary_Value.to_numpy(), want.to_numpy())


def test_gap_statistics_walk_the_dates_once(spark):
    """Many dates a customer: one aggregate over them and none inside another."""
    base, rng = dt.date(2015, 1, 1), np.random.default_rng(4)
    days = {c: np.sort(rng.choice(3000, 1500, replace=False)) for c in range(1, 4)}
    days |= {4: np.arange(0, 3000, 3), 5: np.array([0, 7]), 6: np.array([5])}
    tx = spark.createDataFrame([(c, base + dt.timedelta(days=int(d)), 10.0, 9.0, 0.0, 1, 2, "A")
                                for c, v in days.items() for d in v],
                               "id_customer long, date date, gross_sales double, net_sales double, "
                               "PL_gross_sales double, number_item_PL long, number_items_other long, store_type string")
    one_period = cu.period_metrics(tx, 3000)
    for got, col in ((cu.rfm_customers(tx), "STD_ipt"), (cu.churn_customers(tx), "Regularity"), (one_period, "STD_ipt")):
        plan = got.select(col)._jdf.queryExecution().optimizedPlan().toString()
        top = plan.split("InMemoryRelation")[0]
        assert top.count("aggregate(") == 1 and "transform(" not in top
        sd = {r[0]: r[1] for r in got.select("id_customer", col).collect()}
        for c, v in days.items():
            gaps = np.diff(v).astype(float)
            assert sd[c] is None if len(gaps) < 2 else abs(sd[c] - np.std(gaps, ddof=1)) < 1e-12
        assert sd[4] == 0.0


def test_quantiles_of_repeating_values(spark):
    df = spark.range(20000).selectExpr("cast(id * 7 % 1000 as double) as x")
    want = np.quantile(np.arange(20000) * 7 % 1000, [0.1, 0.5, 0.9])
    assert np.allclose(st.quantiles(df, "x", [0.1, 0.5, 0.9]), want, rtol=0, atol=1e-9)



def test_qq_points_with_hot_value(spark):
    from cohortia.operators import quality as qa
    vals = [7.0] * 3000 + [float(v) for v in range(6000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = qa.qq_points(df, "x").orderBy("i").toPandas()
    assert out["i"].tolist() == list(range(1, len(vals) + 1))
    assert (np.diff(out["sample"].to_numpy()) >= 0).all()
    assert (np.diff(out["theoretical"].to_numpy()) > 0).all()
