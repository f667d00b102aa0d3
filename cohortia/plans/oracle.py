"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark code, in plain SQL over the raw test
tables; shared pieces are CTE text blocks. Doubles are rounded to the same
places as the Spark side.
"""

from __future__ import annotations

import re

from .compare import BIAS, digits_for
from ..sources.fixtures import CHANNELS, FIXTURE_SQL, EDUCATION, DISTANCE, TEACHER_QUALITY, LEVELS_LMH

ORACLES: dict[str, str] = {}

# Fixed values, written here a second time so that a wrong rule in the
# operators shows as a difference.
SEGMENT_OF = [
    ("Champions", "'HHH', 'HMH', 'HHM'"), ("Loyal", "'MHH', 'MHM'"),
    ("Cannot Lose", "'LMH', 'LHH', 'LHM'"), ("Potential Loyalist", "'HMM', 'HML', 'HLM', 'HHL'"),
    ("As New", "'HLL', 'HLH', 'MHL'"), ("To Reactivate", "'MLH', 'MLM'"),
    ("Searching for Attention", "'MMM', 'MML'"), ("About to Sleep", "'LLM', 'LMM', 'LLH'"),
    ("Bad", "'MLL', 'LML', 'LLL'"),
]
ANOMALIES = [
    ("Negative values in net_sales", "net_sales < 0"),
    ("Negative values in gross_sales", "gross_sales < 0"),
    ("Negative values in PL_gross_sales", "PL_gross_sales < 0"),
    ("If number_item_PL is NA, PL_gross_sales different from 0",
     "PL_gross_sales <> 0 AND number_item_PL IS NULL"),
    ("PL_gross_sales > net_sales", "net_sales < PL_gross_sales"),
    ("PL_gross_sales > gross_sales", "gross_sales < PL_gross_sales"),
    ("net_sales > gross_sales", "gross_sales < net_sales"),
    ("Both number_item_PL and number_items_other are equal to 0",
     "number_items_other = 0 AND number_item_PL = 0"),
]


def rx(expr: str, alias: str = "") -> str:
    """``expr`` rounded to significant digits (same arithmetic as Spark)."""
    d = digits_for(alias)
    k = f"(floor(log10(CASE WHEN abs(@) = 0 THEN 1.0 ELSE abs(@) END)) - {d - 1})"
    body = (f"CASE WHEN @ IS NULL OR @ = 0 OR isnan(@) THEN @ WHEN {k} < 0 "
            f"THEN round(@ * pow(10.0, -{k}), 0) / pow(10.0, -{k}) "
            f"ELSE round(@ / pow(10.0, {k}), 0) * pow(10.0, {k}) END")
    return "(" + body.replace("@", f"(CAST({expr} AS DOUBLE) * {1.0 + BIAS!r})") + ")"


def r(expr: str, alias: str) -> str:
    return f"{rx(expr, alias)} AS {alias}"


def customers_cte(src: str, name: str = "cust", extended: bool = False) -> str:
    """Per-customer metrics of table ``src`` as CTEs ending in ``name``."""
    ext_aggs = ""
    ext_cols = ""
    ext_ctes = ""
    ext_join = ""
    if extended:
        ext_aggs = """,
    avg(number_items_other) AS AVG_item_other_per_transaction,
    avg(number_item_PL) AS AVG_item_PL_per_transaction,
    avg(1 - CASE WHEN gross_sales <> 0 THEN net_sales / gross_sales END) AS AVG_Discount"""
        ext_ctes = f""",
{name}_st AS (SELECT id_customer, store_type, count(*) AS k FROM {src} GROUP BY 1, 2),
{name}_mode AS (SELECT id_customer, store_type AS Store_Type_Variety FROM (
    SELECT id_customer, store_type,
           row_number() OVER (PARTITION BY id_customer ORDER BY k DESC, store_type) AS rn
    FROM {name}_st) WHERE rn = 1),
{name}_pm AS (SELECT s.id_customer, count(DISTINCT CAST(floor((s.date - f.fp) / 30) AS BIGINT)) AS Purchase_Months
    FROM {src} s JOIN (SELECT id_customer, min(date) AS fp FROM {src} GROUP BY 1) f USING (id_customer)
    GROUP BY 1)"""
        ext_cols = """,
    a.AVG_item_other_per_transaction, a.AVG_item_PL_per_transaction,
    CASE WHEN a.AVG_item_PL_per_transaction + a.AVG_item_other_per_transaction > 0
         THEN a.AVG_item_PL_per_transaction / (a.AVG_item_PL_per_transaction + a.AVG_item_other_per_transaction)
    END AS PL_ratio,
    m.Store_Type_Variety, a.AVG_Discount, pm.Purchase_Months, g.STD_ipt AS Regularity,
    (a.Number_item_PL = 0 AND a.Number_item_other > 0) AS Purchased_Other_Only"""
        ext_join = f" JOIN {name}_mode m USING (id_customer) JOIN {name}_pm pm USING (id_customer)"
    return f"""
{name}_ref AS (SELECT max(date) AS max_date FROM {src}),
{name}_dd AS (SELECT DISTINCT id_customer, date FROM {src}),
{name}_gp AS (SELECT id_customer,
    CAST(date - lag(date) OVER (PARTITION BY id_customer ORDER BY date) AS DOUBLE) AS g FROM {name}_dd),
{name}_gs AS (SELECT id_customer, stddev_samp(g) AS STD_ipt FROM {name}_gp GROUP BY 1),
{name}_agg AS (SELECT id_customer, sum(gross_sales) AS Monetary_Value,
    count(DISTINCT date) AS Frequency, max(date) AS Last_Purchase, min(date) AS First_Purchase,
    avg(gross_sales) AS AVG_Ticket, stddev_samp(gross_sales) AS STD_Ticket,
    CAST(coalesce(sum(number_items_other), 0) AS BIGINT) AS Number_item_other,
    CAST(coalesce(sum(number_item_PL), 0) AS BIGINT) AS Number_item_PL{ext_aggs}
    FROM {src} GROUP BY 1){ext_ctes},
{name} AS (SELECT a.id_customer, a.Monetary_Value, a.Frequency,
    CAST(r.max_date - a.Last_Purchase AS INTEGER) AS Recency,
    a.First_Purchase, a.Last_Purchase,
    CASE WHEN a.Frequency > 1 THEN (a.Last_Purchase - a.First_Purchase) / (a.Frequency - 1) END AS AVG_ipt,
    g.STD_ipt, a.AVG_Ticket, a.STD_Ticket, a.Number_item_other, a.Number_item_PL{ext_cols}
    FROM {name}_agg a CROSS JOIN {name}_ref r JOIN {name}_gs g USING (id_customer){ext_join})"""


def rfm_ctes() -> str:
    """tx → clean → cust → kept (recency filter) → sup / reg → lab (labels, segment, scores)."""
    seg_case = "CASE " + " ".join(
        f"WHEN triple IN ({triples}) THEN '{segment}'"
        for segment, triples in SEGMENT_OF) + " ELSE 'Unclassified' END"
    return f"""WITH tx AS ({FIXTURE_SQL['tx']}),
clean AS (SELECT * FROM tx WHERE net_sales < gross_sales),{customers_cte('clean')},
rq AS (SELECT quantile_cont(CAST(Recency AS DOUBLE), 0.25) AS q25,
              quantile_cont(CAST(Recency AS DOUBLE), 0.8) AS q80 FROM cust),
kept AS (SELECT c.* FROM cust c, rq WHERE c.Recency <= rq.q80 + 2.0 * (rq.q80 - rq.q25)),
fq AS (SELECT quantile_cont(CAST(Frequency AS DOUBLE), 0.25) AS f25,
              quantile_cont(CAST(Frequency AS DOUBLE), 0.75) AS f75,
              quantile_cont(Monetary_Value, 0.25) AS m25,
              quantile_cont(Monetary_Value, 0.75) AS m75 FROM kept),
bounds AS (SELECT f75 + 1.5 * (f75 - f25) AS fb, m75 + 1.5 * (m75 - m25) AS mb FROM fq),
sup AS (SELECT k.*, CASE WHEN k.Frequency > b.fb THEN 'frequency' ELSE 'monetary' END AS anomaly
        FROM kept k, bounds b WHERE k.Frequency > b.fb OR k.Monetary_Value > b.mb),
reg AS (SELECT k.* FROM kept k, bounds b WHERE k.Frequency <= b.fb AND k.Monetary_Value <= b.mb),
lq AS (SELECT quantile_cont(Monetary_Value, 0.2) AS m1, quantile_cont(Monetary_Value, 0.5) AS m2,
              quantile_cont(CAST(Frequency AS DOUBLE), 0.2) AS f1,
              quantile_cont(CAST(Frequency AS DOUBLE), 0.5) AS f2,
              quantile_cont(CAST(Recency AS DOUBLE), 0.2) AS r1,
              quantile_cont(CAST(Recency AS DOUBLE), 0.5) AS r2 FROM reg),
lab0 AS (SELECT g.*,
    CASE WHEN Recency <= r1 THEN 'H' WHEN Recency <= r2 THEN 'M' ELSE 'L' END AS Recency_Label,
    CASE WHEN Frequency <= f1 THEN 'L' WHEN Frequency <= f2 THEN 'M' ELSE 'H' END AS Frequency_Label,
    CASE WHEN Monetary_Value <= m1 THEN 'L' WHEN Monetary_Value <= m2 THEN 'M' ELSE 'H' END AS Monetary_Label
    FROM reg g, lq),
lab AS (SELECT *, {seg_case.replace('triple', "(Recency_Label || Frequency_Label || Monetary_Label)")} AS Customer_Segment,
    CASE Recency_Label WHEN 'H' THEN 3 WHEN 'M' THEN 2 ELSE 1 END AS Recency_Score,
    CASE Frequency_Label WHEN 'H' THEN 3 WHEN 'M' THEN 2 ELSE 1 END AS Frequency_Score,
    CASE Monetary_Label WHEN 'H' THEN 3 WHEN 'M' THEN 2 ELSE 1 END AS Monetary_Score
    FROM lab0)"""


CUST_COLS = ["id_customer", "Monetary_Value", "Frequency", "Recency", "First_Purchase",
             "Last_Purchase", "AVG_ipt", "STD_ipt", "AVG_Ticket", "STD_Ticket",
             "Number_item_other", "Number_item_PL"]
CUST_DOUBLES = {"Monetary_Value", "AVG_ipt", "STD_ipt", "AVG_Ticket", "STD_Ticket",
                "AVG_item_other_per_transaction", "AVG_item_PL_per_transaction", "PL_ratio",
                "AVG_Discount", "Regularity"}
EXT_COLS = ["AVG_item_other_per_transaction", "AVG_item_PL_per_transaction", "PL_ratio",
            "Store_Type_Variety", "AVG_Discount", "Purchase_Months", "Regularity",
            "Purchased_Other_Only"]


def sel(cols, doubles) -> str:
    return ", ".join(r(c, c) if c in doubles else c for c in cols)


TX_COLS = ["id_customer", "date", "gross_sales", "net_sales", "PL_gross_sales",
           "number_item_PL", "number_items_other", "store_type"]
TX_DOUBLES = {"gross_sales", "net_sales", "PL_gross_sales"}

ORACLES["rfm_segment_share"] = rfm_ctes() + f"""
SELECT Customer_Segment AS Customer_Type, count(*) AS Frequency,
       round_even(count(*) / sum(count(*)) OVER () * 100, 2) AS Percentage
FROM lab GROUP BY 1"""

ORACLES["rfm_customers"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}),
clean AS (SELECT * FROM tx WHERE net_sales < gross_sales),{customers_cte('clean')}
SELECT {sel(CUST_COLS, CUST_DOUBLES)} FROM cust"""

ORACLES["churn_customers"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}),{customers_cte('tx', extended=True)}
SELECT {sel(CUST_COLS + EXT_COLS, CUST_DOUBLES)} FROM cust"""

ORACLES["churn_customers_dense"] = f"""WITH tx AS ({FIXTURE_SQL['dense']}),{customers_cte('tx', extended=True)}
SELECT {sel(CUST_COLS + EXT_COLS, CUST_DOUBLES)} FROM cust"""

ORACLES["purchase_gaps"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}),
dd AS (SELECT DISTINCT id_customer, date FROM tx)
SELECT id_customer, date,
       CAST(date - lag(date) OVER (PARTITION BY id_customer ORDER BY date) AS INTEGER) AS gap_days
FROM dd"""


def period_sql(src_sql: str, days: int) -> str:
    return f"""WITH tx AS ({src_sql}),
mn AS (SELECT min(date) AS min_date FROM tx),
p AS (SELECT t.*, CAST(floor((t.date - mn.min_date) / {days}) AS INTEGER) AS Period_ID FROM tx t, mn),
dd AS (SELECT DISTINCT id_customer, Period_ID, date FROM p),
gp AS (SELECT id_customer, Period_ID,
    CAST(date - lag(date) OVER (PARTITION BY id_customer, Period_ID ORDER BY date) AS DOUBLE) AS g FROM dd),
gs AS (SELECT id_customer, Period_ID, stddev_samp(g) AS STD_ipt FROM gp GROUP BY 1, 2),
ag AS (SELECT id_customer, Period_ID, sum(gross_sales) AS Monetary_Value, count(*) AS Purchases,
    CASE WHEN count(*) > 1 THEN (max(date) - min(date)) / (count(*) - 1) END AS AVG_ipt,
    avg(gross_sales) AS AVG_Ticket, stddev_samp(gross_sales) AS STD_Ticket
    FROM p GROUP BY 1, 2),
pm AS (SELECT ag.id_customer, ag.Period_ID, ag.Monetary_Value, ag.Purchases, ag.AVG_ipt,
    gs.STD_ipt, ag.AVG_Ticket, ag.STD_Ticket FROM ag JOIN gs USING (id_customer, Period_ID))"""


PM_COLS = ["id_customer", "Period_ID", "Monetary_Value", "Purchases", "AVG_ipt", "STD_ipt",
           "AVG_Ticket", "STD_Ticket"]
PM_DOUBLES = {"Monetary_Value", "AVG_ipt", "STD_ipt", "AVG_Ticket", "STD_Ticket"}

ORACLES["period_metrics"] = period_sql(FIXTURE_SQL["tx"], 31) + \
    f"\nSELECT {sel(PM_COLS, PM_DOUBLES)} FROM pm"
ORACLES["period_metrics_dense"] = period_sql(FIXTURE_SQL["dense"], 5) + \
    f"\nSELECT {sel(PM_COLS, PM_DOUBLES)} FROM pm"

ORACLES["tx_per_month"] = f"""WITH tx AS ({FIXTURE_SQL['tx']})
SELECT strftime(date, '%Y-%m') AS Month, count(*) AS Transactions FROM tx GROUP BY 1"""

ORACLES["dataset_bounds"] = f"""WITH tx AS ({FIXTURE_SQL['tx']})
SELECT max(date) AS max_date, min(date) AS min_date FROM tx"""

ORACLES["clean_transactions"] = f"""WITH tx AS ({FIXTURE_SQL['tx']})
SELECT {sel(TX_COLS, TX_DOUBLES)} FROM tx WHERE net_sales < gross_sales"""

ORACLES["sales_anomaly_rows"] = f"""WITH tx AS ({FIXTURE_SQL['dense']})
SELECT {sel(TX_COLS, TX_DOUBLES)} FROM tx WHERE net_sales > gross_sales"""

ORACLES["anomaly_report"] = f"WITH tx AS ({FIXTURE_SQL['tx']}), n AS (SELECT count(*) AS n FROM tx)\n" + \
    "\nUNION ALL\n".join(
        f"SELECT '{label}' AS Anomaly, count_if({pred}) AS Count, "
        f"{rx(f'count_if({pred}) / max(n.n) * 100', 'Percentage')} AS Percentage FROM tx, n"
        for label, pred in ANOMALIES)

_CLEAN_CUST = f"""WITH tx AS ({FIXTURE_SQL['tx']}),
clean AS (SELECT * FROM tx WHERE net_sales < gross_sales),{customers_cte('clean')}"""

ORACLES["recency_outlier_sweep"] = _CLEAN_CUST + f""",
q AS (SELECT quantile_cont(CAST(Recency AS DOUBLE), 0.25) AS q25,
             quantile_cont(CAST(Recency AS DOUBLE), 0.8) AS q80, count(*) AS n FROM cust),
m AS (SELECT CAST(unnest([1.0, 1.5, 2.0, 2.5, 3.0]) AS DOUBLE) AS Multiplier)
SELECT m.Multiplier, count_if(c.Recency > q.q80 + m.Multiplier * (q.q80 - q.q25)) AS Outliers_Count,
       {rx('count_if(c.Recency > q.q80 + m.Multiplier * (q.q80 - q.q25)) / max(q.n) * 100', 'Outlier_Percentage')} AS Outlier_Percentage
FROM m CROSS JOIN q CROSS JOIN cust c GROUP BY m.Multiplier"""

_PCTS = [k / 100 for k in range(70, 100)]
ORACLES["percentile_sweep"] = rfm_ctes() + "\n" + "\nUNION ALL\n".join(
    f"SELECT CAST({p!r} AS DOUBLE) AS Percentile, "
    f"(SELECT count(*) FROM kept WHERE Frequency > (SELECT quantile_cont(CAST(Frequency AS DOUBLE), {p!r}) FROM kept)) AS Freq_Outliers, "
    f"(SELECT count(*) FROM kept WHERE Monetary_Value > (SELECT quantile_cont(Monetary_Value, {p!r}) FROM kept)) AS Monetary_Outliers"
    for p in _PCTS)

ORACLES["two_bound_sweep"] = rfm_ctes() + f""",
m AS (SELECT CAST(unnest([1.0, 1.5, 2.0, 2.5, 3.0]) AS DOUBLE) AS Multiplier),
b AS (SELECT m.Multiplier, f75 + m.Multiplier * (f75 - f25) AS fb, m75 + m.Multiplier * (m75 - m25) AS mb
      FROM m, fq)
SELECT b.Multiplier, {rx('b.fb', 'Freq_Upper_Bound')} AS Freq_Upper_Bound, {rx('b.mb', 'Monetary_Upper_Bound')} AS Monetary_Upper_Bound,
       count_if(k.Frequency > b.fb) AS Freq_Outliers, count_if(k.Monetary_Value > b.mb) AS Monetary_Outliers
FROM b CROSS JOIN kept k GROUP BY b.Multiplier, b.fb, b.mb"""

ORACLES["super_customers"] = rfm_ctes() + f"""
SELECT id_customer, Frequency, {r('Monetary_Value', 'Monetary_Value')}, Recency, anomaly FROM sup"""

ORACLES["rfm_labels"] = rfm_ctes() + """
SELECT id_customer, Recency_Label, Frequency_Label, Monetary_Label, Customer_Segment,
       Recency_Score, Frequency_Score, Monetary_Score FROM lab"""

ORACLES["trim_super"] = rfm_ctes() + f""",
sq AS (SELECT quantile_cont(Monetary_Value, 0.8) AS mq, quantile_cont(CAST(Frequency AS DOUBLE), 0.8) AS fq8 FROM sup)
SELECT id_customer, Frequency, {r('Monetary_Value', 'Monetary_Value')}, anomaly
FROM sup, sq WHERE Monetary_Value < sq.mq AND Frequency < sq.fq8"""

ORACLES["recency_quantiles"] = _CLEAN_CUST + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, CAST({p!r} AS DOUBLE) AS prob, "
    f"{rx(f'quantile_cont(CAST({c} AS DOUBLE), {p!r})', 'value')} AS value FROM cust"
    for c in ["Recency", "Frequency", "Monetary_Value"] for p in [0.2, 0.25, 0.5, 0.75, 0.8])

ORACLES["store_type_counts"] = f"""WITH tx AS ({FIXTURE_SQL['tx']})
SELECT store_type, count(*) AS count FROM tx GROUP BY 1"""

ORACLES["recency_histogram"] = _CLEAN_CUST + """
SELECT CAST(floor(Recency / 1.0) * 1.0 AS DOUBLE) AS bin_start, count(*) AS count FROM cust GROUP BY 1"""

ORACLES["money_histogram_20"] = _CLEAN_CUST + f""",
mm AS (SELECT min(Monetary_Value) AS mn, max(Monetary_Value) AS mx FROM cust),
b AS (SELECT c.Monetary_Value AS x, mm.mn, (mm.mx - mm.mn) / 20 AS w FROM cust c, mm),
bi AS (SELECT CAST(coalesce(least(floor(CASE WHEN w <> 0 THEN (x - mn) / w END), 19), 0) AS INTEGER) AS bin,
              mn, w FROM b)
SELECT bin, count(*) AS count, {rx('min(mn + bin * w)', 'bin_start')} AS bin_start FROM bi GROUP BY bin"""

ORACLES["box_stats"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}),{customers_cte('tx', extended=True)},
q AS (SELECT Store_Type_Variety, quantile_cont(Monetary_Value, 0.25) AS q1,
             quantile_cont(Monetary_Value, 0.5) AS median, quantile_cont(Monetary_Value, 0.75) AS q3
      FROM cust GROUP BY 1),
j AS (SELECT c.Store_Type_Variety, c.Monetary_Value AS x, q.q1, q.median, q.q3,
             q.q1 - 1.5 * (q.q3 - q.q1) AS lo, q.q3 + 1.5 * (q.q3 - q.q1) AS hi
      FROM cust c JOIN q USING (Store_Type_Variety))
SELECT Store_Type_Variety, {rx('min(q1)', 'q1')} AS q1, {rx('min(median)', 'median')} AS median,
       {rx('min(q3)', 'q3')} AS q3,
       {rx('min(CASE WHEN x >= lo THEN x END)', 'lower_whisker')} AS lower_whisker,
       {rx('max(CASE WHEN x <= hi THEN x END)', 'upper_whisker')} AS upper_whisker,
       count_if(x < lo OR x > hi) AS outliers, count(x) AS n
FROM j GROUP BY 1"""


def students_sql() -> str:
    tq = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TEACHER_QUALITY.items())
    edu = "[" + ", ".join(f"'{v}'" for v in EDUCATION + [""]) + "]"
    dist = "[" + ", ".join(f"'{v}'" for v in DISTANCE + [""]) + "]"
    lmh = "[" + ", ".join(f"'{v}'" for v in LEVELS_LMH) + "]"
    return f"""SELECT p_partkey AS student_id, p_retailprice AS Exam_Score,
    CAST(p_size AS DOUBLE) AS Hours_Studied, CAST(60 + p_partkey % 40 AS DOUBLE) AS Attendance,
    CAST(4 + p_partkey % 6 AS DOUBLE) AS Sleep_Hours,
    CAST(50 + (p_partkey * 7) % 50 AS DOUBLE) AS Previous_Scores,
    {lmh}[CAST(p_partkey % 3 + 1 AS INTEGER)] AS Motivation_Level,
    CASE WHEN p_partkey % 13 = 0 THEN '' ELSE (CASE p_type {tq} END) END AS Teacher_Quality,
    {edu}[CAST(p_partkey % 4 + 1 AS INTEGER)] AS Parental_Education_Level,
    {dist}[CAST((p_partkey * 3) % 7 % 4 + 1 AS INTEGER)] AS Distance_from_Home,
    CASE WHEN p_partkey % 5 = 0 THEN 'No' ELSE 'Yes' END AS Internet_Access,
    CASE WHEN p_partkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS Gender,
    p_brand AS School_Group
FROM part"""


STUDENT_COLS = ["student_id", "Exam_Score", "Hours_Studied", "Attendance", "Sleep_Hours",
                "Previous_Scores", "Motivation_Level", "Teacher_Quality",
                "Parental_Education_Level", "Distance_from_Home", "Internet_Access", "Gender",
                "School_Group"]
STUDENT_TEXT = {"Motivation_Level", "Teacher_Quality", "Parental_Education_Level",
                "Distance_from_Home", "Internet_Access", "Gender", "School_Group"}


def students_clean_sql() -> str:
    cols = ", ".join(f"NULLIF({c}, '') AS {c}" if c in STUDENT_TEXT else c for c in STUDENT_COLS)
    return f"SELECT {cols} FROM ({students_sql()})"


ORACLES["missing_counts"] = f"WITH s AS ({students_clean_sql()})\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS missing FROM s" for c in STUDENT_COLS)

_DQ = [("completeness", f"{c} is missing", f"{c} IS NULL")
       for c in ["id_customer", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]] + [
    ("validity", "negative account balance", "c_acctbal < 0"),
    ("consistency", "name does not follow pattern", "NOT regexp_full_match(c_name, 'Customer#[0-9]+')"),
    ("accuracy", "non-positive key", "id_customer <= 0")]
ORACLES["data_quality_report"] = (
    "WITH c AS (SELECT c_custkey AS id_customer, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer), "
    "n AS (SELECT count(*) AS n FROM c)\n" + "\nUNION ALL\n".join(
        f"SELECT '{d}' AS dimension, '{lab}' AS rule, count_if({pred}) AS failing, "
        f"{rx(f'count_if({pred}) / max(n.n) * 100', 'percent')} AS percent FROM c, n"
        for d, lab, pred in _DQ))

ORACLES["profit_by_demographic"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}),
pc AS (SELECT id_customer, sum(gross_sales) AS s, count(*) AS k FROM tx GROUP BY 1)
SELECT c.c_mktsegment, {rx('sum(pc.s)', 'total_sales')} AS total_sales, CAST(sum(pc.k) AS BIGINT) AS transactions,
       count(*) AS customers, {rx('sum(pc.s) / sum(pc.k)', 'avg_ticket')} AS avg_ticket
FROM pc JOIN customer c ON pc.id_customer = c.c_custkey GROUP BY 1"""

ORACLES["profile"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}),
clean AS (SELECT * FROM tx WHERE net_sales < gross_sales)
""" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, count_if({c} IS NULL) AS missing,
    count(DISTINCT {c}) AS distinct, {rx(f'avg({c})', 'mean')} AS mean, {rx(f'stddev_samp({c})', 'sd')} AS sd,
    {rx(f'CAST(min({c}) AS DOUBLE)', 'min')} AS min, {rx(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)', 'q1')} AS q1,
    {rx(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 'median')} AS median,
    {rx(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)', 'q3')} AS q3,
    {rx(f'CAST(max({c}) AS DOUBLE)', 'max')} AS max, CAST(NULL AS VARCHAR) AS mode FROM clean"""
    for c in ["gross_sales", "net_sales", "number_item_PL"])

ORACLES["top_prospects"] = _CLEAN_CUST + f"""
SELECT id_customer, {r('Monetary_Value', 'Monetary_Value')}, Frequency FROM cust
ORDER BY cust.Monetary_Value DESC, id_customer LIMIT 1000"""


# ---------------------------------------------------------------- churn
def churn_flags_sql(src_sql: str, days: int) -> str:
    return period_sql(src_sql, days) + f""",
ci AS (SELECT pm.*,
    AVG_Ticket * (CASE WHEN AVG_ipt <> 0 THEN {float(days)!r} / AVG_ipt END) AS Predicted_Monetary_Value,
    sqrt(STD_Ticket * STD_Ticket / Purchases
         + STD_ipt * STD_ipt * (CASE WHEN AVG_ipt <> 0 THEN AVG_Ticket / (AVG_ipt * AVG_ipt) END)
                             * (CASE WHEN AVG_ipt <> 0 THEN AVG_Ticket / (AVG_ipt * AVG_ipt) END)) AS Std_Error
    FROM pm),
ci2 AS (SELECT *,
    coalesce(CASE WHEN Purchases > 1 THEN Predicted_Monetary_Value - 1.96 * Std_Error END, AVG_Ticket * 0.8) AS CI_Lower,
    coalesce(CASE WHEN Purchases > 1 THEN Predicted_Monetary_Value + 1.96 * Std_Error END, AVG_Ticket * 1.2) AS CI_Upper
    FROM ci),
w1 AS (SELECT *,
    sum(CI_Lower) OVER (PARTITION BY id_customer ORDER BY Period_ID ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS Cumulative_Sum_Lower,
    sum(CI_Upper) OVER (PARTITION BY id_customer ORDER BY Period_ID ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS Cumulative_Sum_Upper,
    count(*) OVER (PARTITION BY id_customer ORDER BY Period_ID ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS Cumulative_Count
    FROM ci2),
w2 AS (SELECT *,
    lag(Cumulative_Sum_Lower / Cumulative_Count) OVER (PARTITION BY id_customer ORDER BY Period_ID) AS Rolling_CI_Lower,
    lag(Cumulative_Sum_Upper / Cumulative_Count) OVER (PARTITION BY id_customer ORDER BY Period_ID) AS Rolling_CI_Upper
    FROM w1),
w3 AS (SELECT *,
    CASE WHEN Rolling_CI_Lower IS NULL THEN CI_Lower ELSE least(CI_Lower, Rolling_CI_Lower) END AS Combined_CI_Lower,
    CASE WHEN Rolling_CI_Upper IS NULL THEN CI_Upper ELSE greatest(CI_Upper, Rolling_CI_Upper) END AS Combined_CI_Upper
    FROM w2),
w4 AS (SELECT *, CASE WHEN Monetary_Value < Combined_CI_Lower THEN 1 ELSE 0 END AS Underperforming,
    row_number() OVER (PARTITION BY id_customer ORDER BY Period_ID DESC) AS rn_desc FROM w3),
flags AS (SELECT * EXCLUDE (rn_desc),
    CASE WHEN count(*) OVER (PARTITION BY id_customer) >= 3
          AND sum(CASE WHEN rn_desc <= 3 THEN Underperforming ELSE 0 END) OVER (PARTITION BY id_customer) = 3
         THEN 1 ELSE 0 END AS Churned FROM w4)"""


FLAG_COLS = PM_COLS + ["Predicted_Monetary_Value", "Std_Error", "CI_Lower", "CI_Upper",
                       "Cumulative_Sum_Lower", "Cumulative_Sum_Upper", "Cumulative_Count",
                       "Rolling_CI_Lower", "Rolling_CI_Upper", "Combined_CI_Lower",
                       "Combined_CI_Upper", "Underperforming", "Churned"]
FLAG_DOUBLES = PM_DOUBLES | {"Predicted_Monetary_Value", "Std_Error", "CI_Lower", "CI_Upper",
                             "Cumulative_Sum_Lower", "Cumulative_Sum_Upper", "Rolling_CI_Lower",
                             "Rolling_CI_Upper", "Combined_CI_Lower", "Combined_CI_Upper"}

ORACLES["churn_flags"] = churn_flags_sql(FIXTURE_SQL["tx"], 31) + \
    f"\nSELECT {sel(FLAG_COLS, FLAG_DOUBLES)} FROM flags"
ORACLES["churn_flags_dense"] = churn_flags_sql(FIXTURE_SQL["dense"], 5) + \
    f"\nSELECT {sel(FLAG_COLS, FLAG_DOUBLES)} FROM flags"


def customer_churn_sql(src_sql: str, days: int) -> str:
    return churn_flags_sql(src_sql, days) + f""",{customers_cte('tx', extended=True)},
churned AS (SELECT DISTINCT id_customer FROM flags WHERE Churned > 0)
SELECT c.id_customer, c.Recency,
       CASE WHEN h.id_customer IS NOT NULL OR c.Recency > 31 THEN 1 ELSE 0 END AS Churn
FROM cust c LEFT JOIN churned h USING (id_customer)"""


ORACLES["customer_churn"] = customer_churn_sql(FIXTURE_SQL["tx"], 31)
ORACLES["customer_churn_dense"] = customer_churn_sql(FIXTURE_SQL["dense"], 5)
ORACLES["churned_count_dense"] = churn_flags_sql(FIXTURE_SQL["dense"], 5) + \
    "\nSELECT count(DISTINCT id_customer) AS flagged_ids FROM flags WHERE Churned > 0"
ORACLES["attach_segment"] = rfm_ctes() + f""",{customers_cte('tx', name='cc', extended=True)}
SELECT cc.id_customer, {rx('cc.Monetary_Value', 'Monetary_Value')} AS Monetary_Value,
       coalesce(lab.Customer_Segment, 'Not Clusterized') AS Final_Segment
FROM cc LEFT JOIN lab USING (id_customer)"""


# ---------------------------------------------------------------- evaluation
from ..operators.evaluate import threshold_grid  # noqa: E402

SC = f"WITH s AS ({FIXTURE_SQL['scored']})"
ORACLES["confusion_rates"] = SC + f""",
cm AS (SELECT count_if(label <> 1 AND NOT score > 0.5) AS TN, count_if(label <> 1 AND score > 0.5) AS FP,
              count_if(label = 1 AND NOT score > 0.5) AS FN, count_if(label = 1 AND score > 0.5) AS TP FROM s)
SELECT TN, FP, FN, TP, {rx('(TP + TN) / (TN + FP + FN + TP)', 'accuracy')} AS accuracy,
       {rx('coalesce(CASE WHEN TP + FN > 0 THEN TP / (TP + FN) END, 0.0)', 'sensitivity')} AS sensitivity,
       {rx('coalesce(CASE WHEN TN + FP > 0 THEN TN / (TN + FP) END, 0.0)', 'specificity')} AS specificity
FROM cm"""

_GRID = ", ".join(repr(t) for t in threshold_grid())
SWEEP = SC + f""",
g AS (SELECT CAST(unnest([{_GRID}]) AS DOUBLE) AS threshold),
c AS (SELECT g.threshold, count(*) AS n, count_if(s.label = 1) AS p,
             count_if(s.label = 1 AND s.score > g.threshold) AS tp,
             count_if(s.label <> 1 AND NOT s.score > g.threshold) AS tn
      FROM g CROSS JOIN s GROUP BY g.threshold),
sw AS (SELECT threshold, coalesce(CASE WHEN p > 0 THEN tp / p END, 0.0) AS sensitivity,
              coalesce(CASE WHEN n - p > 0 THEN tn / (n - p) END, 0.0) AS specificity,
              (tp + tn) / n AS accuracy, 1 - (tp + tn) / n AS aper FROM c)"""
ORACLES["threshold_sweep"] = SWEEP + f"""
SELECT threshold, {r('sensitivity', 'sensitivity')}, {r('specificity', 'specificity')},
       {r('accuracy', 'accuracy')}, {r('aper', 'aper')} FROM sw"""
ORACLES["best_thresholds"] = SWEEP + """
SELECT arg_min(threshold, (-accuracy, threshold)) AS best_accuracy,
       arg_min(threshold, (abs(sensitivity - specificity), threshold)) AS best_balance,
       arg_min(threshold, (aper, threshold)) AS min_error FROM sw"""
ORACLES["closest_corner"] = SWEEP + f""",
d AS (SELECT threshold, sqrt((1 - sensitivity) ^ 2 + (1 - specificity) ^ 2) AS dist FROM sw)
SELECT arg_min(threshold, (dist, threshold)) AS closest_corner, {rx('min(dist)', 'corner_distance')} AS corner_distance FROM d"""

BYSCORE = SC + """,
b AS (SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM s GROUP BY score)"""
ORACLES["roc_auc"] = BYSCORE + f""",
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM b)
SELECT {rx('sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg))', 'auc')} AS auc FROM c"""
ORACLES["roc_curve"] = BYSCORE + f""",
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM b),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pc,
             sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nc FROM b)
SELECT {rx('score', 'threshold')} AS threshold, {rx('pc / P', 'tpr')} AS tpr, {rx('nc / N', 'fpr')} AS fpr FROM c, t"""
ORACLES["log_loss"] = SC + f""",
q AS (SELECT CAST(label AS DOUBLE) AS y, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM s)
SELECT {rx('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))', 'log_loss')} AS log_loss FROM q"""
ORACLES["regression_metrics"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}),
e AS (SELECT gross_sales AS y, gross_sales - net_sales * 1.05 AS e FROM tx),
g AS (SELECT avg(e * e) AS mse, avg(abs(e)) AS mae, sum(e * e) AS sse, var_pop(y) * count(y) AS sst FROM e)
SELECT {r('mse', 'mse')}, {rx('sqrt(mse)', 'rmse')} AS rmse, {r('mae', 'mae')}, {rx('1 - sse / sst', 'r2')} AS r2 FROM g"""


def _mix_sql(x: str) -> str:
    for factor, shift in ((0x2C1B3C6D, 15), (0x297A2D39, 16)):
        x = f"(({x}) * {factor} % 2147483648)"
        x = f"xor({x}, {x} >> {shift})"
    return x


def unit_hash_sql(col: str, salt: int = 0) -> str:
    """For ids from 0 on."""
    low = _mix_sql(f"{col}::BIGINT % 2147483648")
    shift = salt * 0x1F123BB5 % 2147483648
    return _mix_sql(f"({low} + ({col}::BIGINT >> 31) + {shift}) % 2147483648") + " / 2147483648.0"


ORACLES["stratified_split"] = SC + f""",
h AS (SELECT label, {unit_hash_sql('row_id')} AS u FROM s),
c AS (SELECT label, quantile_cont(u, 0.8) AS cut FROM h GROUP BY 1)
SELECT label, CASE WHEN u <= cut THEN 'train' ELSE 'test' END AS split, count(*) AS rows
FROM h JOIN c USING (label) GROUP BY 1, 2"""
ORACLES["holdout_by_antijoin"] = SC + f"""
SELECT row_id, label, {rx('score', 'score')} AS score FROM s WHERE NOT ({unit_hash_sql('row_id', 17)} < 0.8)"""

COEFS = """
j AS (SELECT c.*, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
      JOIN region r ON n.n_regionkey = r.r_regionkey),
mu AS (SELECT avg(c_acctbal) AS mu FROM j),
coefs AS (
  SELECT 'C(c_mktsegment)[T.' || c_mktsegment || ']' AS term, (avg(c_acctbal) - max(mu.mu)) / 1000.0 AS estimate,
         (count(*) % 7) / 100.0 AS p_value FROM j, mu GROUP BY c_mktsegment
  UNION ALL
  SELECT 'C(region)[T.' || r_name || ']', (avg(c_acctbal) - max(mu.mu)) / 1000.0, (count(*) % 7) / 100.0
  FROM j, mu GROUP BY r_name
  UNION ALL SELECT 'c_nationkey', corr(CAST(c_nationkey AS DOUBLE), c_acctbal), 0.2 FROM j
  UNION ALL SELECT 'custkey_mod', corr(CAST(c_custkey % 100 AS DOUBLE), c_acctbal), 0.03 FROM j
  UNION ALL SELECT 'Intercept', avg(c_acctbal) / 1000.0, 0.0 FROM j),
t AS (SELECT CASE WHEN contains(term, 'c_mktsegment') THEN 'c_mktsegment'
                  WHEN contains(term, 'region') THEN 'region' ELSE term END AS Variable, estimate, p_value
      FROM coefs WHERE lower(term) NOT IN ('intercept', '(intercept)')),
g AS (SELECT Variable, min(p_value) AS mp, sum(abs(estimate)) AS Importance FROM t GROUP BY 1),
lr AS (SELECT Variable, Importance,
              CASE WHEN mp <= 0.001 THEN 1 WHEN mp <= 0.01 THEN 2 WHEN mp <= 0.05 THEN 3 ELSE 4 END AS PValueRank
       FROM g),
lrr AS (SELECT *, row_number() OVER (ORDER BY PValueRank, Importance DESC, Variable) AS Rank FROM lr)"""
ORACLES["rank_logit"] = "WITH " + COEFS + f"""
SELECT Variable, {r('Importance', 'Importance')}, PValueRank, Rank, 'Logistic Regression' AS Method
FROM lrr WHERE Rank <= 17"""
ORACLES["rank_models"] = "WITH " + COEFS + """,
rf AS (SELECT Variable, row_number() OVER (ORDER BY Importance DESC, Variable) AS Rank FROM lrr),
xg AS (SELECT Variable, row_number() OVER (ORDER BY -Importance DESC, Variable) AS Rank FROM lrr),
allr AS (SELECT Variable, Rank, 'Logistic Regression' AS Method FROM lrr WHERE Rank <= 17
         UNION ALL SELECT Variable, Rank, 'Random Forest' FROM rf WHERE Rank <= 17
         UNION ALL SELECT Variable, Rank, 'XGBoost' FROM xg WHERE Rank <= 2),
vs AS (SELECT DISTINCT Variable FROM allr), ms AS (SELECT DISTINCT Method FROM allr),
fullg AS (SELECT vs.Variable, ms.Method, coalesce(CAST(a.Rank AS DOUBLE), 21.0) AS Rank
         FROM vs CROSS JOIN ms LEFT JOIN allr a ON a.Variable = vs.Variable AND a.Method = ms.Method),
fr AS (SELECT Variable, avg(Rank) AS AggregateRank FROM fullg GROUP BY 1),
frr AS (SELECT *, row_number() OVER (ORDER BY AggregateRank, Variable) AS FinalRank FROM fr)
SELECT f.Variable,
       max(CASE WHEN Method = 'Logistic Regression' THEN Rank END) AS Logistic_Regression,
       max(CASE WHEN Method = 'Random Forest' THEN Rank END) AS Random_Forest,
       max(CASE WHEN Method = 'XGBoost' THEN Rank END) AS XGBoost,
       max(frr.AggregateRank) AS AggregateRank, max(frr.FinalRank) AS FinalRank
FROM fullg f JOIN frr USING (Variable) GROUP BY f.Variable"""


# ---------------------------------------------------------------- survival, baskets
def surv_sql() -> str:
    return churn_flags_sql(FIXTURE_SQL["tx"], 31) + f""",{customers_cte('tx', extended=True)},
churned AS (SELECT DISTINCT id_customer FROM flags WHERE Churned > 0),
surv AS (SELECT c.id_customer, c.Purchase_Months, c.Store_Type_Variety,
                CASE WHEN h.id_customer IS NOT NULL OR c.Recency > 31 THEN 1 ELSE 0 END AS Churn
         FROM cust c LEFT JOIN churned h USING (id_customer))"""


def km_sql(by: str | None) -> str:
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return surv_sql() + f""",
g AS (SELECT {k}Purchase_Months AS time, count(*) AS c, CAST(sum(Churn) AS BIGINT) AS n_event
      FROM surv GROUP BY ALL),
rr AS (SELECT *, CAST(sum(c) OVER ({part}ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_risk FROM g),
kk AS (SELECT *,
    sum(CASE WHEN n_event < n_risk THEN ln(1 - n_event / n_risk) ELSE 0.0 END)
        OVER ({part}ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ls,
    sum(CASE WHEN n_event < n_risk THEN 0 ELSE 1 END)
        OVER ({part}ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS z,
    sum(CASE WHEN n_event < n_risk THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0.0 END)
        OVER ({part}ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gw FROM rr),
ss AS (SELECT *, CASE WHEN z > 0 THEN 0.0 ELSE exp(ls) END AS s,
              CASE WHEN z > 0 THEN NULL ELSE sqrt(gw) END AS se FROM kk)
SELECT {k}time, n_risk, n_event, c - n_event AS n_censor, {r('s', 'survival')}, {r('se', 'std_err')},
       {rx('s * exp(-1.959963984540054 * se)', 'lower')} AS lower,
       {rx('least(1.0, s * exp(1.959963984540054 * se))', 'upper')} AS upper FROM ss"""


ORACLES["kaplan_meier"] = km_sql(None)
ORACLES["kaplan_meier_by_store"] = km_sql("Store_Type_Variety")
ORACLES["log_rank_oe"] = surv_sql() + f""",
g AS (SELECT Store_Type_Variety AS grp, Purchase_Months AS time, count(*) AS c, sum(Churn) AS d FROM surv GROUP BY 1, 2),
grid AS (SELECT a.grp, b.time, coalesce(g.c, 0) AS c, coalesce(g.d, 0) AS d
         FROM (SELECT DISTINCT grp FROM g) a CROSS JOIN (SELECT DISTINCT time FROM g) b
         LEFT JOIN g ON g.grp = a.grp AND g.time = b.time),
rk AS (SELECT *, sum(c) OVER (PARTITION BY grp ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM grid),
tt AS (SELECT time, sum(n) AS NN, sum(d) AS DD FROM rk GROUP BY time)
SELECT grp AS Store_Type_Variety, CAST(sum(d) AS BIGINT) AS observed, {rx('sum(n * DD / NN)', 'expected')} AS expected
FROM rk JOIN tt USING (time) WHERE NN > 0 GROUP BY grp"""

PAIRS = f"""WITH b AS ({FIXTURE_SQL['baskets']}),
n AS (SELECT count(DISTINCT basket_id) AS n FROM b),
i AS (SELECT item, count(*) AS c FROM b GROUP BY item),
p AS (SELECT x.item AS a, y.item AS c2, count(*) AS k FROM b x JOIN b y
      ON x.basket_id = y.basket_id AND x.item <> y.item GROUP BY 1, 2),
rules AS (SELECT p.a AS antecedent, p.c2 AS consequent, p.k / n.n AS support, p.k / ia.c AS confidence,
                 (p.k / ia.c) / (ic.c / n.n) AS lift
          FROM p JOIN i ia ON ia.item = p.a JOIN i ic ON ic.item = p.c2, n),
pr AS (SELECT * FROM rules WHERE support > 0.01 AND confidence > 0.05 AND lift > 1.0)"""
ORACLES["basket_pair_rules"] = PAIRS + f"""
SELECT antecedent, consequent, {r('support', 'support')}, {r('confidence', 'confidence')}, {r('lift', 'lift')} FROM pr"""
ORACLES["ready_baskets"] = PAIRS + f""",
top AS (SELECT *, row_number() OVER (PARTITION BY antecedent ORDER BY lift DESC, confidence DESC, consequent) AS rn FROM pr),
bd AS (SELECT least(antecedent, consequent) AS item_a, greatest(antecedent, consequent) AS item_b, lift, confidence
       FROM top WHERE rn = 1)
SELECT item_a, item_b, {rx('max(lift)', 'lift')} AS lift, {rx('max(confidence)', 'confidence')} AS confidence FROM bd GROUP BY 1, 2"""

# all rules: item sets grown level by level as bit masks (frequent ones only)
_LEVELS = 9
_level = ["""l1 AS MATERIALIZED (SELECT basket_id, bit AS mask, bit AS top FROM it),
f1 AS MATERIALIZED (SELECT mask, count(*) AS c FROM l1 GROUP BY 1 HAVING count(*) > 0.01 * (SELECT n FROM n))"""]
for _k in range(2, _LEVELS + 1):
    _level.append(f"""l{_k} AS MATERIALIZED (SELECT l.basket_id, l.mask + it.bit AS mask, it.bit AS top
  FROM l{_k - 1} l JOIN f{_k - 1} USING (mask) JOIN it ON it.basket_id = l.basket_id AND it.bit > l.top),
f{_k} AS MATERIALIZED (SELECT mask, count(*) AS c FROM l{_k} GROUP BY 1 HAVING count(*) > 0.01 * (SELECT n FROM n))""")
_RULES = f"""WITH b AS ({FIXTURE_SQL['basket_items']}),
n AS (SELECT count(DISTINCT basket_id) AS n FROM b),
bits AS (SELECT item, CAST(1 AS BIGINT) << CAST(row_number() OVER (ORDER BY item) - 1 AS INTEGER) AS bit
         FROM (SELECT DISTINCT item FROM b)),
it AS MATERIALIZED (SELECT basket_id, bit FROM b JOIN bits USING (item)),
""" + ",\n".join(_level) + """,
f AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(1, _LEVELS + 1)) + """),
rules AS MATERIALIZED (SELECT f.mask - bits.bit AS ante, bits.item AS consequent, f.c / n.n AS support, f.c / a.c AS confidence,
       (f.c / a.c) / (s.c / n.n) AS lift
  FROM f JOIN bits ON (f.mask & bits.bit) <> 0 JOIN f a ON a.mask = f.mask - bits.bit JOIN f s ON s.mask = bits.bit, n
  WHERE f.c / a.c > 0.65 AND (f.c / a.c) / (s.c / n.n) > 1.2),
named AS MATERIALIZED (SELECT string_agg(bits.item, ', ' ORDER BY bits.item) AS antecedent, consequent, support, confidence,
       lift, count(*) AS size FROM rules JOIN bits ON (ante & bits.bit) <> 0 GROUP BY ante, consequent, support, confidence, lift)"""
ORACLES["basket_rules"] = _RULES.replace("lift, count(*) AS size", "lift, count(*) AS n_antecedent") + f"""
SELECT antecedent, consequent, n_antecedent, {r('support', 'support')}, {r('confidence', 'confidence')}, {r('lift', 'lift')} FROM named"""
ORACLES["basket_bundles"] = _RULES.replace("WITH b AS", "WITH RECURSIVE b AS", 1) + """,
e AS (SELECT antecedent AS x, consequent AS y FROM named WHERE size = 1 UNION SELECT consequent, antecedent FROM named WHERE size = 1),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y)
SELECT bundle, item, count(*) OVER (PARTITION BY bundle) AS n_items FROM (SELECT x AS item, min(least(x, y)) AS bundle FROM reach GROUP BY x)"""


# ---------------------------------------------------------------- readers and sinks
ORACLES["read_back_transactions"] = f"""WITH tx AS ({FIXTURE_SQL['tx']})
SELECT id_customer, date, {r('gross_sales', 'gross_sales')}, {r('net_sales', 'net_sales')},
       {r('PL_gross_sales', 'PL_gross_sales')}, CAST(number_item_PL AS BIGINT) AS number_item_PL,
       CASE WHEN id_customer % 11 <> 0 THEN CAST(number_items_other AS BIGINT) END AS number_items_other, store_type FROM tx"""
ORACLES["read_back_report"] = """SELECT 'regions' AS name, count(*) AS rows FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'students', count(*) FROM part UNION ALL SELECT 'model', 3"""


# ---------------------------------------------------------------- descriptive, encoders
from ..functions.stats import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, ACKLAM_PLOW  # noqa: E402


def _poly(coefs, x: str) -> str:
    acc = repr(coefs[0])
    for k in coefs[1:]:
        acc = f"({acc} * {x} + {k!r})"
    return acc


def ppf_sql(p: str) -> str:
    ql = f"sqrt(-2 * ln({p}))"
    qh = f"sqrt(-2 * ln(1 - {p}))"
    q = f"({p} - 0.5)"
    rr = f"({q} * {q})"
    low = f"({_poly(ACKLAM_C, ql)} / ({_poly(ACKLAM_D, ql)} * {ql} + 1))"
    high = f"(-{_poly(ACKLAM_C, qh)} / ({_poly(ACKLAM_D, qh)} * {qh} + 1))"
    mid = f"({_poly(ACKLAM_A, rr)} * {q} / ({_poly(ACKLAM_B, rr)} * {rr} + 1))"
    return (f"CASE WHEN {p} < {ACKLAM_PLOW!r} THEN {low} WHEN {p} > {1 - ACKLAM_PLOW!r} "
            f"THEN {high} ELSE {mid} END")


SURV = surv_sql()
ORACLES["churn_crosstab"] = SURV + f""",
c AS (SELECT Store_Type_Variety, Churn, count(*) AS count FROM surv GROUP BY 1, 2)
SELECT Store_Type_Variety, Churn, count,
       {rx('count / sum(count) OVER (PARTITION BY Store_Type_Variety)', 'proportion')} AS proportion FROM c"""

_CORR = ["Frequency", "Monetary_Value", "AVG_Ticket", "STD_Ticket", "PL_ratio", "AVG_Discount",
         "Purchase_Months"]
_pairs = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i:]]
ORACLES["correlation_matrix"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}),{customers_cte('tx', extended=True)},
d AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _CORR)} FROM cust
      WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _CORR)})
""" + "\nUNION ALL\n".join(
    (f"SELECT '{a}' AS var1, '{b}' AS var2, 1.0 AS corr FROM (SELECT 1) t" if a == b else
     f"SELECT '{a}' AS var1, '{b}' AS var2, {rx(f'corr({a}, {b})', 'corr')} AS corr FROM d "
     f"UNION ALL SELECT '{b}', '{a}', {rx(f'corr({a}, {b})', 'corr')} FROM d")
    for a, b in _pairs)

ORACLES["mode_impute"] = f"WITH s AS ({students_clean_sql()}),\n" + ",\n".join(
    f"m_{c} AS (SELECT {c} AS v FROM s WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    for c in ["Teacher_Quality", "Parental_Education_Level", "Distance_from_Home"]) + """
SELECT student_id, coalesce(Teacher_Quality, (SELECT v FROM m_Teacher_Quality)) AS Teacher_Quality,
       coalesce(Parental_Education_Level, (SELECT v FROM m_Parental_Education_Level)) AS Parental_Education_Level,
       coalesce(Distance_from_Home, (SELECT v FROM m_Distance_from_Home)) AS Distance_from_Home FROM s"""

ORACLES["kde_by_churn"] = SURV + f""",
x AS (SELECT s.Churn, CAST(c.Monetary_Value AS DOUBLE) AS x FROM surv s JOIN cust c USING (id_customer)),
mm AS (SELECT min(x) AS mn, max(x) AS mx FROM x),
grid AS (SELECT mn + (mx - mn) * CAST(range AS DOUBLE) / 49 AS point FROM range(50), mm),
st AS (SELECT Churn, count(*) AS n, stddev_samp(x) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h FROM x GROUP BY 1),
kd AS (SELECT x.Churn, g.point, sum(exp(-0.5 * ((g.point - x.x) / st.h) * ((g.point - x.x) / st.h))) AS s
       FROM x JOIN st USING (Churn) CROSS JOIN grid g GROUP BY 1, 2)
SELECT kd.Churn, {rx('kd.point', 'point')} AS point,
       {rx('kd.s / (st.n * st.h * 2.5066282746310002)', 'density')} AS density
FROM kd JOIN st USING (Churn)"""

ORACLES["kde_by_churn_smooth"] = ORACLES["kde_by_churn"].replace(
    "pow(CAST(count(*) AS DOUBLE), -0.2) AS h", "pow(CAST(count(*) AS DOUBLE), -0.2) * 1.5 AS h")

ORACLES["qq_points"] = _CLEAN_CUST + f""",
q AS (SELECT row_number() OVER (ORDER BY AVG_Ticket) AS i, AVG_Ticket AS sample, count(*) OVER () AS n
      FROM cust WHERE AVG_Ticket IS NOT NULL)
SELECT i, {rx('sample', 'sample')} AS sample, {rx(ppf_sql('((i - 0.5) / n)'), 'theoretical')} AS theoretical FROM q"""

_I4 = ["D12_1", "D12_2", "D12_3", "D12_4"]
ORACLES["minmax_index"] = f"WITH s AS ({FIXTURE_SQL['survey_items']}),\nmm AS (SELECT " + ", ".join(
    f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _I4) + " FROM s)\nSELECT respondent, " + ", ".join(
    f"{rx(f'CASE WHEN mx_{c} = mn_{c} THEN 50.0 ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) * 100.0 END', c + '_index')} AS {c}_index"
    for c in _I4) + " FROM s, mm"
ORACLES["zscore_items"] = f"WITH s AS ({FIXTURE_SQL['survey_items']}),\nmm AS (SELECT " + ", ".join(
    f"avg({c}) AS mu_{c}, stddev_samp({c}) AS sd_{c}" for c in _I4) + " FROM s)\nSELECT respondent, " + ", ".join(
    f"{rx(f'({c} - mu_{c}) / sd_{c}', c + '_z')} AS {c}_z" for c in _I4) + " FROM s, mm"

ORACLES["encode_students"] = f"""WITH s AS ({students_clean_sql()}),
ed AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT Parental_Education_Level AS v FROM s WHERE Parental_Education_Level IS NOT NULL))
SELECT student_id,
  CAST(CASE Motivation_Level WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END AS INTEGER) AS Motivation_Code,
  CAST(CASE Teacher_Quality WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END AS INTEGER) AS Teacher_Code,
  CAST(CASE Distance_from_Home WHEN 'Near' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Far' THEN 3 END AS INTEGER) AS Distance_Code,
  CASE WHEN Internet_Access IS NULL THEN NULL WHEN Internet_Access = 'Yes' THEN 1 ELSE 0 END AS Internet_Yes,
  CASE WHEN Gender IS NULL THEN NULL WHEN Gender = 'Male' THEN 1 ELSE 0 END AS Gender_Male,
  CASE WHEN Motivation_Level IS NULL THEN NULL WHEN Motivation_Level = 'Low' THEN 1 ELSE 0 END AS Motivation_Level_Low,
  CASE WHEN Motivation_Level IS NULL THEN NULL WHEN Motivation_Level = 'Medium' THEN 1 ELSE 0 END AS Motivation_Level_Medium,
  coalesce(ed.code, (SELECT count(*) FROM ed)) AS Education_Code
FROM s LEFT JOIN ed ON s.Parental_Education_Level = ed.v"""

ORACLES["parse_text_fields"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}),
t AS (SELECT id_customer, date, CAST(round(PL_gross_sales * 100) AS BIGINT) AS cents,
             CASE WHEN number_item_PL % 11 = 0 THEN 'n/a' ELSE CAST(number_item_PL AS VARCHAR) END AS items_text FROM tx),
t2 AS (SELECT id_customer, date, CAST(cents // 100 AS VARCHAR) || ',' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS pl_text,
              items_text FROM t)
SELECT id_customer, date, pl_text, {rx("TRY_CAST(replace(pl_text, ',', '.') AS DOUBLE)", 'PL_gross_sales')} AS PL_gross_sales,
       TRY_CAST(items_text AS BIGINT) AS number_item_PL FROM t2"""


def weekly_sql() -> str:
    cols = ", ".join(
        f"coalesce(max(CASE WHEN channel = '{raw}' THEN spend END), 0.0) AS spend_{name}"
        for raw, name in CHANNELS.items())
    return f"""wl AS ({FIXTURE_SQL['weekly_long']}),
wide AS (SELECT week, {cols} FROM wl GROUP BY week),
tgt AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, sum(gross_sales) AS sales FROM tx GROUP BY 1),
weekly AS (SELECT w.*, coalesce(t.sales, 0.0) AS sales FROM wide w LEFT JOIN tgt t USING (week))"""


# two-digit years are read as 20xx
ORACLES["read_back_weekly"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}), {weekly_sql()}
SELECT CAST(CASE WHEN year(week) < 2000 THEN week + INTERVAL 100 YEAR ELSE week END AS DATE) AS week, {r('sales', 'sales')}, """ + ", ".join(
    r(f"spend_{n}", f"spend_{n}") for n in CHANNELS.values()) + " FROM weekly"
ORACLES["read_back_weekly_workbook"] = ORACLES["read_back_weekly"]
ORACLES["read_back_workbook"] = f"WITH s AS ({students_clean_sql()})\nSELECT " + ", ".join(
    c if c in STUDENT_TEXT or c == "student_id" else r(c, c) for c in STUDENT_COLS) + " FROM s"
ORACLES["inflation_adjust"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}), {weekly_sql()},
mu AS (SELECT avg(o_totalprice) AS mu FROM orders),
cpi AS (SELECT year(o_orderdate) AS year, avg(o_totalprice) / max(mu.mu) * 100 AS cpi FROM orders, mu GROUP BY 1),
base AS (SELECT cpi AS b FROM cpi WHERE year = 1998)
SELECT w.week, {rx('w.sales', 'sales')} AS sales,
       {rx('w.sales * (CASE WHEN base.b <> 0 THEN c.cpi / base.b END)', 'sales_adj')} AS sales_adj
FROM weekly w LEFT JOIN cpi c ON year(w.week) = c.year CROSS JOIN base"""

ORACLES["window_merge_features"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}), {weekly_sql()}
SELECT week, {rx('spend_URGENT + spend_HIGH', 'spend_top')} AS spend_top,
       {rx("((week - DATE '1996-01-01') / 7) * ((week - DATE '1996-01-01') / 7)", 'trend_sq')} AS trend_sq,
       {rx('spend_URGENT * spend_LOW', 'urgent_x_low')} AS urgent_x_low
FROM weekly WHERE week BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"""

ORACLES["stratify_by_score"] = """
SELECT count(*) AS rows, """ + rx("avg(p_retailprice)", "mean_score") + """ AS mean_score, 'low' AS stratum
FROM part WHERE p_retailprice BETWEEN 900.0 AND 1399.99
UNION ALL
SELECT count(*), """ + rx("avg(p_retailprice)", "mean_score") + """, 'high' FROM part WHERE p_retailprice BETWEEN 1400.0 AND 2100.0"""

ORACLES["union_segments"] = rfm_ctes() + """
SELECT id_customer, anomaly, CAST(NULL AS VARCHAR) AS Customer_Segment FROM sup
UNION ALL SELECT id_customer, NULL, Customer_Segment FROM lab"""


# ---------------------------------------------------------------- linear models (closed forms)
ORACLES["ols_single"] = f"""WITH s AS (SELECT p_retailprice AS y, CAST(p_size AS DOUBLE) AS x FROM part)
SELECT 'Intercept' AS term, {rx('regr_intercept(y, x)', 'estimate')} AS estimate, {rx('regr_r2(y, x)', 'r2')} AS r2 FROM s
UNION ALL SELECT 'Hours_Studied', {rx('regr_slope(y, x)', 'estimate')}, {rx('regr_r2(y, x)', 'r2')} FROM s"""

_RES = """WITH s AS (SELECT p_partkey AS student_id, p_retailprice AS y, CAST(p_size AS DOUBLE) AS x FROM part),
c AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM s),
r AS (SELECT s.student_id, s.x, c.a + s.x * c.b AS fitted, s.y - (c.a + s.x * c.b) AS residual FROM s, c)"""
ORACLES["residual_table"] = _RES + f"""
SELECT student_id, {r('fitted', 'fitted')}, {r('residual', 'residual')},
       {rx('sqrt(abs(residual))', 'sqrt_abs_resid')} AS sqrt_abs_resid FROM r"""
ORACLES["breusch_pagan_single"] = _RES + f"""
SELECT {rx('count(*) * regr_r2(residual * residual, x)', 'statistic')} AS statistic, 1 AS dof FROM r"""

_SR = f"WITH s AS ({FIXTURE_SQL['survey_regression']}),\n" + """k AS (SELECT quantile_cont(CAST(AGE AS DOUBLE), 0.0) AS k1, quantile_cont(CAST(AGE AS DOUBLE), 1/3) AS k2,
             quantile_cont(CAST(AGE AS DOUBLE), 2/3) AS k3, quantile_cont(CAST(AGE AS DOUBLE), 1.0) AS k4 FROM s),
d AS (SELECT s.respondent, CAST(s.AGE AS DOUBLE) AS x,
        (pow(greatest(s.AGE - k.k1, 0.0), 3) - pow(greatest(s.AGE - k.k4, 0.0), 3)) / (k.k4 - k.k1) AS d1,
        (pow(greatest(s.AGE - k.k2, 0.0), 3) - pow(greatest(s.AGE - k.k4, 0.0), 3)) / (k.k4 - k.k2) AS d2,
        (pow(greatest(s.AGE - k.k3, 0.0), 3) - pow(greatest(s.AGE - k.k4, 0.0), 3)) / (k.k4 - k.k3) AS d3
      FROM s, k)"""
ORACLES["natural_spline_basis"] = _SR + f"""
SELECT respondent, {r('x', 'AGE_ns1')}, {rx('d1 - d3', 'AGE_ns2')} AS AGE_ns2, {rx('d2 - d3', 'AGE_ns3')} AS AGE_ns3 FROM d"""


# Least squares in SQL: sums of products about the means as a table (i, j, v),
# one sweep per column. Afterwards the X block is minus the inverse, the last
# column holds the slopes and the last cell the residual sum of squares.
def sweep_ctes(name: str, src: str, p: int) -> str:
    out, last = [f"{name}0 AS MATERIALIZED ({src})"], f"{name}0"
    for k in range(1, p + 1):
        out.append(f"""{name}{k} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN coalesce(d.v, 0) = 0 THEN a.v
       WHEN a.i = {k} AND a.j = {k} THEN -1 / d.v WHEN a.i = {k} OR a.j = {k} THEN a.v / d.v
       ELSE a.v - ri.v * rj.v / d.v END AS v
FROM {last} a LEFT JOIN {last} d ON d.i = {k} AND d.j = {k}
LEFT JOIN {last} ri ON ri.i = a.i AND ri.j = {k} LEFT JOIN {last} rj ON rj.i = {k} AND rj.j = a.j)""")
        last = f"{name}{k}"
    return ",\n".join(out)


def fit_ctes(rows: str, xs: list[str], y: str, name: str = "g") -> str:
    """CTEs over the table ``rows`` (with a ``row`` key): long values, means,
    sums of products, the swept table ``<name>s`` and one row of totals."""
    p = len(xs)
    values = ", ".join(f"CAST({e} AS DOUBLE)" for e in [*xs, y])
    return f"""{name}l AS MATERIALIZED (SELECT row, unnest(range(1, {p + 2})) AS j, unnest([{values}]) AS x FROM {rows}),
{name}m AS MATERIALIZED (SELECT j, avg(x) AS m FROM {name}l GROUP BY j),
{name}c AS MATERIALIZED (SELECT row, j, x - m AS x FROM {name}l JOIN {name}m USING (j)),
{sweep_ctes(name, f"SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS v FROM {name}c a JOIN {name}c b USING (row) GROUP BY 1, 2", p)},
{name}b AS MATERIALIZED (SELECT s.i AS j, s.v AS b, m.m FROM {name}{p} s JOIN {name}m m ON m.j = s.i WHERE s.j = {p + 1} AND s.i <= {p}),
{name}t AS MATERIALIZED (SELECT (SELECT count(*) FROM {rows}) AS n, {p + 1} AS p, s.v AS rss, z.v AS tss,
      (SELECT m FROM {name}m WHERE j = {p + 1}) AS ymean, s.v / ((SELECT count(*) FROM {rows}) - {p + 1}) AS sigma2
      FROM {name}{p} s, {name}0 z WHERE s.i = {p + 1} AND s.j = {p + 1} AND z.i = {p + 1} AND z.j = {p + 1}),
{name}inv AS MATERIALIZED (SELECT i, j, -v AS v FROM {name}{p} WHERE i <= {p} AND j <= {p}),
{name}f AS MATERIALIZED (SELECT c.row, t.ymean + sum(CASE WHEN c.j <= {p} THEN c.x * b.b ELSE 0 END) AS fitted
      FROM {name}c c LEFT JOIN {name}b b USING (j), {name}t t GROUP BY c.row, t.ymean)"""


# Simpson weights, for tail areas of the t and chi-square densities
SIMPSON = """pts AS MATERIALIZED (SELECT CAST(range AS DOUBLE) / 8000 AS step, CASE WHEN range IN (0, 8000) THEN 1
       WHEN range % 2 = 1 THEN 4 ELSE 2 END / 24000.0 AS wt FROM range(8001))"""


def t_tail(t: str, nu: str) -> str:
    """Two-sided tail area; the grid spans at least 20 decay lengths."""
    w = f"(40 * ({nu} + {t} * {t}) / (({nu} + 1) * (1 + {t})))"
    return (f"(SELECT 2 * {w} * sum(wt * exp(lgamma(({nu} + 1) / 2.0) - lgamma({nu} / 2.0) - 0.5 * ln({nu} * pi()) "
            f"- ({nu} + 1) / 2.0 * ln(1 + ({t} + {w} * step) * ({t} + {w} * step) / {nu}))) FROM pts)")


def chi2_tail(x: str, k: str) -> str:
    return (f"(SELECT 120 * sum(wt * exp(({k} / 2.0 - 1) * ln({x} + 120 * step) - ({x} + 120 * step) / 2 "
            f"- {k} / 2.0 * ln(2.0) - lgamma({k} / 2.0))) FROM pts)")


def t_critical(nu: str) -> str:
    """97.5 % point of the t distribution from the normal one (expansion)."""
    z = 1.959963984540054
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
         (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return "(" + " + ".join([repr(z), *[f"{c!r} / pow({nu}, {i + 1})" for i, c in enumerate(g)]]) + ")"


def tidy_sql(names: list[str]) -> str:
    """Coefficient table of the fit ``g``, columns named in order."""
    label = "list_extract([" + ", ".join(f"'{n}'" for n in ["Intercept", *names]) + "], c.j + 1)"
    return f""", {SIMPSON},
c AS (SELECT 0 AS j, t.ymean - (SELECT sum(b * m) FROM gb) AS est,
             sqrt(t.sigma2 * (1.0 / t.n + (SELECT sum(a.m * i.v * b.m) FROM ginv i JOIN gb a ON a.j = i.i JOIN gb b ON b.j = i.j))) AS se
      FROM gt t
      UNION ALL SELECT b.j, b.b, sqrt(t.sigma2 * i.v) FROM gb b JOIN ginv i ON i.i = b.j AND i.j = b.j, gt t),
tq AS MATERIALIZED (SELECT c.*, abs(est / se) AS t, CAST(gt.n - gt.p AS DOUBLE) AS nu FROM c, gt),
q AS MATERIALIZED (SELECT tq.*, {t_tail('tq.t', 'tq.nu')} AS p FROM tq)
SELECT {label} AS term, {r('est', 'estimate')}, {r('se', 'std_error')}, {r('est / se', 'statistic')},
       {r('p', 'p_value')}, {rx(f"est - se * {t_critical('nu')}", 'conf_low')} AS conf_low,
       {rx(f"est + se * {t_critical('nu')}", 'conf_high')} AS conf_high, 'ols' AS model FROM q c"""


def vif_sql(terms: list[str]) -> str:
    """Generalised variance inflation of terms with one or two columns:
    det(S_tt) det(inverse_tt)."""
    out = []
    for t in dict.fromkeys(terms):
        at = [i + 1 for i, x in enumerate(terms) if x == t]
        def det(table):
            def v(a, b):
                return f"(SELECT v FROM {table} WHERE i = {a} AND j = {b})"
            if len(at) == 1:
                return v(at[0], at[0])
            return f"({v(at[0], at[0])} * {v(at[1], at[1])} - {v(at[0], at[1])} * {v(at[1], at[0])})"
        out.append(f"SELECT '{t}' AS term, {det('g0')} * {det('ginv')} AS gvif, {len(at)} AS df")
    return (f",\nq AS ({' UNION ALL '.join(out)})\nSELECT term, {r('gvif', 'gvif')}, df, "
            f"{rx('pow(gvif, 1.0 / (2 * df))', 'gvif_adj')} AS gvif_adj FROM q")


_IMPUTED = ["Teacher_Quality", "Parental_Education_Level", "Distance_from_Home"]
_SX = {"Attendance": "Attendance", "Hours_Studied": "Hours_Studied", "Sleep_Hours": "Sleep_Hours",
       "Previous_Scores": "Previous_Scores"}
for _f, _lv in [("Motivation_Level", ["Low", "Medium"]), ("Internet_Access", ["Yes"]), ("Gender", ["Male"]),
                ("Teacher_Quality", ["Low", "Medium"])]:
    _SX |= {f"C({_f})[T.{v}]": f"CASE WHEN {_f} = '{v}' THEN 1 ELSE 0 END" for v in _lv}
for _v in ["Low", "Medium"]:
    _SX[f"C(Teacher_Quality)[T.{_v}]:C(Internet_Access)[T.Yes]"] = (
        f"CASE WHEN Teacher_Quality = '{_v}' AND Internet_Access = 'Yes' THEN 1 ELSE 0 END")
_SX["Hours_Studied:C(Gender)[T.Male]"] = "CASE WHEN Gender = 'Male' THEN Hours_Studied ELSE 0 END"
_ST = [re.sub(r"C\((\w+)\)\[T\.\w+\]", r"\1", n) for n in _SX]
_STUDENT_FIT = f"WITH s AS ({students_clean_sql()}),\n" + ",\n".join(
    f"m_{c} AS (SELECT {c} AS v FROM s WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    for c in _IMPUTED) + """,
filled AS MATERIALIZED (SELECT student_id AS row, s.* REPLACE (""" + ", ".join(
    f"coalesce({c}, (SELECT v FROM m_{c})) AS {c}" for c in _IMPUTED) + """) FROM s
  WHERE Motivation_Level IS NOT NULL AND Internet_Access IS NOT NULL AND Gender IS NOT NULL),
""" + fit_ctes("filled", list(_SX.values()), "ln(1 + Exam_Score)")
ORACLES["ols_tidy"] = _STUDENT_FIT + tidy_sql(list(_SX))
ORACLES["ols_performance"] = _STUDENT_FIT + f""",
q AS (SELECT *, 1 - rss / tss AS r2, -n / 2.0 * (ln(2 * pi() * rss / n) + 1) AS ll FROM gt)
SELECT 'ols' AS model, n, p AS params, {rx('sqrt(rss / n)', 'rmse')} AS rmse, {rx('sqrt(sigma2)', 'sigma')} AS sigma,
       {r('r2', 'r2')}, {rx('1 - (1 - r2) * (n - 1) / (n - p)', 'adj_r2')} AS adj_r2, {r('ll', 'loglik')} ,
       {rx('-2 * ll + 2 * (p + 1)', 'aic')} AS aic, {rx('-2 * ll + ln(n) * (p + 1)', 'bic')} AS bic FROM q"""
ORACLES["vif"] = _STUDENT_FIT + vif_sql(_ST)
ORACLES["breusch_pagan"] = _STUDENT_FIT + f""", {SIMPSON},
sq AS MATERIALIZED (SELECT filled.*, pow(ln(1 + Exam_Score) - fitted, 2) AS e2 FROM filled JOIN gf USING (row)),
{fit_ctes('sq', list(_SX.values()), 'e2', 'h')},
q AS MATERIALIZED (SELECT n * (1 - rss / tss) AS x FROM ht),
pq AS MATERIALIZED (SELECT x, {chi2_tail('q.x', str(len(_SX)))} AS p FROM q)
SELECT 'all_regressors' AS form, {r('x', 'statistic')}, {len(_SX)} AS dof, {r('p', 'p_value')} FROM pq"""
ORACLES["binned_trend"] = _STUDENT_FIT + f""",
e AS (SELECT fitted, sqrt(abs(ln(1 + Exam_Score) - fitted)) AS y FROM filled JOIN gf USING (row)),
mm AS (SELECT min(fitted) AS mn, max(fitted) AS mx FROM e)
SELECT CAST(least(floor((fitted - mn) / ((mx - mn) / 20)), 19) AS INTEGER) AS bin, {rx('avg(fitted)', 'x_mean')} AS x_mean,
       {rx('avg(y)', 'y_mean')} AS y_mean, count(*) AS n FROM e, mm GROUP BY 1"""

_items = [f"D12_{i}" for i in range(2, 21)]
ORACLES["vif_items"] = f"""WITH s AS (SELECT respondent AS row, * FROM ({FIXTURE_SQL['survey_items']})
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ['D12_1', *_items])}),
{fit_ctes('s', _items, 'D12_1')}""" + vif_sql(_items)

_PX = {"AGE_ns1": "x", "AGE_ns2": "d1 - d3", "AGE_ns3": "d2 - d3"}
for _f, _lv in [("SEX", ["1"]), ("REGION", ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]),
                ("PROFESSION", ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])]:
    _PX |= {f"C({_f})[T.{v}]": f"CASE WHEN {_f} = '{v}' THEN 1 ELSE 0 END" for v in _lv}
_SPLINE_FIT = _SR + """,
sp AS MATERIALIZED (SELECT s.respondent AS row, s.DLIT, s.SEX, s.REGION, s.PROFESSION, d.x, d.d1, d.d2, d.d3
                    FROM s JOIN d USING (respondent)),
""" + fit_ctes("sp", list(_PX.values()), "DLIT")
ORACLES["spline_tidy"] = _SPLINE_FIT + tidy_sql(list(_PX))
_dk = "(pow(greatest(AGE - k.k{0}, 0.0), 3) - pow(greatest(AGE - k.k4, 0.0), 3)) / (k.k4 - k.k{0})"
ORACLES["spline_effect"] = _SPLINE_FIT + f""",
grid AS (SELECT CAST(range AS DOUBLE) AS AGE FROM range(18, 88)),
basis AS (SELECT AGE, {_dk.format(1)} AS d1, {_dk.format(2)} AS d2, {_dk.format(3)} AS d3 FROM grid, k),
z AS MATERIALIZED (SELECT AGE, b.j, b.b, CASE b.j WHEN 1 THEN AGE WHEN 2 THEN d1 - d3 WHEN 3 THEN d2 - d3 ELSE 0 END - b.m AS x
                   FROM basis, gb b),
pr AS (SELECT AGE, sum(x * b) AS up FROM z GROUP BY 1),
ve AS (SELECT a.AGE, sum(a.x * i.v * c.x) AS v FROM z a JOIN ginv i ON i.i = a.j JOIN z c ON c.j = i.j AND c.AGE = a.AGE GROUP BY 1),
q AS (SELECT AGE, ymean + up AS pred, sqrt(sigma2 * (1.0 / n + v)) AS e, {t_critical('(n - p)')} AS tq
      FROM pr JOIN ve USING (AGE), gt)
SELECT AGE, {r('pred', 'prediction')}, {r('e', 'se')}, {rx('pred - tq * e', 'lower')} AS lower,
       {rx('pred + tq * e', 'upper')} AS upper, AGE IN (25, 50) AS is_named FROM q"""

# the log-rank variance of up to eight groups, all but the last swept
_LOGRANK = ORACLES["log_rank_oe"].rsplit("\nSELECT grp", 1)[0] + f""", {SIMPSON},
oe AS MATERIALIZED (SELECT grp, row_number() OVER (ORDER BY CAST(grp AS VARCHAR)) AS i, sum(d) AS o, sum(n * DD / NN) AS e
       FROM rk JOIN tt USING (time) WHERE NN > 0 GROUP BY grp),
pt AS MATERIALIZED (SELECT oe.i, time, n / NN AS sh, CASE WHEN NN > 1 THEN DD * (NN - DD) / (NN - 1) ELSE 0 END AS f
       FROM rk JOIN tt USING (time) JOIN oe USING (grp) WHERE NN > 0),
vv AS (SELECT a.i, b.i AS j, sum(a.f * a.sh * (CASE WHEN a.i = b.i THEN 1 ELSE 0 END - b.sh)) AS v
       FROM pt a JOIN pt b USING (time) WHERE a.i < (SELECT max(i) FROM oe) AND b.i < (SELECT max(i) FROM oe) GROUP BY 1, 2
       UNION ALL SELECT i, 99, o - e FROM oe WHERE i < (SELECT max(i) FROM oe)
       UNION ALL SELECT 99, i, o - e FROM oe WHERE i < (SELECT max(i) FROM oe) UNION ALL SELECT 99, 99, 0),
{sweep_ctes('lw', 'SELECT * FROM vv', 7)},
q AS MATERIALIZED (SELECT -v AS x, (SELECT max(i) - 1 FROM oe) AS k FROM lw7 WHERE i = 99 AND j = 99),
pq AS MATERIALIZED (SELECT x, CAST(k AS INTEGER) AS k, {chi2_tail('q.x', 'q.k')} AS p FROM q)"""
ORACLES["log_rank"] = _LOGRANK + f"""
SELECT grp AS Store_Type_Variety, CAST(o AS BIGINT) AS observed, {rx('e', 'expected')} AS expected,
       {rx('(o - e) * (o - e) / e', 'oe_term')} AS oe_term, {rx('x', 'chisq')} AS chisq, {rx('p', 'p_value')} AS p_value,
       k AS dof FROM oe, pq"""


# ---------------------------------------------------------------- clustering on given labels
ORACLES["cluster_summary_by_segment"] = rfm_ctes() + f""",
g AS (SELECT Customer_Segment, avg(Monetary_Value) AS a1, avg(AVG_Ticket) AS a2, avg(Frequency) AS a3,
             avg(Recency) AS a4, avg(AVG_ipt) AS a5, count(Monetary_Value) AS n,
             avg(Number_item_other) AS a6, avg(Number_item_PL) AS a7 FROM lab GROUP BY 1)
SELECT Customer_Segment, {r('a1', 'Avg_Monetary_Value')}, {r('a2', 'AVG_Ticket')}, {r('a3', 'Avg_Visits')},
       {r('a4', 'Avg_Recency')}, {r('a5', 'AVG_IPT')}, n AS Total_Customers,
       {r('a6', 'Avg_Number_Item_Other')}, {r('a7', 'Avg_Number_Item_PL')},
       {rx('CASE WHEN a7 + a6 <> 0 THEN a7 / (a7 + a6) END', 'PL_on_Tot')} AS PL_on_Tot FROM g"""

ORACLES["silhouette_segments"] = rfm_ctes() + f""",
pts AS (SELECT Customer_Segment AS l, Recency_Score AS x, Frequency_Score AS y, Monetary_Score AS z,
               count(*) AS w FROM lab GROUP BY 1, 2, 3, 4),
sz AS (SELECT l, sum(w) AS n FROM pts GROUP BY l),
pr AS (SELECT a.l AS la, a.x, a.y, a.z, a.w AS wa, b.l AS lb,
              sum(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2) * b.w) AS sd
       FROM pts a CROSS JOIN pts b GROUP BY 1, 2, 3, 4, 5, 6),
av AS (SELECT pr.*, sz.n, CASE WHEN la = lb THEN (CASE WHEN sz.n - 1 <> 0 THEN sd / (sz.n - 1) END)
                          ELSE sd / sz.n END AS ad FROM pr JOIN sz ON sz.l = pr.lb),
ab AS (SELECT la, x, y, z, wa, max(CASE WHEN la = lb THEN ad END) AS ai,
              min(CASE WHEN la <> lb THEN ad END) AS bi, max(CASE WHEN la = lb THEN n END) AS own
       FROM av GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT wa, CASE WHEN own <= 1 THEN 0.0 ELSE (bi - ai) / greatest(ai, bi) END AS s FROM ab),
t AS (SELECT sum(s * wa) / sum(wa) AS sil FROM s)
SELECT {rx('sil', 'silhouette')} AS silhouette,
       CASE WHEN sil > 0.5 THEN 'good' WHEN sil > 0.3 THEN 'moderate' ELSE 'poor' END AS quality FROM t"""


def leading_sql(name: str, src: str) -> str:
    """CTEs for the leading unit vector of a symmetric 3 x 3 matrix (one row xx,
    xy, xz, yy, yz, zz): squared and scaled 60 times, it is the vector's outer
    product; the largest element is made positive."""
    sq = {"xx": "xx*xx + xy*xy + xz*xz", "xy": "xx*xy + xy*yy + xz*yz", "xz": "xx*xz + xy*yz + xz*zz",
          "yy": "xy*xy + yy*yy + yz*yz", "yz": "xy*xz + yy*yz + yz*zz", "zz": "xz*xz + yz*yz + zz*zz"}
    scale = f"({sq['xx']} + {sq['yy']} + {sq['zz']})"
    step = ", ".join(f"({e}) / {scale}" for e in sq.values())
    unit = ", ".join("CASE WHEN xx >= yy AND xx >= zz THEN {}/sqrt(xx) WHEN yy >= zz THEN {}/sqrt(yy) "
                     "ELSE {}/sqrt(zz) END AS v{}".format(*cols) for cols in
                     (("xx", "xy", "xz", "x"), ("xy", "yy", "yz", "y"), ("xz", "yz", "zz", "z")))
    return f"""{name}_p(i, xx, xy, xz, yy, yz, zz) AS (SELECT 0, xx, xy, xz, yy, yz, zz FROM {src}
  UNION ALL SELECT i + 1, {step} FROM {name}_p WHERE i < 60),
{name}_v AS (SELECT {unit} FROM {name}_p WHERE i = 60),
{name} AS (SELECT v.*, vx*vx*xx + vy*vy*yy + vz*vz*zz + 2*(vx*vy*xy + vx*vz*xz + vy*vz*yz) AS ev
  FROM {name}_v v, {src})"""


_PCA = rfm_ctes().replace("WITH ", "WITH RECURSIVE ", 1) + f""",
sx AS (SELECT id_customer, Recency_Score, Frequency_Score, Monetary_Score,
              CAST(Recency_Score AS DOUBLE) AS x, CAST(Frequency_Score AS DOUBLE) AS y,
              CAST(Monetary_Score AS DOUBLE) AS z FROM lab),
cm AS (SELECT 1.0::DOUBLE AS xx, corr(x, y) AS xy, corr(x, z) AS xz, 1.0::DOUBLE AS yy, corr(y, z) AS yz,
              1.0::DOUBLE AS zz FROM sx),
{leading_sql('e1', 'cm')},
cd AS (SELECT xx - ev*vx*vx AS xx, xy - ev*vx*vy AS xy, xz - ev*vx*vz AS xz, yy - ev*vy*vy AS yy,
              yz - ev*vy*vz AS yz, zz - ev*vz*vz AS zz FROM cm, e1),
{leading_sql('e2', 'cd')}"""
ORACLES["pca_loadings"] = _PCA + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, {r(f'e1.v{a}', 'PC1')}, {r(f'e2.v{a}', 'PC2')}, "
    f"{r('e1.ev / 3', 'PC1_explained_variance')}, {r('e2.ev / 3', 'PC2_explained_variance')} FROM e1, e2"
    for c, a in (("Recency_Score", "x"), ("Frequency_Score", "y"), ("Monetary_Score", "z")))
ORACLES["pca_scores"] = _PCA + f""",
ms AS (SELECT avg(x) AS ax, stddev_samp(x) AS sdx, avg(y) AS ay, stddev_samp(y) AS sdy, avg(z) AS az,
              stddev_samp(z) AS sdz FROM sx),
zs AS (SELECT sx.*, (x - ax) / sdx AS tx1, (y - ay) / sdy AS ty1, (z - az) / sdz AS tz1 FROM sx, ms)
SELECT id_customer, Recency_Score, Frequency_Score, Monetary_Score,
       {r('tx1 * e1.vx + ty1 * e1.vy + tz1 * e1.vz', 'PC1')}, {r('tx1 * e2.vx + ty1 * e2.vy + tz1 * e2.vz', 'PC2')}
FROM zs, e1, e2"""


# ---------------------------------------------------------------- marketing mix
import math as _math  # noqa: E402

from ..operators.mix import HOLIDAY_RULES, half_life_theta  # noqa: E402

_CH = sorted(CHANNELS)
_PAR = ", ".join(f"('{c}', {half_life_theta(i + 1, inverse=True)!r}, {0.5 + 0.5 * i!r}, {0.3 + 0.15 * i!r})"
                 for i, c in enumerate(_CH))
GRID = f"""wlg AS ({FIXTURE_SQL['weekly_long']}),
chs AS (SELECT DISTINCT channel FROM wlg), wks AS (SELECT DISTINCT week FROM wlg),
g AS (SELECT chs.channel, wks.week, coalesce(wlg.spend, 0.0) AS spend
      FROM chs CROSS JOIN wks LEFT JOIN wlg ON wlg.channel = chs.channel AND wlg.week = wks.week),
par AS (SELECT * FROM (VALUES {_PAR}) t(channel, theta, alpha, gamma)),
rr AS (SELECT g.*, par.theta, row_number() OVER (PARTITION BY g.channel ORDER BY g.week) AS rn
       FROM g JOIN par USING (channel)),
ad AS (SELECT a.channel, a.week, a.spend, sum(b.spend * pow(a.theta, a.rn - b.rn)) AS adstock
       FROM rr a JOIN rr b ON a.channel = b.channel AND b.rn <= a.rn GROUP BY 1, 2, 3)"""

ORACLES["adstock_geometric"] = f"WITH {GRID}\nSELECT channel, week, {r('spend', 'spend')}, {r('adstock', 'adstock')} FROM ad"
ORACLES["saturation_hill"] = f"""WITH {GRID},
s AS (SELECT ad.channel, ad.week, ad.adstock AS x, par.alpha, par.gamma,
             (1 - par.gamma) * min(ad.adstock) OVER (PARTITION BY ad.channel)
             + par.gamma * max(ad.adstock) OVER (PARTITION BY ad.channel) AS infl
      FROM ad JOIN par USING (channel))
SELECT channel, week,
       {rx('coalesce(CASE WHEN pow(x, alpha) + pow(infl, alpha) <> 0 THEN pow(x, alpha) / (pow(x, alpha) + pow(infl, alpha)) END, 0.0)', 'saturated')} AS saturated
FROM s"""

COMP = """cg AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_suppkey % 3 AS competitor,
              l_quantity AS grp FROM lineitem),
md AS (SELECT week, competitor, quantile_cont(grp, 0.5) AS median FROM cg GROUP BY 1, 2)"""
ORACLES["median_weekly"] = f"WITH {COMP}\nSELECT week, competitor, {r('median', 'median')} FROM md"
ORACLES["competitor_adstock"] = f"""WITH {COMP},
gd AS (SELECT c.competitor, w.week, coalesce(md.median, 0.0) AS median
       FROM (SELECT DISTINCT competitor FROM md) c CROSS JOIN (SELECT DISTINCT week FROM md) w
       LEFT JOIN md ON md.competitor = c.competitor AND md.week = w.week),
rr AS (SELECT *, row_number() OVER (PARTITION BY competitor ORDER BY week) AS rn FROM gd),
ad AS (SELECT a.competitor, a.week, a.median, sum(b.median * pow(0.5, a.rn - b.rn)) AS adstock
       FROM rr a JOIN rr b ON a.competitor = b.competitor AND b.rn <= a.rn GROUP BY 1, 2, 3)
SELECT competitor, week, {r('median', 'median')}, {r('adstock', 'adstock')} FROM ad"""

_PERIOD = 365.25 / 7
_season = []
for _k in (1, 2):
    _c = 2 * _math.pi * _k
    _season.append(f"{rx(f'sin(({_c!r} * t) / {_PERIOD!r})', f'season_sin{_k}')} AS season_sin{_k}")
    _season.append(f"{rx(f'cos(({_c!r} * t) / {_PERIOD!r})', f'season_cos{_k}')} AS season_cos{_k}")
_HOL = sorted({h for _, _, h in HOLIDAY_RULES})
_HV = ", ".join(f"({m}, {d}, '{h}')" for m, d, h in HOLIDAY_RULES)
ORACLES["trend_season_holiday"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}), {weekly_sql()},
w AS (SELECT week, sales FROM weekly),
w0 AS (SELECT min(week) AS w0 FROM w),
ys AS (SELECT DISTINCT year(week) AS y FROM w),
hr AS (SELECT * FROM (VALUES {_HV}) t(m, d, holiday)),
hd AS (SELECT CAST(date_trunc('week', make_date(CAST(ys.y AS BIGINT), hr.m, hr.d)) AS DATE) AS week, hr.holiday
       FROM ys CROSS JOIN hr),
hp AS (SELECT week, {', '.join(f"max(CASE WHEN holiday = '{h}' THEN 1 END) AS {h}" for h in _HOL)} FROM hd GROUP BY week),
t AS (SELECT w.week, w.sales, (w.week - w0.w0) / 7.0 AS t FROM w, w0)
SELECT t.week, {r('t.sales', 'sales')}, {rx('t + 1', 'trend')} AS trend, {', '.join(_season)},
       {', '.join(f'coalesce(hp.{h}, 0) AS {h}' for h in _HOL)}
FROM t LEFT JOIN hp USING (week)"""

ORACLES["time_split"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}), {weekly_sql()},
w AS (SELECT week, row_number() OVER (ORDER BY week) AS r, count(*) OVER () AS n FROM weekly),
s AS (SELECT week, r, floor(n * 0.7) AS ntr, floor((n - floor(n * 0.7)) / 2) AS nv FROM w)
SELECT week, CASE WHEN r <= ntr THEN 'train' WHEN r <= ntr + nv THEN 'validation' ELSE 'test' END AS split FROM s"""


def _ranges():
    from .catalog import mix_ranges
    return mix_ranges()


def _cand_sql() -> str:
    rng = _ranges()
    cols, raw = [], {}
    for j, (name, (lo, hi)) in enumerate(rng.items()):
        u = unit_hash_sql("candidate", 7000 + j)
        raw[name] = f"{lo!r} + {hi - lo!r} * ({u})"
        safe = name.replace("-", "_").replace(" ", "_")
        cols.append(f"{rx(f'{lo!r} + {hi - lo!r} * ({u})', safe)} AS \"{safe}\"")
    for ch in _CH:
        g, safe = raw[f"{ch}_gamma"], ch.replace("-", "_").replace(" ", "_") + "_inflexion"
        mn, mx = (f"(SELECT {f}(spend) FROM g WHERE channel = '{ch}')" for f in ("min", "max"))
        cols.append(f"{rx(f'(1 - ({g})) * {mn} + ({g}) * {mx}', safe)} AS \"{safe}\"")
    return f"""WITH {GRID},
c AS (SELECT range AS candidate FROM range(10000))
SELECT candidate, CAST(candidate % 5 AS INTEGER) AS trial, CAST(candidate // 5 AS BIGINT) AS iteration,
       {', '.join(cols)} FROM c"""


MODELS = """m AS (SELECT c_custkey AS candidate, (c_custkey * 37 % 101) / 101.0 AS nrmse,
              (c_custkey * 53 % 97) / 97.0 AS decomp_rssd, CAST(c_custkey % 5 AS INTEGER) AS trial,
              CAST(c_custkey // 5 AS BIGINT) AS iteration FROM customer)"""
ORACLES["pareto_fronts_given"] = f"""WITH {MODELS},
f1 AS (SELECT * FROM (SELECT *, min(decomp_rssd) OVER (ORDER BY nrmse, decomp_rssd, candidate
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM m)
       WHERE pm IS NULL OR decomp_rssd < pm),
m2 AS (SELECT * FROM m WHERE candidate NOT IN (SELECT candidate FROM f1)),
f2 AS (SELECT * FROM (SELECT *, min(decomp_rssd) OVER (ORDER BY nrmse, decomp_rssd, candidate
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM m2)
       WHERE pm IS NULL OR decomp_rssd < pm)
SELECT candidate, {r('nrmse', 'nrmse')}, {r('decomp_rssd', 'decomp_rssd')}, trial, iteration, 1 AS front FROM f1
UNION ALL
SELECT candidate, {r('nrmse', 'nrmse')}, {r('decomp_rssd', 'decomp_rssd')}, trial, iteration, 2 FROM f2"""
ORACLES["convergence"] = f"""WITH {MODELS},
b AS (SELECT *, ntile(10) OVER (PARTITION BY trial ORDER BY iteration) AS block FROM m)
SELECT trial, block, {rx('min(nrmse)', 'best_error')} AS best_error,
       {rx('stddev_samp(nrmse)', 'sd_error')} AS sd_error, count(*) AS models FROM b GROUP BY 1, 2"""
ORACLES["select_model"] = f"""WITH {MODELS}
SELECT candidate, {r('nrmse', 'nrmse')}, {r('decomp_rssd', 'decomp_rssd')}, trial, iteration FROM m WHERE candidate = 42"""

_COEF = ", ".join(f"('{c}', {0.001 * (i + 1)!r})" for i, c in enumerate(_CH))
EFF = f"""{GRID},
co AS (SELECT * FROM (VALUES {_COEF}) t(channel, coef)),
ef AS (SELECT ad.channel, sum(co.coef * ad.adstock) AS effect FROM ad JOIN co USING (channel) GROUP BY 1),
et AS (SELECT ef.*, effect / sum(effect) OVER () AS share FROM ef),
sp AS (SELECT channel, sum(spend) AS spend FROM g GROUP BY 1)"""
ORACLES["decompose"] = f"WITH {EFF}\nSELECT channel, {r('effect', 'effect')}, {r('share', 'share')} FROM et"
ORACLES["roi"] = f"""WITH {EFF}
SELECT channel, {r('effect', 'effect')}, {r('share', 'share')}, {r('spend', 'spend')},
       {rx('CASE WHEN spend <> 0 THEN effect / spend END', 'roi')} AS roi FROM et JOIN sp USING (channel)"""
ORACLES["decomp_rssd"] = f"""WITH {EFF},
j AS (SELECT et.effect, sp.spend FROM et JOIN sp USING (channel)),
t AS (SELECT sum(effect) AS e, sum(spend) AS s FROM j)
SELECT {rx('sqrt(sum((effect / e - spend / s) * (effect / e - spend / s)))', 'decomp_rssd')} AS decomp_rssd FROM j, t"""
_PAIRS = ", ".join(f"('{_CH[i]}', '{_CH[j]}')" for i, j in ((0, 4), (0, 3), (3, 1), (3, 2), (1, 4)))
ORACLES["base_incremental"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}), {weekly_sql()}, {EFF},
b AS (SELECT (SELECT sum(sales)::DOUBLE FROM weekly) AS t, (SELECT sum(effect) FROM ef) AS incremental)
SELECT {rx('t - incremental', 'base')} AS base, {r('incremental', 'incremental')},
       {rx('(t - incremental) / t', 'base_share')} AS base_share,
       {rx('incremental / t', 'incremental_share')} AS incremental_share FROM b"""
ORACLES["conditional_roi"] = f"""WITH {EFF},
pr AS (SELECT * FROM (VALUES {_PAIRS}) t(a, b)),
pe AS (SELECT pr.a, pr.b, sum(1e-9 * x.adstock * y.adstock) AS effect
       FROM pr JOIN ad x ON x.channel = pr.a JOIN ad y ON y.channel = pr.b AND x.week = y.week GROUP BY 1, 2),
hv AS (SELECT channel, sum(h) AS pair_effect FROM (SELECT a AS channel, effect / 2 AS h FROM pe
                                                   UNION ALL SELECT b, effect / 2 FROM pe) GROUP BY 1),
j AS (SELECT et.channel, et.effect, et.share, coalesce(hv.pair_effect, 0.0) AS pair_effect, sp.spend
      FROM et LEFT JOIN hv USING (channel) JOIN sp USING (channel))
SELECT channel, {r('effect', 'effect')}, {r('share', 'share')}, {r('pair_effect', 'pair_effect')},
       {r('spend', 'spend')}, {rx('CASE WHEN spend <> 0 THEN (effect + pair_effect) / spend END', 'conditional_roi')} AS conditional_roi
FROM j"""
ORACLES["nrmse"] = f"""WITH tx AS ({FIXTURE_SQL['tx']}), {weekly_sql()}, {EFF},
pr AS (SELECT ad.week, sum(co.coef * ad.adstock) AS pred FROM ad JOIN co USING (channel) GROUP BY 1),
w AS (SELECT weekly.week, weekly.sales, pr.pred FROM weekly JOIN pr USING (week))
SELECT {rx('sqrt(avg((sales - pred) * (sales - pred))) / (max(sales) - min(sales))', 'nrmse')} AS nrmse FROM w"""

_IDX = ", ".join(f"('{c}', {i})" for i, c in enumerate(_CH))
CURVES = f"""tx AS ({FIXTURE_SQL['tx']}), {weekly_sql()}, {GRID},
ix AS (SELECT * FROM (VALUES {_IDX}) t(channel, i)),
av AS (SELECT avg(sales) AS s FROM weekly),
cur AS (SELECT channel, avg(spend) AS current FROM g GROUP BY 1),
cv AS (SELECT cur.channel, cur.current, (av.s * (ix.i + 1)) / 15.0 AS beta, 0.5 + 0.5 * ix.i AS alpha,
              cur.current * (0.6 + 0.2 * ix.i) AS inflexion FROM cur JOIN ix USING (channel), av)"""


def _resp(s: str) -> str:
    return (f"beta * coalesce(CASE WHEN pow({s}, alpha) + pow(inflexion, alpha) <> 0 THEN "
            f"pow({s}, alpha) / (pow({s}, alpha) + pow(inflexion, alpha)) END, 0.0)")


ORACLES["marginal_roas"] = f"""WITH {CURVES}
SELECT channel, {r('current', 'current')}, {r('beta', 'beta')}, {r('alpha', 'alpha')}, {r('inflexion', 'inflexion')},
       {rx('CASE WHEN pow(pow(current, alpha) + pow(inflexion, alpha), 2) <> 0 THEN beta * alpha * pow(inflexion, alpha) * pow(current, alpha - 1) / pow(pow(current, alpha) + pow(inflexion, alpha), 2) END', 'marginal_roas')} AS marginal_roas
FROM cv"""

_sum5 = "l1.{0} + l2.{0} + l3.{0} + l4.{0} + l5.{0}"
_tot5 = "(((l1.resp + l2.resp) + l3.resp) + l4.resp) + l5.resp"
ORACLES["allocate_budget"] = f"""WITH {CURVES},
B AS (SELECT sum(current) / 100 AS unit, floor((sum(current) - sum(current * 0.7)) / (sum(current) / 100) + 1e-9) AS steps
      FROM cv),
lv AS (SELECT channel, beta, alpha, inflexion, range AS j, current * 0.7 + range * B.unit AS spend
       FROM cv, B, range(101) WHERE range <= floor(current * {1.5 - 0.7!r} / B.unit + 1e-9)),
L AS (SELECT channel, j, spend, {_resp('spend')} AS resp FROM lv),
combos AS (SELECT l1.spend AS s1, l2.spend AS s2, l3.spend AS s3, l4.spend AS s4, l5.spend AS s5,
                  {_sum5.format('j')} AS spent, {_tot5} AS total
           FROM (SELECT * FROM L WHERE channel = '{_CH[0]}') l1, (SELECT * FROM L WHERE channel = '{_CH[1]}') l2,
                (SELECT * FROM L WHERE channel = '{_CH[2]}') l3, (SELECT * FROM L WHERE channel = '{_CH[3]}') l4,
                (SELECT * FROM L WHERE channel = '{_CH[4]}') l5, B
           WHERE {_sum5.format('j')} <= B.steps),
best AS (SELECT * FROM combos ORDER BY total DESC, spent LIMIT 1),
pick AS (SELECT '{_CH[0]}' AS channel, s1 AS spend_opt, total FROM best UNION ALL SELECT '{_CH[1]}', s2, total FROM best
         UNION ALL SELECT '{_CH[2]}', s3, total FROM best UNION ALL SELECT '{_CH[3]}', s4, total FROM best
         UNION ALL SELECT '{_CH[4]}', s5, total FROM best)
SELECT p.channel, {r('cv.current', 'current')}, {r('p.spend_opt', 'spend_opt')},
       {rx(_resp('cv.current'), 'response_current')} AS response_current,
       {rx(_resp('p.spend_opt'), 'response_opt')} AS response_opt, {r('p.total', 'total_response')}
FROM pick p JOIN cv USING (channel)"""


ORACLES["candidate_params"] = _cand_sql()


def best_spend_sql(p: str, low: float, up: float) -> str:
    """CTEs for the best spends within bounds on the common grid: channel by
    channel, the best total for every number of steps spent."""
    ctes = [f"""{p}b AS (SELECT sum(current) / 100 AS unit,
  floor((sum(current) - sum(current * {low!r})) / (sum(current) / 100) + 1e-9) AS steps FROM cv)""",
            f"""{p}lv AS (SELECT channel, beta, alpha, inflexion, range AS j, current * {low!r} + range * b.unit AS spend
  FROM cv, {p}b b, range(101) WHERE range <= floor(current * {(up - low)!r} / b.unit + 1e-9) AND range <= b.steps)""",
            f"{p}l AS (SELECT channel, j, spend, {_resp('spend')} AS resp FROM {p}lv)",
            f"{p}s0 AS (SELECT j AS spent, resp AS total, [spend] AS c FROM {p}l WHERE channel = '{_CH[0]}')"]
    ctes += [f"""{p}s{i} AS (SELECT s.spent + l.j AS spent, max(s.total + l.resp) AS total,
  arg_max(list_append(s.c, l.spend), s.total + l.resp) AS c FROM {p}s{i - 1} s, {p}l l, {p}b b
  WHERE l.channel = '{ch}' AND s.spent + l.j <= b.steps GROUP BY 1)""" for i, ch in enumerate(_CH) if i]
    ctes.append(f"{p}best AS (SELECT c FROM {p}s{len(_CH) - 1} ORDER BY total DESC, spent LIMIT 1)")
    return ",\n".join(ctes)


ORACLES["budget_scenarios"] = f"""WITH {CURVES},
{best_spend_sql('tight_', 0.7, 1.5)},
{best_spend_sql('wide_', max(0.0, 1 - 3 * (1 - 0.7)), 1 + 3 * (1.5 - 1))},
pk AS (SELECT 'initial' AS scenario, channel, current AS spend FROM cv
""" + "".join(f"  UNION ALL SELECT '{sc}', '{ch}', c[{i + 1}] FROM {p}best\n" for sc, p in
              (("bounded", "tight_"), ("bounded_x3", "wide_")) for i, ch in enumerate(_CH)) + f"""),
tt AS (SELECT scenario, sum(spend) AS t FROM pk GROUP BY 1)
SELECT pk.scenario, pk.channel, {r('pk.spend', 'spend_opt')}, {r(_resp('pk.spend'), 'response_opt')},
       {r('pk.spend / tt.t', 'spend_share')}
FROM pk JOIN tt USING (scenario) JOIN cv USING (channel)"""


# ---------------------------------------------------------------- survey scores
def _alpha_sql() -> str:
    from .catalog import SURVEY_BLOCKS
    parts = []
    for b, items in SURVEY_BLOCKS.items():
        k = len(items)
        sv = "(" + " + ".join(["0.0"] + [f"var_samp({i})" for i in items]) + ")"
        tot = "var_samp(" + " + ".join(["0.0"] + items) + ")"
        parts.append(f"SELECT '{b}' AS construct, {k} AS items, "
                     f"{rx(f'{k / (k - 1)!r} * (1 - {sv} / {tot})', 'alpha')} AS alpha FROM s")
    return f"WITH s AS ({FIXTURE_SQL['survey_items']})\n" + "\nUNION ALL\n".join(parts)


ORACLES["cronbach_alpha"] = _alpha_sql()
ORACLES["bootstrap_summary_given"] = f"""
SELECT event_type AS parameter, {rx('avg(value)', 'boot_mean')} AS boot_mean,
       {rx('stddev_samp(value)', 'boot_se')} AS boot_se,
       {rx('quantile_cont(value, 0.025)', 'ci_lower')} AS ci_lower,
       {rx('quantile_cont(value, 0.975)', 'ci_upper')} AS ci_upper, count(value) AS replicates,
       count(*) FILTER (WHERE value IS NULL) AS failed
FROM events GROUP BY 1"""

# every number of trees on its own, over the votes cast so far
ORACLES["oob_error_given"] = f"""
WITH v AS (SELECT l_orderkey AS id, l_linenumber - 1 AS tree, max((l_returnflag = 'R')::INT) AS vote
           FROM lineitem GROUP BY ALL),
k AS (SELECT DISTINCT (tree + 1)::INT AS trees FROM v),
c AS (SELECT k.trees, o_totalprice > 150000 AS y, (avg(vote) > 0.5) <> (o_totalprice > 150000) AS wrong
      FROM k JOIN v ON v.tree < k.trees JOIN orders ON o_orderkey = v.id
      GROUP BY k.trees, v.id, o_totalprice)
SELECT trees, count(*) AS rows, {rx('avg(wrong::INT)', 'error')} AS error,
       {rx('avg(wrong::INT) FILTER (WHERE NOT y)', 'error_0')} AS error_0,
       {rx('avg(wrong::INT) FILTER (WHERE y)', 'error_1')} AS error_1
FROM c GROUP BY trees"""

# g = 1/2 - y and h = 1/4 in every row: the first tree starts at even odds
_T = "(sign({g}) * greatest(abs({g}) - 0.1, 0)) ** 2 / ({h} + 1)"
ORACLES["boost_root_gains"] = f"""
WITH s AS ({students_sql()}),
c AS (SELECT * FROM s WHERE Exam_Score IS NOT NULL AND Attendance IS NOT NULL AND Hours_Studied IS NOT NULL
      AND Sleep_Hours IS NOT NULL AND Previous_Scores IS NOT NULL),
v AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS Variable, {c}::DOUBLE AS x, 0.5 - (Exam_Score >= 55)::INT AS g, 0.25 AS h FROM c"
    for c in ("Attendance", "Hours_Studied", "Sleep_Hours", "Previous_Scores")) + f"""),
b AS (SELECT Variable, x, sum(g)::DOUBLE AS g, sum(h)::DOUBLE AS h FROM v GROUP BY ALL),
l AS (SELECT Variable, x AS cut, sum(g) OVER w AS gl, sum(h) OVER w AS hl,
             sum(g) OVER (PARTITION BY Variable) AS gt, sum(h) OVER (PARTITION BY Variable) AS ht
      FROM b WINDOW w AS (PARTITION BY Variable ORDER BY x))
SELECT Variable, {r('cut', 'cut')}, {rx('(' + _T.format(g='gl', h='hl') + ' + ' + _T.format(g='(gt - gl)', h='(ht - hl)')
    + ' - ' + _T.format(g='gt', h='ht') + ')', 'gain_stat')} AS gain_stat
FROM l WHERE hl >= 1 AND ht - hl >= 1"""

# every grid point against every row
ORACLES["loess"] = f"""
WITH s AS ({students_sql()}),
d AS (SELECT Attendance::DOUBLE AS a, Exam_Score::DOUBLE AS y FROM s
      WHERE Attendance IS NOT NULL AND Exam_Score IS NOT NULL),
e AS (SELECT min(a) AS lo, max(a) AS hi, ceil(0.6 * count(*) - 1e-9) AS k FROM d),
g AS (SELECT lo + (hi - lo) * i / 24 AS x, k FROM e, (SELECT unnest(range(25)) AS i)),
p AS (SELECT x, k, a - x AS u, abs(a - x) AS far, y, row_number() OVER (PARTITION BY x ORDER BY abs(a - x)) AS r
      FROM g, d),
h AS (SELECT x, max(far) FILTER (WHERE r = k) AS h FROM p GROUP BY x),
w AS (SELECT x, u / h AS v, y, (1 - (far / h) ** 3) ** 3 AS w FROM p JOIN h USING (x) WHERE far < h),
m AS (SELECT x, sum(w) AS s0, sum(w * v) AS s1, sum(w * v * v) AS s2, sum(w * y) AS t0, sum(w * v * y) AS t1
      FROM w GROUP BY x)
SELECT {r('x', 'x')}, {rx('(s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1)', 'smooth_fitted')} AS smooth_fitted FROM m"""


# ---------------------------------------------------------------- bootstrap weights, whole-table ranks, column helpers
def _poisson_steps() -> str:
    """Poisson(1) draw of the uniform ``u``: how many cumulated shares it reaches."""
    share, total, steps = _math.exp(-1.0), 0.0, []
    for k in range(16):
        total += share / _math.factorial(k)
        steps.append(f"CAST(u >= {total!r} AS INTEGER)")
    return " + ".join(steps)


_WRAP = "18446744073709551616::UHUGEINT"
ORACLES["bootstrap_sums"] = f"""WITH s AS (SELECT respondent, D12_1 AS a, D12_2 AS b FROM ({FIXTURE_SQL['survey_items']})),
h0 AS (SELECT s.*, range AS rep, xor((respondent::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT % {_WRAP})::UBIGINT,
              ((range + 42)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT % {_WRAP})::UBIGINT) AS x FROM s, range(50)),
h1 AS (SELECT * REPLACE ((xor(x, x >> 31)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT % {_WRAP})::UBIGINT AS x) FROM h0),
h2 AS (SELECT *, CAST(xor(x, x >> 29) >> 11 AS DOUBLE) / 9007199254740992.0 AS u FROM h1),
h3 AS (SELECT *, {_poisson_steps()} AS w FROM h2)
SELECT rep, {rx('sum(w)', 'total')} AS total, {rx('sum(w * a)', 'coef_s1')} AS coef_s1, {rx('sum(w * b)', 'coef_s2')} AS coef_s2,
       {rx('sum(w * a * a)', 'coef_s11')} AS coef_s11, {rx('sum(w * a * b)', 'coef_s12')} AS coef_s12,
       {rx('sum(w * b * b)', 'coef_s22')} AS coef_s22
FROM h3 GROUP BY rep"""
ORACLES["rank_customers"] = f"""SELECT c_custkey, {r('c_acctbal', 'c_acctbal')},
       row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS Rank FROM customer"""
ORACLES["top_with_ties"] = """SELECT p_partkey, p_size FROM part
QUALIFY rank() OVER (ORDER BY p_size DESC) <= 17"""
ORACLES["chosen_columns"] = f"""SELECT c_custkey AS id_customer, {r('c_acctbal', 'balance')}, c_mktsegment FROM customer"""


# ---------------------------------------------------------------- scores from given weights
def _answers_sql() -> str:
    from ..sources.fixtures import ANSWER_LATENTS, ANSWER_LOADINGS
    from .catalog import GIVEN_WEIGHTS, SURVEY_BLOCKS
    answers, scores = [], []
    for b, items in SURVEY_BLOCKS.items():
        latent = " + ".join(f"{w!r} * embedding[{i}]::DOUBLE" for i, w in ANSWER_LATENTS[b])
        answers += [f"{load!r} * ({latent}) + embedding[{c.rsplit('_', 1)[1]}]::DOUBLE AS {c}"
                    for c, load in zip(items, ANSWER_LOADINGS)]
        scores.append(" + ".join(f"{w!r} * ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()"
                                 for c, w in zip(items, GIVEN_WEIGHTS[b])) + f" AS {b}")
    return (f"WITH an AS (SELECT vec_id AS respondent, {', '.join(answers)} FROM embeddings),\n"
            f"sc AS (SELECT respondent, {', '.join(scores)} FROM an)\n")


_BLOCKS = ("DLIT", "HLIT", "DSS", "EHS")
ORACLES["construct_scores_given"] = _answers_sql() + "SELECT respondent, " + ", ".join(
    r(b, f"score_{b}") for b in _BLOCKS) + " FROM sc"
ORACLES["score_index_given"] = _answers_sql() + "SELECT respondent, " + ", ".join(
    r(f"({b} - min({b}) OVER ()) / (max({b}) OVER () - min({b}) OVER ()) * 100", f"score_{b}_index")
    for b in _BLOCKS) + " FROM sc"
ORACLES["construct_r2_given"] = _answers_sql() + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS source, '{b}' AS target, {r(f'corr({a}, {b}) * corr({a}, {b})', 'r2')} FROM sc"
    for a, b in (("DLIT", "DSS"), ("HLIT", "EHS")))
