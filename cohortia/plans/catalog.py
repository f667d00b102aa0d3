"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the survey inventory. ``oracle.py`` holds the matching SQL.

Doubles are rounded to significant digits (``compare.py``) at the very end of
each query so results compare across engines despite summation order and
different variance algorithms; the library functions themselves return full
precision.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..operators import customer as cu
from ..operators import segments as sg
from ..operators import quality as qa
from ..sources import fixtures as fx
from ..functions.stats import quantiles
from ..functions.scalar import blank_to_null
from ..session import keep, packed, settled
from .compare import BIAS, SIG_DEFAULT, digits_for
from .rfm import rfm_segments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


_MEMO: dict = {}


def memo(key, build):
    """Per-session reuse of an expensive shared input (persisted); cleared by
    ``clear_memo`` (the bench clears it before every query)."""
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def clear_memo() -> None:
    for v in list(_MEMO.values()):
        frames = [v] if isinstance(v, DataFrame) else [
            x for x in getattr(v, "__dict__", {}).values() if isinstance(x, DataFrame)]
        for d in frames:
            d.unpersist()
    _MEMO.clear()


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def sig_round(c, digits: int = SIG_DEFAULT):
    """Round a double to ``digits`` significant digits using exact powers of
    ten only, so Spark and DuckDB produce the same double."""
    c = c * F.lit(1.0 + BIAS)
    a = F.abs(c)
    k = F.floor(F.log10(F.when(a == 0, F.lit(1.0)).otherwise(a))) - (digits - 1)
    up = F.pow(F.lit(10.0), -k)
    down = F.pow(F.lit(10.0), k)
    return (F.when(c.isNull() | (c == 0) | F.isnan(c), c)
            .when(k < 0, F.round(c * up, 0) / up)
            .otherwise(F.round(c / down, 0) * down))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[
        sig_round(F.col(f.name).cast("double"), digits_for(f.name)).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema.fields])


# ---------------------------------------------------------------- RFM slice
@register("rfm_segment_share")
def q_rfm_segment_share(spark, sf):
    return rounded(sg.segment_share(rfm_segments(fx.transactions(spark, sf)).regular))


@register("rfm_customers")
def q_rfm_customers(spark, sf):
    tx = cu.drop_sales_anomaly(fx.transactions(spark, sf))
    return rounded(cu.rfm_customers(tx))


@register("churn_customers")
def q_churn_customers(spark, sf):
    return rounded(cu.churn_customers(fx.transactions(spark, sf)))


@register("churn_customers_dense")
def q_churn_customers_dense(spark, sf):
    return rounded(cu.churn_customers(fx.dense_transactions(spark, sf)))


@register("purchase_gaps")
def q_purchase_gaps(spark, sf):
    return cu.purchase_gaps(fx.transactions(spark, sf))


@register("period_metrics")
def q_period_metrics(spark, sf):
    return rounded(cu.period_metrics(fx.transactions(spark, sf), 31))


@register("period_metrics_dense")
def q_period_metrics_dense(spark, sf):
    return rounded(cu.period_metrics(fx.dense_transactions(spark, sf), fx.DENSE_PERIOD_DAYS))


@register("tx_per_month")
def q_tx_per_month(spark, sf):
    return cu.tx_per_month(fx.transactions(spark, sf))


@register("dataset_bounds")
def q_dataset_bounds(spark, sf):
    return cu.dataset_bounds(fx.transactions(spark, sf))


@register("clean_transactions")
def q_clean_transactions(spark, sf):
    return rounded(cu.drop_sales_anomaly(fx.transactions(spark, sf)))


@register("sales_anomaly_rows")
def q_sales_anomaly_rows(spark, sf):
    return rounded(cu.sales_anomaly_rows(fx.dense_transactions(spark, sf)))


@register("anomaly_report")
def q_anomaly_report(spark, sf):
    return rounded(qa.anomaly_report(fx.transactions(spark, sf)))


@register("recency_outlier_sweep")
def q_recency_outlier_sweep(spark, sf):
    c = cu.rfm_customers(cu.drop_sales_anomaly(fx.transactions(spark, sf)))
    return rounded(sg.outlier_sweep(c, "Recency"))


def _kept(spark, sf, tx=None):
    """``tx``: the transactions, if the caller has them."""
    return memo((spark.sparkContext.applicationId, sf, "rfm"),
                lambda: rfm_segments(fx.transactions(spark, sf) if tx is None else tx))


@register("percentile_sweep")
def q_percentile_sweep(spark, sf):
    return rounded(sg.percentile_sweep(_kept(spark, sf).kept))


@register("two_bound_sweep")
def q_two_bound_sweep(spark, sf):
    return rounded(sg.two_bound_sweep(_kept(spark, sf).kept))


@register("super_customers")
def q_super_customers(spark, sf):
    r = _kept(spark, sf)
    return rounded(r.super_.select("id_customer", "Frequency", "Monetary_Value", "Recency",
                                   "anomaly"))


@register("rfm_labels")
def q_rfm_labels(spark, sf):
    r = _kept(spark, sf)
    return r.regular.select("id_customer", "Recency_Label", "Frequency_Label", "Monetary_Label",
                            "Customer_Segment", "Recency_Score", "Frequency_Score",
                            "Monetary_Score")


@register("trim_super")
def q_trim_super(spark, sf):
    r = _kept(spark, sf)
    return rounded(sg.trim_super(r.super_).select("id_customer", "Frequency", "Monetary_Value",
                                                  "anomaly"))


@register("recency_quantiles")
def q_recency_quantiles(spark, sf):
    c = cu.rfm_customers(cu.drop_sales_anomaly(fx.transactions(spark, sf)))
    probs = [0.2, 0.25, 0.5, 0.75, 0.8]
    cols = ["Recency", "Frequency", "Monetary_Value"]
    vals = {col: quantiles(c, col, probs) for col in cols}
    rows = [(col, p, vals[col][i]) for col in cols for i, p in enumerate(probs)]
    return rounded(spark.createDataFrame(rows, "variable string, prob double, value double"))


@register("store_type_counts")
def q_store_type_counts(spark, sf):
    return sg.count_by(fx.transactions(spark, sf), "store_type")


@register("recency_histogram")
def q_recency_histogram(spark, sf):
    c = cu.rfm_customers(cu.drop_sales_anomaly(fx.transactions(spark, sf)))
    return qa.histogram(c, "Recency", width=1.0)


@register("money_histogram_20")
def q_money_histogram_20(spark, sf):
    c = cu.rfm_customers(cu.drop_sales_anomaly(fx.transactions(spark, sf)))
    return rounded(qa.histogram_bins(c, "Monetary_Value", bins=20))


@register("box_stats")
def q_box_stats(spark, sf):
    c = cu.churn_customers(fx.transactions(spark, sf))
    return rounded(qa.box_stats(c, "Monetary_Value", "Store_Type_Variety"))


@register("missing_counts")
def q_missing_counts(spark, sf):
    return qa.missing_counts(blank_to_null(fx.students(spark, sf)))


@register("data_quality_report")
def q_data_quality_report(spark, sf):
    return rounded(qa.data_quality_report(fx.prospects(spark, sf)))


@register("profit_by_demographic")
def q_profit_by_demographic(spark, sf):
    return rounded(qa.profit_by_demographic(fx.transactions(spark, sf), fx.prospects(spark, sf)))


@register("profile")
def q_profile(spark, sf):
    return rounded(qa.profile(cu.drop_sales_anomaly(fx.transactions(spark, sf)),
                              ["gross_sales", "net_sales", "number_item_PL"]))


@register("top_prospects")
def q_top_prospects(spark, sf):
    c = cu.rfm_customers(cu.drop_sales_anomaly(fx.transactions(spark, sf)))
    return rounded(sg.top_prospects(c.select("id_customer", "Monetary_Value", "Frequency"),
                                    "Monetary_Value", n=1000))


# ---------------------------------------------------------------- churn
from ..operators import churn as ch  # noqa: E402


@register("churn_flags")
def q_churn_flags(spark, sf):
    return rounded(ch.churn_flags(fx.transactions(spark, sf), 31))


@register("churn_flags_dense")
def q_churn_flags_dense(spark, sf):
    return rounded(ch.churn_flags(fx.dense_transactions(spark, sf), fx.DENSE_PERIOD_DAYS))


@register("customer_churn")
def q_customer_churn(spark, sf):
    tx = fx.transactions(spark, sf)
    cust = cu.churn_customers(tx)
    c = ch.customer_churn(cust, ch.churn_flags(tx, 31, cu.first_date(cust)))
    return c.select("id_customer", "Recency", "Churn")


@register("customer_churn_dense")
def q_customer_churn_dense(spark, sf):
    tx = fx.dense_transactions(spark, sf)
    cust = cu.churn_customers(tx)
    c = ch.customer_churn(cust, ch.churn_flags(tx, fx.DENSE_PERIOD_DAYS, cu.first_date(cust)))
    return c.select("id_customer", "Recency", "Churn")


@register("churned_count_dense")
def q_churned_count_dense(spark, sf):
    return ch.count_distinct_flagged(
        ch.churn_flags(fx.dense_transactions(spark, sf), fx.DENSE_PERIOD_DAYS), "Churned")


@register("attach_segment")
def q_attach_segment(spark, sf):
    tx = fx.transactions(spark, sf)
    seg = rfm_segments(tx).regular.select(
        "id_customer", F.col("Customer_Segment").alias("Final_Segment"))
    c = ch.attach_segment(cu.churn_customers(tx), seg)
    return rounded(c.select("id_customer", "Monetary_Value", "Final_Segment"))


# ---------------------------------------------------------------- evaluation
from ..operators import evaluate as ev  # noqa: E402
from ..operators import ranking as rk  # noqa: E402


@register("confusion_rates")
def q_confusion_rates(spark, sf):
    return rounded(ev.rates(ev.confusion(fx.scored_rows(spark, sf), t=0.5)))


@register("threshold_sweep")
def q_threshold_sweep(spark, sf):
    return rounded(ev.threshold_sweep(fx.scored_rows(spark, sf)))


@register("best_thresholds")
def q_best_thresholds(spark, sf):
    return ev.best_thresholds(ev.threshold_sweep(fx.scored_rows(spark, sf)))


@register("closest_corner")
def q_closest_corner(spark, sf):
    return rounded(ev.closest_corner(ev.threshold_sweep(fx.scored_rows(spark, sf))))


@register("roc_auc")
def q_roc_auc(spark, sf):
    return rounded(ev.roc_auc(fx.scored_rows(spark, sf)))


@register("roc_curve")
def q_roc_curve(spark, sf):
    return rounded(ev.roc_curve(fx.scored_rows(spark, sf)))


@register("log_loss")
def q_log_loss(spark, sf):
    return rounded(ev.log_loss(fx.scored_rows(spark, sf)))


@register("regression_metrics")
def q_regression_metrics(spark, sf):
    tx = fx.transactions(spark, sf).withColumn("pred", F.col("net_sales") * 1.05)
    return rounded(ev.regression_metrics(tx, "gross_sales", "pred"))


@register("stratified_split")
def q_stratified_split(spark, sf):
    s = fx.scored_rows(spark, sf)
    train, test = ev.stratified_split(s, 0.8)
    both = (train.withColumn("split", F.lit("train"))
            .unionByName(test.withColumn("split", F.lit("test"))))
    return both.groupBy("label", "split").agg(F.count(F.lit(1)).alias("rows"))


@register("holdout_by_antijoin")
def q_holdout_by_antijoin(spark, sf):
    s = fx.scored_rows(spark, sf)
    train, _ = ev.random_split(s, 0.8)
    return rounded(ev.holdout_by_antijoin(s, train))


def demo_coefficients(spark, sf):
    """A coefficient table derived from the customer tables (input of M29)."""
    c = fx.table(spark, sf, "customer")
    n = fx.table(spark, sf, "nation")
    r = fx.table(spark, sf, "region")
    j = (c.join(n, c.c_nationkey == n.n_nationkey)
         .join(r, F.col("n_regionkey") == r.r_regionkey))
    overall = j.agg(F.avg("c_acctbal").alias("__mu"))

    def factor(col, label):
        return (j.groupBy(col).agg(F.avg("c_acctbal").alias("__m"), F.count(F.lit(1)).alias("__k"))
                .crossJoin(overall)
                .select(F.concat(F.lit(f"C({label})[T."), F.col(col), F.lit("]")).alias("term"),
                        ((F.col("__m") - F.col("__mu")) / 1000.0).alias("estimate"),
                        ((F.col("__k") % 7) / 100.0).alias("p_value")))

    nums = j.agg(
        F.corr(F.col("c_nationkey").cast("double"), "c_acctbal").alias("a"),
        F.corr((F.col("c_custkey") % 100).cast("double"), "c_acctbal").alias("b"),
        (F.avg("c_acctbal") / 1000.0).alias("i"))
    nums = nums.select(F.explode(F.array(
        F.struct(F.lit("c_nationkey").alias("term"), F.col("a").alias("estimate"),
                 F.lit(0.2).alias("p_value")),
        F.struct(F.lit("custkey_mod").alias("term"), F.col("b").alias("estimate"),
                 F.lit(0.03).alias("p_value")),
        F.struct(F.lit("Intercept").alias("term"), F.col("i").alias("estimate"),
                 F.lit(0.0).alias("p_value")))).alias("s")).select("s.*")
    return factor("c_mktsegment", "c_mktsegment").unionByName(factor("r_name", "region")).unionByName(nums)


@register("rank_logit")
def q_rank_logit(spark, sf):
    out = rk.rank_logit(demo_coefficients(spark, sf), ["c_mktsegment", "region"])
    return rounded(out.select("Variable", "Importance", "PValueRank", "Rank", "Method"))


@register("rank_models")
def q_rank_models(spark, sf):
    coefs = demo_coefficients(spark, sf)
    logit = rk.rank_logit(coefs, ["c_mktsegment", "region"]).select("Variable", "Rank", "Method")
    per_var = logit.select("Variable").join(
        rk.rank_logit(coefs, ["c_mktsegment", "region"]).select("Variable", "Importance"), "Variable")
    forest = rk.rank_by_importance(per_var, "Random Forest")
    boost = rk.rank_by_importance(per_var.withColumn("Importance", -F.col("Importance")),
                                  "XGBoost", top=2)
    methods = ["Logistic Regression", "Random Forest", "XGBoost"]
    return rounded(rk.rank_models(logit.unionByName(forest).unionByName(boost), methods))


# ---------------------------------------------------------------- survival, baskets
from ..operators import survival as sv  # noqa: E402
from ..operators import baskets as bk  # noqa: E402


def survival_input(spark, sf):
    # two steps read the transactions: they are made once, and let go when the table is there
    tx = keep(fx.transactions(spark, sf).drop("PL_gross_sales"))
    cust = cu.churn_customers(tx)
    c = ch.customer_churn(cust, ch.churn_flags(tx, 31, cu.first_date(cust)))
    table = settled(keep(c.select("id_customer", "Purchase_Months", "Churn", "Store_Type_Variety")))
    tx.unpersist()
    return table


@register("kaplan_meier")
def q_kaplan_meier(spark, sf):
    return rounded(sv.kaplan_meier(survival_input(spark, sf), "Purchase_Months", "Churn"))


@register("kaplan_meier_by_store")
def q_kaplan_meier_by_store(spark, sf):
    return rounded(sv.kaplan_meier(survival_input(spark, sf), "Purchase_Months", "Churn",
                                   by="Store_Type_Variety"))


@register("log_rank_oe")
def q_log_rank_oe(spark, sf):
    out = sv.log_rank(survival_input(spark, sf), "Purchase_Months", "Churn", "Store_Type_Variety")
    return rounded(out.select("Store_Type_Variety", "observed", "expected"))


@register("log_rank")
def q_log_rank(spark, sf):
    return rounded(sv.log_rank(survival_input(spark, sf), "Purchase_Months", "Churn",
                               "Store_Type_Variety"))


BASKET_LIMITS = dict(min_support=0.01, min_confidence=0.05, min_lift=1.0)


@register("basket_pair_rules")
def q_basket_pair_rules(spark, sf):
    return rounded(bk.pair_rules(bk.basket_rules(fx.baskets(spark, sf), **BASKET_LIMITS)))


@register("ready_baskets")
def q_ready_baskets(spark, sf):
    return rounded(bk.ready_baskets(bk.basket_rules(fx.baskets(spark, sf), **BASKET_LIMITS)))


def _mixed_item_rules(spark, sf):
    return bk.basket_rules(fx.basket_items(spark, sf))     # the reference's limits


@register("basket_rules")
def q_basket_rules(spark, sf):
    return rounded(bk.rule_table(_mixed_item_rules(spark, sf)))


@register("basket_bundles")
def q_basket_bundles(spark, sf):
    return bk.connected_bundles(_mixed_item_rules(spark, sf))


# ---------------------------------------------------------------- readers and sinks
from uuid import uuid4  # noqa: E402

from ..session import shared_folder  # noqa: E402
from ..sources import readers, sinks, workbook  # noqa: E402


def _new_path(spark, label):
    return f"{shared_folder(spark)}/cohortia-{label}-{uuid4().hex}"


@register("read_back_transactions")
def q_read_back_transactions(spark, sf):
    path = _new_path(spark, "transactions")
    cents = F.col("PL_gross_sales").cast("decimal(18,2)").cast("string")
    other = F.when(F.col("id_customer") % 11 == 0, F.lit("n/a")).otherwise(
        F.col("number_items_other").cast("string"))
    tx = fx.transactions(spark, sf).withColumns({
        "date": F.col("date").cast("string"), "PL_gross_sales": F.replace(cents, F.lit("."), F.lit(",")),
        "number_items_other": other})
    sinks.write_table(tx, path, fmt="csv")
    return rounded(readers.read_transactions(spark, path))


@register("read_back_weekly")
def q_read_back_weekly(spark, sf):
    path = _new_path(spark, "weekly")
    sinks.write_table(fx.weekly(spark, sf).withColumn("week", F.date_format("week", "dd.MM.yy")),
                      path, fmt="csv")
    return rounded(readers.read_weekly(spark, path, date_col="week"))


@register("read_back_report")
def q_read_back_report(spark, sf):
    path = _new_path(spark, "report")
    students = fx.students(spark, sf)
    nations = fx.table(spark, sf, "nation").join(
        fx.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sinks.write_report({"regions": nations, "students": students}, path)
    fit, _, _ = lm.ols_fit(students, "Exam_Score", ["Hours_Studied", "Attendance"])
    sinks.export_model(lm.tidy(spark, fit), f"{path}/model")
    parts = [spark.read.parquet(f"{path}/{n}").groupBy(F.lit(n).alias("name")).agg(
        F.count(F.lit(1)).alias("rows")) for n in ("regions", "students")]
    model = spark.read.json(f"{path}/model").groupBy(F.lit("model").alias("name")).agg(
        F.count(F.lit(1)).alias("rows"))
    return parts[0].unionByName(parts[1]).unionByName(model)


@register("read_back_workbook")
def q_read_back_workbook(spark, sf):
    """Two tables as sheets of one workbook; the sheet of students, whole."""
    path = _new_path(spark, "workbook") + ".xlsx"
    students = blank_to_null(fx.students(spark, sf))
    sinks.write_report({"regions": fx.table(spark, sf, "region"), "students": students}, path, fmt="xlsx")
    return rounded(workbook.read_workbook(spark, path, students.schema, "students"))


@register("read_back_weekly_workbook")
def q_read_back_weekly_workbook(spark, sf):
    """The weekly table from the first sheet of a workbook, its columns found by
    the header and its weeks as the text of the marketing table."""
    path = _new_path(spark, "weekly") + ".xlsx"
    weekly = fx.weekly(spark, sf)
    sinks.write_report({"weekly": weekly.withColumn("week", F.date_format("week", "dd.MM.yy")),
                        "dates": weekly}, path, fmt="xlsx")
    return rounded(readers.read_weekly(spark, path, date_col="week", fmt="xlsx"))


# ---------------------------------------------------------------- descriptive, encoders
from ..functions import scalar as sc  # noqa: E402


@register("churn_crosstab")
def q_churn_crosstab(spark, sf):
    return rounded(qa.proportion_crosstab(survival_input(spark, sf), "Store_Type_Variety", "Churn"))


CORR_COLS = ["Frequency", "Monetary_Value", "AVG_Ticket", "STD_Ticket", "PL_ratio",
             "AVG_Discount", "Purchase_Months"]


@register("correlation_matrix")
def q_correlation_matrix(spark, sf):
    return rounded(qa.correlation_matrix(cu.churn_customers(fx.transactions(spark, sf)), CORR_COLS))


IMPUTE_COLS = ["Teacher_Quality", "Parental_Education_Level", "Distance_from_Home"]


@register("mode_impute")
def q_mode_impute(spark, sf):
    s = blank_to_null(fx.students(spark, sf))
    return qa.mode_impute(s, IMPUTE_COLS).select("student_id", *IMPUTE_COLS)


@register("kde_by_churn")
def q_kde_by_churn(spark, sf):
    s = survival_input(spark, sf).join(
        cu.churn_customers(fx.transactions(spark, sf)).select("id_customer", "Monetary_Value"),
        "id_customer")
    return rounded(qa.kde(s, "Monetary_Value", "Churn", qa.even_grid(s, "Monetary_Value", 50)))


@register("kde_by_churn_smooth")
def q_kde_by_churn_smooth(spark, sf):
    s = survival_input(spark, sf).join(
        cu.churn_customers(fx.transactions(spark, sf)).select("id_customer", "Monetary_Value"),
        "id_customer")
    grid = qa.even_grid(s, "Monetary_Value", 50)
    return rounded(qa.kde(s, "Monetary_Value", "Churn", grid, adjust=1.5))


@register("qq_points")
def q_qq_points(spark, sf):
    c = cu.rfm_customers(cu.drop_sales_anomaly(fx.transactions(spark, sf)))
    return rounded(qa.qq_points(c, "AVG_Ticket"))


ITEMS4 = ["D12_1", "D12_2", "D12_3", "D12_4"]


@register("minmax_index")
def q_minmax_index(spark, sf):
    s = sc.minmax_scale_0_100(fx.survey_items(spark, sf), ITEMS4)
    return rounded(s.select("respondent", *[f"{c}_index" for c in ITEMS4]))


@register("zscore_items")
def q_zscore_items(spark, sf):
    s = sc.zscore(fx.survey_items(spark, sf), ITEMS4, suffix="_z")
    return rounded(s.select("respondent", *[f"{c}_z" for c in ITEMS4]))


@register("encode_students")
def q_encode_students(spark, sf):
    s = blank_to_null(fx.students(spark, sf))
    s = (s.withColumn("Motivation_Code", sc.ordinal_encode("Motivation_Level", fx.LEVELS_LMH))
         .withColumn("Teacher_Code", sc.ordinal_encode("Teacher_Quality", fx.LEVELS_LMH))
         .withColumn("Distance_Code", sc.ordinal_encode("Distance_from_Home", fx.DISTANCE))
         .withColumn("Internet_Yes", sc.binary_encode("Internet_Access", "Yes"))
         .withColumn("Gender_Male", sc.binary_encode("Gender", "Male")))
    s = sc.one_hot(s, "Motivation_Level", fx.LEVELS_LMH)
    s = sc.label_encode(s, "Parental_Education_Level", "Education_Code")
    return s.select("student_id", "Motivation_Code", "Teacher_Code", "Distance_Code",
                    "Internet_Yes", "Gender_Male", "Motivation_Level_Low",
                    "Motivation_Level_Medium", "Education_Code")


@register("parse_text_fields")
def q_parse_text_fields(spark, sf):
    tx = fx.transactions(spark, sf)
    cents = F.round(F.col("PL_gross_sales") * 100).cast("bigint")
    text = tx.select(
        "id_customer", "date",
        F.concat((cents / 100).cast("bigint").cast("string"), F.lit(","),
                 F.lpad((cents % 100).cast("string"), 2, "0")).alias("pl_text"),
        F.when(F.col("number_item_PL") % 11 == 0, F.lit("n/a"))
        .otherwise(F.col("number_item_PL").cast("string")).alias("items_text"))
    return rounded(text.select("id_customer", "date", "pl_text",
                               sc.parse_decimal_comma("pl_text").alias("PL_gross_sales"),
                               sc.to_int_or_null("items_text").alias("number_item_PL")))


def cpi_by_year(spark, sf):
    """A price index per year derived from order values (input of P16)."""
    o = fx.table(spark, sf, "orders")
    overall = o.agg(F.avg("o_totalprice").alias("__mu"))
    return (o.groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("__m"))
            .crossJoin(overall).select("year", (F.col("__m") / F.col("__mu") * 100).alias("cpi")))


@register("inflation_adjust")
def q_inflation_adjust(spark, sf):
    w = fx.weekly(spark, sf).withColumn("year", F.year("week"))
    out = sc.inflation_adjust(w, "sales", "year", cpi_by_year(spark, sf), 1998, out="sales_adj")
    return rounded(out.select("week", "sales", "sales_adj"))


@register("window_merge_features")
def q_window_merge_features(spark, sf):
    w = sc.window_dates(fx.weekly(spark, sf), "week", "1996-01-01", "1999-12-31")
    return rounded(w.select("week", sc.merge_features(["spend_URGENT", "spend_HIGH"]).alias("spend_top"),
                            sc.square(F.datediff("week", F.lit("1996-01-01").cast("date")) / 7)
                            .alias("trend_sq"),
                            sc.interaction("spend_URGENT", "spend_LOW").alias("urgent_x_low")))


@register("stratify_by_score")
def q_stratify_by_score(spark, sf):
    parts = sc.stratify_by_score(fx.students(spark, sf), "Exam_Score",
                                 {"low": (900.0, 1399.99), "high": (1400.0, 2100.0)})
    outs = [d.agg(F.count(F.lit(1)).alias("rows"), F.avg("Exam_Score").alias("mean_score"))
            .withColumn("stratum", F.lit(k)) for k, d in parts.items()]
    return rounded(sc.union_by_name(outs))


@register("union_segments")
def q_union_segments(spark, sf):
    r = _kept(spark, sf)
    u = sc.union_by_name([r.super_.select("id_customer", "anomaly"),
                          r.regular.select("id_customer", "Customer_Segment")])
    return u


# ---------------------------------------------------------------- linear and mixed models
from ..operators import linear as lm  # noqa: E402
from ..operators import loess as lo  # noqa: E402
from ..operators import mixed as mx  # noqa: E402

STUDENT_NUM = ["Attendance", "Hours_Studied", "Sleep_Hours", "Previous_Scores"]
STUDENT_FAC = ["Motivation_Level", "Internet_Access", "Gender", "Teacher_Quality"]
STUDENT_INT = [("Teacher_Quality", "Internet_Access"), ("Hours_Studied", "Gender")]


def student_table(spark, sf):
    s = qa.mode_impute(blank_to_null(fx.students(spark, sf)), IMPUTE_COLS)
    return s.withColumn("Log_Exam_Score", F.log1p("Exam_Score"))


def student_design(spark, sf, keep=()):
    return lm.design(student_table(spark, sf), "Log_Exam_Score", STUDENT_NUM, STUDENT_FAC,
                     STUDENT_INT, keep=keep)


@register("ols_tidy")
def q_ols_tidy(spark, sf):
    fit = lm.ols_from_gram(lm.gram(student_design(spark, sf)))
    return rounded(lm.tidy(spark, fit))


@register("ols_performance")
def q_ols_performance(spark, sf):
    fit = lm.ols_from_gram(lm.gram(student_design(spark, sf)))
    return rounded(lm.model_performance(spark, fit))


@register("ols_single")
def q_ols_single(spark, sf):
    fit, d, g = lm.ols_fit(fx.students(spark, sf), "Exam_Score", ["Hours_Studied"])
    r2 = 1 - fit.rss / fit.tss
    rows = [(nm, float(b), r2) for nm, b in zip(fit.names, fit.beta)]
    return rounded(spark.createDataFrame(rows, "term string, estimate double, r2 double"))


@register("residual_table")
def q_residual_table(spark, sf):
    st = fx.students(spark, sf)
    fit, d, _ = lm.ols_fit(st.select("student_id", "Exam_Score", "Hours_Studied"), "Exam_Score",
                           ["Hours_Studied"])
    d2 = lm.design(st, "Exam_Score", ["Hours_Studied"], keep=["student_id"])
    return rounded(lm.residual_table(fit, d2).select("student_id", "fitted", "residual",
                                                     "sqrt_abs_resid"))


@register("breusch_pagan_single")
def q_breusch_pagan_single(spark, sf):
    fit, d, _ = lm.ols_fit(fx.students(spark, sf), "Exam_Score", ["Hours_Studied"])
    bp = lm.breusch_pagan(fit, d)
    return rounded(spark.createDataFrame([(bp["statistic"], bp["dof"])], "statistic double, dof int"))


@register("breusch_pagan")
def q_breusch_pagan(spark, sf):
    d = student_design(spark, sf)
    fit = lm.ols_from_gram(lm.gram(d))
    a = lm.breusch_pagan(fit, d)
    rows = [("all_regressors", a["statistic"], a["dof"], a["p_value"])]
    return rounded(spark.createDataFrame(rows, "form string, statistic double, dof int, p_value double"))


@register("vif")
def q_vif(spark, sf):
    g = lm.gram(student_design(spark, sf))
    return rounded(spark.createDataFrame(lm.vif(g), "term string, gvif double, df int, gvif_adj double"))


@register("binned_trend")
def q_binned_trend(spark, sf):
    d = student_design(spark, sf)
    fit = lm.ols_from_gram(lm.gram(d))
    return rounded(lm.binned_trend(lm.residual_table(fit, d), "fitted", "sqrt_abs_resid", 20))


@register("loess")
def q_loess(spark, sf):
    st = fx.students(spark, sf).filter("Attendance is not null and Exam_Score is not null")
    return rounded(lo.loess(st, "Attendance", "Exam_Score", frac=0.6, points=25).select(
        "x", F.col("smooth").alias("smooth_fitted")))


@register("loess_scale_location")
def q_loess_scale_location(spark, sf):
    d = student_design(spark, sf)
    fit = lm.ols_from_gram(lm.gram(d))
    return rounded(lo.loess(lm.residual_table(fit, d).select("fitted", "sqrt_abs_resid").persist(),
                            "fitted", "sqrt_abs_resid", frac=0.6, points=50).select(
        F.col("x").alias("fitted"), F.col("smooth").alias("smooth_resid")))


@register("backward_select")
def q_backward_select(spark, sf):
    g = lm.gram(student_design(spark, sf))
    fit, dropped = lm.backward_select(g)
    rows = [(t, "kept", None) for t in dict.fromkeys(fit.terms)] + [(t, "dropped", p) for t, p in dropped]
    return rounded(spark.createDataFrame(rows, "term string, status string, p_value double"))


def _age_knots(spark, sf):
    return lm.natural_spline_knots(fx.survey_regression(spark, sf), "AGE", 3)


@register("natural_spline_basis")
def q_natural_spline_basis(spark, sf):
    s = fx.survey_regression(spark, sf)
    cols = lm.natural_spline_cols(F.col("AGE"), _age_knots(spark, sf), "AGE_ns")
    return rounded(s.select("respondent", *[c.alias(n) for n, c in cols]))


def _spline_model(spark, sf):
    s = fx.survey_regression(spark, sf)
    knots = _age_knots(spark, sf)
    extra = lm.natural_spline_cols(F.col("AGE"), knots, "AGE_ns")
    d = lm.design(s, "DLIT", [], ["SEX", "REGION", "PROFESSION"], extra=extra, keep=["AGE"])
    return lm.ols_from_gram(lm.gram(d)), d, knots


@register("spline_tidy")
def q_spline_tidy(spark, sf):
    fit, _, _ = _spline_model(spark, sf)
    return rounded(lm.tidy(spark, fit))


@register("spline_effect")
def q_spline_effect(spark, sf):
    fit, d, knots = _spline_model(spark, sf)
    return rounded(lm.spline_effect(spark, fit, d, "AGE", knots, "AGE_ns", 18, 87))


def _mixed(spark, sf):
    d = student_design(spark, sf, keep=["Parental_Education_Level"])
    return mx.mixed_fit(d, "Parental_Education_Level"), d


@register("mixed_fit")
def q_mixed_fit(spark, sf):
    m, _ = _mixed(spark, sf)
    return rounded(mx.mixed_tidy(spark, m))


def _mixed_selection(spark, sf, test):
    d = student_design(spark, sf, keep=["Parental_Education_Level"])
    _, dropped, kept = mx.backward_select_mixed(
        mx.mixed_sums(d, "Parental_Education_Level"), test=test)
    rows = [(i + 1, *t, "dropped") for i, t in enumerate(dropped)]
    rows += [(None, t, *kept[t], "kept") for t in kept]
    return rounded(spark.createDataFrame(
        rows, "step int, term string, statistic double, dof int, p_value double, status string"))


@register("backward_select_mixed")
def q_backward_select_mixed(spark, sf):
    return _mixed_selection(spark, sf, "wald")


@register("backward_select_mixed_lrt")
def q_backward_select_mixed_lrt(spark, sf):
    return _mixed_selection(spark, sf, "chisq")


@register("likelihood_ratio")
def q_likelihood_ratio(spark, sf):
    m, d = _mixed(spark, sf)
    red = mx.reduced_ols(d)
    lr = mx.likelihood_ratio(m.loglik, red.loglik)
    return rounded(spark.createDataFrame([(m.loglik, red.loglik, lr["statistic"], lr["dof"], lr["p_value"])],
                                         "loglik_full double, loglik_reduced double, statistic double, "
                                         "dof int, p_value double"))


@register("nakagawa_r2")
def q_nakagawa_r2(spark, sf):
    m, d = _mixed(spark, sf)
    r = mx.nakagawa_r2(m, d)
    return rounded(spark.createDataFrame([tuple(r.values())], ", ".join(f"{k} double" for k in r)))


@register("mixed_residuals")
def q_mixed_residuals(spark, sf):
    m, d = _mixed(spark, sf)
    return rounded(mx.mixed_residuals(m, d, "Parental_Education_Level")
                   .select("Parental_Education_Level", "group_effect", "fitted", "residual"))


# ---------------------------------------------------------------- MLlib models
from ..operators import boosting as bo  # noqa: E402
from ..operators import forest as fo  # noqa: E402
from ..operators import models as md  # noqa: E402

CHURN_NUM = ["Frequency", "Monetary_Value", "AVG_item_PL_per_transaction", "PL_ratio",
             "AVG_Discount", "Purchase_Months", "STD_Ticket"]
CHURN_FAC = ["Final_Segment", "Store_Type_Variety"]
CHURN_SCALED = ["Frequency", "Monetary_Value", "AVG_item_PL_per_transaction", "STD_Ticket"]


def churn_model_table(spark, sf):
    return memo((spark.sparkContext.applicationId, sf, "churn_table"),
                lambda: _churn_model_table(spark, sf))


def _churn_model_table(spark, sf):
    # three steps read the transactions and the scaling reads the customers
    # twice: both are made once, and let go when the table is there
    tx = keep(fx.transactions(spark, sf))
    c0 = cu.churn_customers(tx)
    cust = ch.customer_churn(c0, ch.churn_flags(tx, 31, cu.first_date(c0)))
    seg = _kept(spark, sf, tx).regular.select("id_customer",
                                              F.col("Customer_Segment").alias("Final_Segment"))
    c = ch.attach_segment(cust, seg)
    # the models and their scoring read the table in many places: no plan goes along
    c = settled(keep(c.select("id_customer", "Churn", *CHURN_NUM, *CHURN_FAC).dropna()))
    table = settled(packed(sc.zscore(c, CHURN_SCALED)))
    c.unpersist()
    tx.unpersist()
    return table


def churn_design(spark, sf, part=None):
    t = churn_model_table(spark, sf)
    if part == "train":
        t = t.where(ev.unit_hash("id_customer") < 0.8)
    elif part == "test":
        t = t.where(ev.unit_hash("id_customer") >= 0.8)
    lv = {f: lm._levels(churn_model_table(spark, sf), f) for f in CHURN_FAC}
    return lm.design(t, "Churn", CHURN_NUM, CHURN_FAC, levels=lv, keep=["id_customer"])


@register("logit_fit")
def q_logit_fit(spark, sf):
    _, tidy, _ = md.logit_fit(spark, churn_design(spark, sf))
    return rounded(tidy)


@register("logit_metrics")
def q_logit_metrics(spark, sf):
    d = churn_design(spark, sf)
    model, _, st_ = md.logit_fit(spark, d)
    auc = ev.roc_auc(md.predict_prob(model, d)).first()["auc"]
    return rounded(spark.createDataFrame(
        [(st_["deviance"], st_["null_deviance"], st_["pseudo_r2"], st_["aic"], st_["n"], float(auc))],
        "deviance double, null_deviance double, pseudo_r2 double, aic double, n long, auc double"))


@register("logit_threshold_sweep")
def q_logit_threshold_sweep(spark, sf):
    d = churn_design(spark, sf)
    model, _, _ = md.logit_fit(spark, d)
    sw = ev.threshold_sweep(md.predict_prob(model, d))
    return rounded(sw)


def _test_rates(model, d):
    # three measures read the scores: every row is scored once
    pr = keep(md.predict_prob(model, d))
    return ev.rates(ev.confusion(pr, t=0.5)).crossJoin(ev.log_loss(pr)).crossJoin(ev.roc_auc(pr))


@register("rf_classify")
def q_rf_classify(spark, sf):
    model = md.rf_classify(churn_design(spark, sf, "train"), trees=40)
    return rounded(_test_rates(model, churn_design(spark, sf, "test")))


@register("rf_importance")
def q_rf_importance(spark, sf):
    d = churn_design(spark, sf, "train")
    return rounded(md.feature_importance(spark, md.rf_classify(d, trees=40), d))


@register("gbt_classify")
def q_gbt_classify(spark, sf):
    model = md.gbt_classify(churn_design(spark, sf, "train"))
    return rounded(_test_rates(model, churn_design(spark, sf, "test")))


@register("gbt_logloss_rounds")
def q_gbt_logloss_rounds(spark, sf):
    tr, te = churn_design(spark, sf, "train"), churn_design(spark, sf, "test")
    model = md.gbt_classify(tr)
    a, b = md.logloss_by_round(model, tr), md.logloss_by_round(model, te)
    return rounded(spark.createDataFrame([(i + 1, x, y) for i, (x, y) in enumerate(zip(a, b))],
                                         "round int, train_loss double, test_loss double"))


def _boosted(spark, sf):
    """150 rounds on the training part, with the scores of both parts."""
    return memo(("boosted", sf), lambda: bo.fit(
        churn_design(spark, sf, "train"), bo.Boosting(), "id_customer", churn_design(spark, sf, "test")))


@register("boost_logloss_rounds")
def q_boost_logloss_rounds(spark, sf):
    return rounded(spark.createDataFrame(_boosted(spark, sf)[0].losses,
                                         "round int, train_loss double, test_loss double"))


@register("boost_classify")
def q_boost_classify(spark, sf):
    pr = _boosted(spark, sf)[1].filter("test").select("label", "score")
    return rounded(ev.rates(ev.confusion(pr, t=0.439)).crossJoin(ev.log_loss(pr)).crossJoin(ev.roc_auc(pr)))


@register("boost_importance")
def q_boost_importance(spark, sf):
    return rounded(bo.gain_importance(spark, _boosted(spark, sf)[0]))


@register("boost_root_gains")
def q_boost_root_gains(spark, sf):
    st = fx.students(spark, sf).withColumn("passed", (F.col("Exam_Score") >= 55).cast("int"))
    d = lm.design(st, "passed", STUDENT_RF_NUM, keep=["student_id"])
    # bins enough for every distinct value
    got = bo.root_gains(d, bo.Boosting(bins=4096), "student_id")
    return rounded(got.select("Variable", "cut", F.col("gain").alias("gain_stat")))


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    d = churn_design(spark, sf, "train")
    model = md.rf_classify(d, trees=40)
    return rounded(md.permutation_importance(spark, model, churn_design(spark, sf, "test"),
                                             "id_customer"))


@register("partial_dependence")
def q_partial_dependence(spark, sf):
    d = churn_design(spark, sf, "train")
    model = md.rf_classify(d, trees=40)
    return rounded(md.partial_dependence(model, d, "PL_ratio", 50))


STUDENT_RF_NUM = ["Attendance", "Hours_Studied", "Sleep_Hours", "Previous_Scores"]


def student_rf_design(spark, sf, part=None):
    t = student_table(spark, sf)
    if part == "train":
        t = t.where(ev.unit_hash("student_id", 5) < 0.8)
    elif part == "test":
        t = t.where(ev.unit_hash("student_id", 5) >= 0.8)
    lv = {f: lm._levels(student_table(spark, sf), f) for f in STUDENT_FAC}
    return lm.design(t, "Exam_Score", STUDENT_RF_NUM, STUDENT_FAC, levels=lv, keep=["student_id"])


@register("rf_regress")
def q_rf_regress(spark, sf):
    tr, te = student_rf_design(spark, sf, "train"), student_rf_design(spark, sf, "test")
    train = fo.rows_of(tr, "student_id")
    asked = train.unionByName(fo.rows_of(te, "student_id"))
    got = fo.votes(train, tr.cols, [fo.Forest(500, 4)], score=asked, per_tree=False)
    by = train.select("id", F.lit("train").alias("sample")).unionByName(
        fo.rows_of(te, "student_id").select("id", F.lit("test").alias("sample")))
    p = got.join(asked.select("id", "y"), "id").join(by, "id").select(
        "y", (F.col("total") / F.col("trees")).alias("prediction"),
        F.when(F.col("oob"), "out of bag").otherwise(F.col("sample")).alias("sample")).persist()
    return rounded(reduce(DataFrame.unionByName, [
        ev.regression_metrics(p.filter(F.col("sample") == s), "y", "prediction").withColumn(
            "sample", F.lit(s)) for s in ("train", "test", "out of bag")]))


@register("tune_mtry")
def q_tune_mtry(spark, sf):
    d = student_rf_design(spark, sf, "train")
    got = fo.tune(fo.rows_of(d, "student_id", fold=5), d.cols, (2, 4, 6, 8, 10), 5, fo.Forest(500))
    return rounded(got.groupBy("mtry").agg(F.avg("rmse").alias("cv_rmse")))


def _churn_forest(spark, sf, trees=40):
    """The classification forest's design and rows (M6: 40 trees, square root
    of the number of features a split)."""
    d = churn_design(spark, sf, "train")
    rows = memo(("churn_forest_rows", sf), lambda: fo.rows_of(d, "id_customer").persist())
    return d, rows, fo.Forest(trees, int(len(d.cols) ** 0.5))


@register("rf_oob_error")
def q_rf_oob_error(spark, sf):
    d, rows, forest = _churn_forest(spark, sf)
    cast = fo.votes(rows, d.cols, [forest]).filter("oob").select(
        "id", "tree", (F.col("prediction") > 0.5).cast("int").alias("vote"))
    return rounded(fo.oob_error(cast, rows))


@register("rf_oob_importance")
def q_rf_oob_importance(spark, sf):
    d, rows, forest = _churn_forest(spark, sf)
    other, terms = fo.permuted(rows, d)
    cast = fo.votes(rows, d.cols, [forest], variants=other, labelled=True)
    return rounded(fo.oob_importance(cast, rows, terms))


@register("oob_error_given")
def q_oob_error_given(spark, sf):
    # the lines of an order are the votes of as many trees on it
    cast = fx.table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).cast("int").alias("tree")).agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("vote"))
    labels = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 150000).cast("int").alias("y"))
    return rounded(fo.oob_error(cast, labels))


SCORES = ["Recency_Score", "Frequency_Score", "Monetary_Score"]


@register("kmeans_elbow")
def q_kmeans_elbow(spark, sf):
    return rounded(md.kmeans_elbow(spark, _kept(spark, sf).regular, SCORES))


def _final_segments(spark, sf):
    r = _kept(spark, sf)
    clustered = md.kmeans_assign(r.regular, SCORES, k=3)
    named = sg.name_clusters(clustered, "Cluster", SCORES)
    return sg.final_segments(named, sg.trim_super(r.super_))


@register("final_segments")
def q_final_segments(spark, sf):
    return _final_segments(spark, sf).groupBy("Final_Segment").agg(F.count(F.lit(1)).alias("customers"))


@register("cluster_summary")
def q_cluster_summary(spark, sf):
    return rounded(sg.cluster_summary(_final_segments(spark, sf)))


@register("cluster_summary_by_segment")
def q_cluster_summary_by_segment(spark, sf):
    return rounded(sg.cluster_summary(_kept(spark, sf).regular, by="Customer_Segment"))


@register("silhouette_segments")
def q_silhouette_segments(spark, sf):
    return rounded(md.silhouette(_kept(spark, sf).regular, SCORES, "Customer_Segment")
                   .withColumn("quality", sc.quality_word("silhouette")))


@register("silhouette_kmeans")
def q_silhouette_kmeans(spark, sf):
    c = md.kmeans_assign(_kept(spark, sf).regular, SCORES, k=3)
    return rounded(md.silhouette(c, SCORES, "Cluster").withColumn("quality", sc.quality_word("silhouette")))


@register("pca_loadings")
def q_pca_loadings(spark, sf):
    load, evr = md.pca(spark, _kept(spark, sf).regular, SCORES, 2)
    ev_wide = evr.groupBy().pivot("component").agg(F.first("explained_variance"))
    ev_wide = ev_wide.select(*[F.col(c).alias(f"{c}_explained_variance") for c in ev_wide.columns])
    return rounded(load.crossJoin(ev_wide))


@register("pca_scores")
def q_pca_scores(spark, sf):
    return rounded(md.pca_scores(_kept(spark, sf).regular.select("id_customer", *SCORES), SCORES, 2))


# ---------------------------------------------------------------- marketing mix
from ..operators import budget as bu  # noqa: E402
from ..operators import mix as mm  # noqa: E402
from ..operators import mix_search as ms  # noqa: E402
from ..operators import trend as tr  # noqa: E402

CHANNEL_ORDER = sorted(fx.CHANNELS)          # 1-URGENT ... 5-LOW


def mix_params(spark):
    """Per-channel carry-over and saturation parameters of the mix queries:
    θ from half-lives 1..5 weeks, α and γ stepping through their ranges."""
    rows = [(c, mm.half_life_theta(i + 1, inverse=True), 0.5 + 0.5 * i, 0.3 + 0.15 * i)
            for i, c in enumerate(CHANNEL_ORDER)]
    return spark.createDataFrame(rows, "channel string, theta double, alpha double, gamma double")


def weekly_grid(spark, sf):
    return mm.fill_grid(fx.weekly_long(spark, sf), ["channel"], "week", "spend")


def adstocked(spark, sf):
    w = weekly_grid(spark, sf).join(F.broadcast(mix_params(spark)), "channel")
    return mm.adstock_geometric(w, ["channel"], "week", "spend", "theta")


@register("adstock_geometric")
def q_adstock_geometric(spark, sf):
    return rounded(adstocked(spark, sf))


@register("saturation_hill")
def q_saturation_hill(spark, sf):
    a = adstocked(spark, sf).join(F.broadcast(mix_params(spark)), "channel")
    return rounded(mm.saturation_hill(a, ["channel"], "adstock", "alpha", "gamma")
                   .select("channel", "week", "saturated"))


def competitor_grp(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select(F.date_trunc("week", "l_shipdate").cast("date").alias("week"),
                     (F.col("l_suppkey") % 3).alias("competitor"), F.col("l_quantity").alias("grp"))


@register("median_weekly")
def q_median_weekly(spark, sf):
    return rounded(mm.median_weekly(competitor_grp(spark, sf), ["week", "competitor"], "grp"))


@register("competitor_adstock")
def q_competitor_adstock(spark, sf):
    m = mm.median_weekly(competitor_grp(spark, sf), ["week", "competitor"], "grp")
    m = mm.fill_grid(m, ["competitor"], "week", "median")   # a week without rows still decays
    return rounded(mm.adstock_geometric(m, ["competitor"], "week", "median", 0.5))


@register("trend_season_holiday")
def q_trend_season_holiday(spark, sf):
    w = fx.weekly(spark, sf).select("week", "sales")
    out = mm.holiday_join(mm.trend_season(w), mm.holiday_calendar(w))
    return rounded(out)


@register("trend_changes")
def q_trend_changes(spark, sf):
    return rounded(tr.trend_changes(fx.weekly(spark, sf).select("week", "sales"), "sales").select(
        "week", F.col("trend").alias("trend_fitted"), F.col("season").alias("season_fitted"), "fitted",
        F.col("slope_change").alias("slope_change")))


@register("time_split")
def q_time_split(spark, sf):
    return mm.time_split(fx.weekly(spark, sf).select("week"), "week", 0.7)


# Parameter ranges per channel, in the order of the first five
# paid channels of the reference configuration (theta, alpha, gamma) plus the
# train share.
THETA_RANGES = [(0.8, 0.99), (0.7, 0.95), (0.8, 0.99), (0.1, 0.3), (0.1, 0.3)]
GAMMA_RANGES = [(0.3, 0.99), (0.3, 0.99), (0.3, 0.99), (0.3, 1.0), (0.3, 1.0)]
ALPHA_RANGE, TRAIN_RANGE = (0.5, 3.0), (0.5, 0.8)
# The search: iterations of every trial.
SEARCH_ITERATIONS, SEARCH_TRIALS = 2000, 5


def mix_ranges():
    r = {}
    for i, c in enumerate(CHANNEL_ORDER):
        r[f"{c}_theta"] = THETA_RANGES[i]
        r[f"{c}_alpha"] = ALPHA_RANGE
        r[f"{c}_gamma"] = GAMMA_RANGES[i]
    r["train_size"] = TRAIN_RANGE
    return r


def search_candidates(spark):
    return mm.candidate_params(spark, mix_ranges(), SEARCH_ITERATIONS, seed=7, trials=SEARCH_TRIALS)


@register("candidate_params")
def q_candidate_params(spark, sf):
    """The candidates with the inflexion point each gives on every channel's
    weekly spend."""
    spend = weekly_grid(spark, sf).groupBy().pivot("channel", CHANNEL_ORDER).agg(
        F.min("spend").alias("mn"), F.max("spend").alias("mx"))
    out = search_candidates(spark).crossJoin(F.broadcast(spend))
    return rounded(out.select(
        "candidate", "trial", "iteration", *[F.col(c).alias(mm.safe_name(c)) for c in mix_ranges()],
        *[((1 - F.col(f"{c}_gamma")) * F.col(f"{c}_mn") + F.col(f"{c}_gamma") * F.col(f"{c}_mx"))
          .alias(f"{mm.safe_name(c)}_inflexion") for c in CHANNEL_ORDER]))


def mix_fitter(spark, sf):
    w = fx.weekly(spark, sf).select("week", "sales")
    tgt = mm.holiday_join(mm.trend_season(w), mm.holiday_calendar(w))
    return mm.candidate_fitter(weekly_grid(spark, sf), CHANNEL_ORDER, tgt, lam=0.1,
                               train_share_col="train_size",
                               controls=[c for c in tgt.columns if c not in ("week", "sales")])


def fitted_candidates(spark, sf):
    return memo((spark.sparkContext.applicationId, sf, "mix_fit"),
                lambda: mix_fitter(spark, sf)(search_candidates(spark)).persist())


@register("adaptive_search")
def q_adaptive_search(spark, sf):
    """As many iterations as the independent draws, in generations; the loss
    weighs fit and spend share alike."""
    out = ms.adaptive_search(spark, mix_ranges(), mix_fitter(spark, sf), F.col("nrmse") + F.col("decomp_rssd"),
                             size=100, generations=SEARCH_ITERATIONS // 100, trials=SEARCH_TRIALS, seed=7)
    return rounded(out.select("candidate", "trial", "iteration", "generation", "nrmse", "decomp_rssd",
                              F.col("loss").alias("loss_value")))


@register("fit_candidates")
def q_fit_candidates(spark, sf):
    return rounded(fitted_candidates(spark, sf))


@register("pareto_fronts")
def q_pareto_fronts(spark, sf):
    return rounded(mm.pareto_fronts(fitted_candidates(spark, sf)))


ROI_COLS = [f"roi_{mm.safe_name(c)}" for c in CHANNEL_ORDER]


@register("cluster_models")
def q_cluster_models(spark, sf):
    p = mm.pareto_fronts(fitted_candidates(spark, sf))
    return rounded(mm.cluster_models(p, ROI_COLS, k=3)
                   .select("candidate", "nrmse", "decomp_rssd", "cluster", "best_in_cluster"))


def model_table(spark, sf):
    """Arithmetic (error, RSSD) per candidate derived from the customer keys:
    the input of the exact Pareto / convergence checks."""
    c = fx.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("candidate"),
                    ((F.col("c_custkey") * 37 % 101) / 101.0).alias("nrmse"),
                    ((F.col("c_custkey") * 53 % 97) / 97.0).alias("decomp_rssd"),
                    (F.col("c_custkey") % 5).cast("int").alias("trial"),
                    (F.col("c_custkey") / 5).cast("long").alias("iteration"))


@register("pareto_fronts_given")
def q_pareto_fronts_given(spark, sf):
    return rounded(mm.pareto_fronts(model_table(spark, sf)))


@register("convergence")
def q_convergence(spark, sf):
    return rounded(mm.convergence(model_table(spark, sf)))


@register("select_model")
def q_select_model(spark, sf):
    return rounded(mm.select_model(model_table(spark, sf), 42))


def mix_coefs(spark):
    rows = [(c, 0.001 * (i + 1)) for i, c in enumerate(CHANNEL_ORDER)]
    return spark.createDataFrame(rows, "channel string, coef double")


def mix_effects(spark, sf):
    a = adstocked(spark, sf).withColumnRenamed("adstock", "x")
    e = mm.decompose(a, mix_coefs(spark))
    sp = weekly_grid(spark, sf).groupBy("channel").agg(F.sum("spend").alias("spend"))
    return e, sp, a


@register("decompose")
def q_decompose(spark, sf):
    e, _, _ = mix_effects(spark, sf)
    return rounded(e)


@register("roi")
def q_roi(spark, sf):
    e, sp, _ = mix_effects(spark, sf)
    return rounded(mm.roi(e, sp))


@register("decomp_rssd")
def q_decomp_rssd(spark, sf):
    e, sp, _ = mix_effects(spark, sf)
    return rounded(mm.decomp_rssd(e.join(sp, "channel")))


# Five interacting pairs: one channel with two partners, another with three.
CHANNEL_PAIRS = [(CHANNEL_ORDER[0], CHANNEL_ORDER[4]), (CHANNEL_ORDER[0], CHANNEL_ORDER[3]),
                 (CHANNEL_ORDER[3], CHANNEL_ORDER[1]), (CHANNEL_ORDER[3], CHANNEL_ORDER[2]),
                 (CHANNEL_ORDER[1], CHANNEL_ORDER[4])]


@register("base_incremental")
def q_base_incremental(spark, sf):
    e, _, _ = mix_effects(spark, sf)
    return rounded(mm.base_incremental(e, fx.weekly(spark, sf)))


@register("conditional_roi")
def q_conditional_roi(spark, sf):
    e, sp, a = mix_effects(spark, sf)
    pairs = spark.createDataFrame([(x, y, 1e-9) for x, y in CHANNEL_PAIRS], "a string, b string, coef double")
    pe = mm.pair_effects(a, pairs)
    return rounded(mm.conditional_roi(e, pe, sp))


@register("nrmse")
def q_nrmse(spark, sf):
    a = adstocked(spark, sf).join(F.broadcast(mix_coefs(spark)), "channel")
    pred = a.groupBy("week").agg(F.sum(F.col("coef") * F.col("adstock")).alias("pred"))
    w = fx.weekly(spark, sf).select("week", "sales").join(pred, "week")
    return rounded(mm.nrmse(w, "sales", "pred"))


def response_curves(spark, sf):
    """Per-channel response curves derived from the weekly data."""
    w = weekly_grid(spark, sf)
    avg_sales = fx.weekly(spark, sf).agg(F.avg("sales").alias("__s"))
    cur = w.groupBy("channel").agg(F.avg("spend").alias("current"))
    idx = spark.createDataFrame([(c, i) for i, c in enumerate(CHANNEL_ORDER)], "channel string, i int")
    return (cur.join(F.broadcast(idx), "channel").crossJoin(avg_sales)
            .select("channel", "current",
                    (F.col("__s") * (F.col("i") + 1) / 15.0).alias("beta"),
                    (0.5 + 0.5 * F.col("i")).alias("alpha"),
                    (F.col("current") * (0.6 + 0.2 * F.col("i"))).alias("inflexion")))


@register("marginal_roas")
def q_marginal_roas(spark, sf):
    return rounded(mm.marginal_roas(response_curves(spark, sf)))


@register("allocate_budget")
def q_allocate_budget(spark, sf):
    return rounded(mm.allocate_budget(response_curves(spark, sf), 0.7, 1.5))


@register("optimise_budget")
def q_optimise_budget(spark, sf):
    return rounded(bu.optimise_budget(response_curves(spark, sf), 0.7, 1.5).withColumnRenamed(
        "slope", "slope_response"))


@register("budget_scenarios")
def q_budget_scenarios(spark, sf):
    return rounded(mm.budget_scenarios(response_curves(spark, sf), 0.7, 1.5))


# ---------------------------------------------------------------- survey scores
from ..operators import survey as sv_  # noqa: E402

SURVEY_BLOCKS = {"DLIT": [f"D12_{i}" for i in range(1, 7)],
                 "HLIT": [f"D12_{i}" for i in range(7, 11)],
                 "DSS": [f"D12_{i}" for i in range(11, 17)],
                 "EHS": [f"D12_{i}" for i in range(17, 21)]}
SURVEY_MODES = {"DLIT": "A", "HLIT": "A", "DSS": "B", "EHS": "B"}
SURVEY_PATHS = [("DLIT", "DSS"), ("HLIT", "EHS")]


def _pls(spark, sf):
    return memo((spark.sparkContext.applicationId, sf, "pls"),
                lambda: sv_.pls_fit(fx.survey_items(spark, sf), SURVEY_BLOCKS, SURVEY_MODES,
                                    SURVEY_PATHS))


@register("pls_fit")
def q_pls_fit(spark, sf):
    outer, _ = sv_.pls_tables(spark, _pls(spark, sf))
    return rounded(outer)


@register("pls_paths")
def q_pls_paths(spark, sf):
    _, inner = sv_.pls_tables(spark, _pls(spark, sf))
    return rounded(inner)


@register("construct_scores")
def q_construct_scores(spark, sf):
    return rounded(sv_.construct_scores(fx.survey_items(spark, sf), _pls(spark, sf), "respondent"))


@register("score_index")
def q_score_index(spark, sf):
    s = sv_.construct_scores(fx.survey_items(spark, sf), _pls(spark, sf), "respondent")
    out = sc.minmax_scale_0_100(s, list(SURVEY_BLOCKS))
    return rounded(out.select("respondent", *[f"{b}_index" for b in SURVEY_BLOCKS]))


@register("construct_r2")
def q_construct_r2(spark, sf):
    s = sv_.construct_scores(fx.survey_items(spark, sf), _pls(spark, sf), "respondent")
    return rounded(sv_.construct_r2(s, SURVEY_PATHS))


@register("cronbach_alpha")
def q_cronbach_alpha(spark, sf):
    return rounded(sv_.cronbach_alpha(fx.survey_items(spark, sf), SURVEY_BLOCKS))


@register("bootstrap_pls")
def q_bootstrap_pls(spark, sf):
    boot = sv_.bootstrap_pls(fx.survey_items(spark, sf), "respondent", SURVEY_BLOCKS,
                             SURVEY_MODES, SURVEY_PATHS, n_boot=5000)
    return rounded(sv_.bootstrap_summary(boot))


@register("bootstrap_summary_given")
def q_bootstrap_summary_given(spark, sf):
    ev_ = fx.table(spark, sf, "events").select(F.col("event_type").alias("parameter"),
                                               F.col("value").alias("estimate"))
    return rounded(sv_.bootstrap_summary(ev_))


@register("vif_items")
def q_vif_items(spark, sf):
    items = [f"D12_{i}" for i in range(1, 21)]
    g = lm.gram(lm.design(fx.survey_items(spark, sf), "D12_1", items[1:]))
    return rounded(spark.createDataFrame(lm.vif(g), "term string, gvif double, df int, gvif_adj double"))


@register("pls_consistent")
def q_pls_consistent(spark, sf):
    c = sv_.pls_consistent(_pls(spark, sf))
    why = c["reason"].get
    rows = [(b, "rho_a", None, float(v), why(b) if v <= 0 else None) for b, v in c["rho_a"].items()]
    rows += [(b, "path_coef", a, v, why(b)) for (a, b), v in c["path_coefs"].items()]
    rows += [(b, "r2", None, v, why(b)) for b, v in c["r2"].items()]
    return rounded(spark.createDataFrame(rows, "construct string, measure string, source string, "
                                         "estimate double, reason string"))


# ---------------------------------------------------------------- covariance structure model
from ..operators import covariance as cs  # noqa: E402


def _covariance(spark, sf):
    return memo((spark.sparkContext.applicationId, sf, "covariance"),
                lambda: cs.covariance_fit(fx.survey_answers(spark, sf, SURVEY_BLOCKS), SURVEY_BLOCKS, SURVEY_PATHS))


@register("covariance_fit")
def q_covariance_fit(spark, sf):
    return rounded(cs.covariance_table(spark, _covariance(spark, sf)))


@register("covariance_measures")
def q_covariance_measures(spark, sf):
    rows = list(cs.covariance_measures(_covariance(spark, sf)).items())
    return rounded(spark.createDataFrame(rows, "measure string, estimate double"))


@register("covariance_scores")
def q_covariance_scores(spark, sf):
    return rounded(cs.covariance_scores(fx.survey_answers(spark, sf, SURVEY_BLOCKS), _covariance(spark, sf),
                                        "respondent"))


@register("bootstrap_covariance")
def q_bootstrap_covariance(spark, sf):
    boot = cs.bootstrap_covariance(fx.survey_answers(spark, sf, SURVEY_BLOCKS), "respondent",
                                   _covariance(spark, sf), n_boot=5000)
    return rounded(sv_.bootstrap_summary(boot))


@register("bootstrap_sums")
def q_bootstrap_sums(spark, sf):
    """The weighted sums of the first replicates, before any fit."""
    out = sv_.bootstrap_moments(fx.survey_items(spark, sf), "respondent", ["D12_1", "D12_2"], n_boot=50)
    names = {"w": "total", "s0": "coef_s1", "s1": "coef_s2", "c0_0": "coef_s11", "c0_1": "coef_s12", "c1_1": "coef_s22"}
    return rounded(sc.rename_columns(out, names))


# ---------------------------------------------------------------- whole-table ranks, column helpers
@register("rank_customers")
def q_rank_customers(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(rk.rank_rows(c, [F.desc("c_acctbal"), F.col("c_custkey")]))


@register("top_with_ties")
def q_top_with_ties(spark, sf):
    p = fx.table(spark, sf, "part").select("p_partkey", "p_size")
    return rk.top_n_with_ties(p, 17, ["p_size"], descending=True)


@register("chosen_columns")
def q_chosen_columns(spark, sf):
    c = fx.table(spark, sf, "customer")
    have = sc.keep_existing(c, ["c_acctbal", "c_income", "c_custkey", "c_name", "c_mktsegment"])
    return rounded(sc.rename_columns(sc.exclude_columns(c.select(*have), ["c_name", "c_age"]),
                                     {"c_custkey": "id_customer", "c_acctbal": "balance"}))


# ---------------------------------------------------------------- scores from given weights
GIVEN_WEIGHTS = {b: [round(0.2 + 0.05 * i, 2) for i in range(len(items))] for b, items in SURVEY_BLOCKS.items()}


def _given_scores(spark, sf):
    items = [c for b in SURVEY_BLOCKS.values() for c in b]
    answers = fx.survey_answers(spark, sf, SURVEY_BLOCKS)
    _, mean, sd = sv_.corr_from_moments(*sv_.item_moments(answers, items))
    m = sv_.PlsModel(SURVEY_BLOCKS, SURVEY_MODES, SURVEY_PATHS, GIVEN_WEIGHTS, {}, {}, {},
                     dict(zip(items, mean)), dict(zip(items, sd)), 0)
    return sv_.construct_scores(answers, m, "respondent")


@register("construct_scores_given")
def q_construct_scores_given(spark, sf):
    scores = _given_scores(spark, sf)
    return rounded(sc.rename_columns(scores, {b: f"score_{b}" for b in SURVEY_BLOCKS}))


@register("score_index_given")
def q_score_index_given(spark, sf):
    out = sc.minmax_scale_0_100(_given_scores(spark, sf), list(SURVEY_BLOCKS))
    return rounded(out.select("respondent", *[F.col(f"{b}_index").alias(f"score_{b}_index") for b in SURVEY_BLOCKS]))


@register("construct_r2_given")
def q_construct_r2_given(spark, sf):
    return rounded(sv_.construct_r2(_given_scores(spark, sf), SURVEY_PATHS))
