"""Invariants of the composed operators on the shared test tables."""
from pyspark.sql import functions as F

from cohortia.operators import evaluate as ev
from cohortia.operators import segments as sg
from cohortia.operators import survival as sv
from cohortia.plans import catalog as cat
from cohortia.sources import fixtures as fx
from conftest import SF_SMALL, SF_MID


def test_segment_rules_cover_each_triple_once():
    seen = [t for ts in sg.SEGMENT_RULES.values() for t in ts]
    assert len(seen) == len(set(seen)) == 25
    assert {a + b + c for a in "HML" for b in "HML" for c in "HML"} - set(seen) == {"MMH", "LHL"}


def test_km_is_monotone(spark):
    km = cat.q_kaplan_meier(spark, SF_MID).orderBy("time").toPandas()
    s = km["survival"].to_numpy()
    assert (s[1:] <= s[:-1] + 1e-12).all() and s.min() >= 0 and s.max() <= 1


def test_split_is_disjoint_and_complete(spark):
    s = fx.scored_rows(spark, SF_SMALL)
    tr, te = ev.stratified_split(s, 0.8)
    assert tr.count() + te.count() == s.count()
    assert tr.join(te, "row_id").count() == 0
    n = {r["label"]: r["count"] for r in s.groupBy("label").count().collect()}
    got = {r["label"]: r["count"] for r in tr.groupBy("label").count().collect()}
    assert all(abs(got[c] - 0.8 * n[c]) <= 1 for c in n)


def test_split_keeps_the_share_of_small_classes_and_rows_without_class(spark):
    s = spark.createDataFrame([(i, "big" if i % 100 else "rare") for i in range(2000)]
                              + [(5000 + i, None) for i in range(200)], "row_id long, label string")
    tr, te = ev.stratified_split(s, 0.8)
    got = {r["label"]: r["count"] for r in tr.groupBy("label").count().collect()}
    assert abs(got["rare"] - 16) <= 1 and abs(got["big"] - 1584) <= 1 and 140 < got[None] < 180
    assert tr.count() + te.count() == 2200


def test_sweep_rows_and_best(spark):
    sw = ev.threshold_sweep(fx.scored_rows(spark, SF_SMALL)).collect()
    assert [r["threshold"] for r in sw] == ev.threshold_grid()
    assert all(abs(r["accuracy"] + r["aper"] - 1) < 1e-12 for r in sw)


def test_log_rank_matches_two_group_hand_case(spark):
    rows = [(1, 1, "a"), (2, 1, "a"), (3, 0, "a"), (2, 1, "b"), (4, 1, "b"), (5, 0, "b")]
    df = spark.createDataFrame(rows, "t int, e int, g string")
    out = {r["g"]: r for r in sv.log_rank(df, "t", "e", "g").collect()}
    assert out["a"]["observed"] == 2 and out["b"]["observed"] == 2
    assert abs(out["a"]["expected"] + out["b"]["expected"] - 4) < 1e-12
    assert out["a"]["chisq"] >= 0 and 0 <= out["a"]["p_value"] <= 1
