"""Ranks over whole tables, ties at the cut, the bound of the exact silhouette."""
import pytest
from pyspark.sql import functions as F

from cohortia.operators import models as md
from cohortia.operators import ranking as rk


def test_global_rank_equals_sorted_order(spark):
    df = spark.range(0, 5000, numPartitions=7).select("id", (F.col("id") * 7919 % 1000).alias("v"))
    out = rk.rank_rows(df, [F.desc("v"), F.col("id")])
    got = {r.id: r.Rank for r in out.collect()}
    want = sorted(df.collect(), key=lambda r: (-r.v, r.id))
    assert got == {r.id: i for i, r in enumerate(want, 1)}
    assert out.columns == ["id", "v", "Rank"]
    assert rk.rank_rows(df.where("id < 0"), ["v"]).count() == 0


@pytest.mark.parametrize("n", [1, 3, 4, 100])
@pytest.mark.parametrize("descending", [False, True])
def test_top_n_keeps_ties(spark, n, descending):
    rows = [(i, v) for i, v in enumerate([5, 5, 3, 9, 9, 9, None, 1, 3, None])]
    df = spark.createDataFrame(rows, "id int, v int").repartition(3)
    got = {r.id for r in rk.top_n_with_ties(df, n, ["v"], descending=descending).collect()}
    key = {i: (v is None, (-v if descending else v) if v is not None else 0) for i, v in rows}
    assert got == {i for i in key if sum(key[j] < key[i] for j in key) < n}
    grouped = rk.top_n_with_ties(df.withColumn("g", F.lit(1)), n, ["v"], ["g"], descending)
    assert {r.id for r in grouped.collect()} == got


def test_silhouette_refuses_many_points(spark):
    df = spark.range(50).select((F.col("id") % 25).cast("double").alias("x"), (F.col("id") % 2).alias("c"))
    assert md.silhouette(df, ["x"], "c").count() == 1
    with pytest.raises(ValueError, match="distinct points"):
        md.silhouette(df, ["x"], "c", max_points=49)
