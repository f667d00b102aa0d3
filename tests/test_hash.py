"""The id hash behind splits, permutations and parameter draws."""
import numpy as np
from pyspark.sql import functions as F

from cohortia.operators.evaluate import unit_hash, unit_hash53
from cohortia.operators.mix import candidate_params
from cohortia.operators.models import permutation_importance
from cohortia.operators.linear import Design


def test_salts_give_unrelated_uniform_orders(spark):
    a = np.array(spark.range(20000).select(*[unit_hash("id", s) for s in range(6)]).collect(), float)
    assert a.min() >= 0 and a.max() < 1
    assert np.abs(np.histogram(a[:, 0], 20, (0, 1))[0] - 1000).max() < 150
    assert np.abs(np.corrcoef(a.T) - np.eye(6)).max() < 0.03
    # inside a hash split the orders stay unrelated, and few ids keep their rank
    part = a[a[:, 0] >= 0.8]
    own = part[:, 1].argsort().argsort() == part[:, 2].argsort().argsort()
    assert own.sum() < 10
    fine = spark.range(200000).select(unit_hash53("id", 1).alias("h"))
    assert fine.agg(F.countDistinct("h")).first()[0] == 200000


def test_candidate_parameters_are_independent(spark):
    ranges = {f"p{j}": (0.0, 1.0) for j in range(8)}
    p = candidate_params(spark, ranges, 2000, seed=7, trials=5).select(*ranges).toPandas().to_numpy()
    assert p.shape == (10000, 8)
    assert np.abs(np.corrcoef(p.T) - np.eye(8)).max() < 0.05
    # pairs fill the unit square, not a line
    cells = np.unique((p[:, 0] * 10).astype(int) * 10 + (p[:, 1] * 10).astype(int))
    assert len(cells) == 100


def test_permutation_importance_finds_the_strong_column(spark):
    class Threshold:
        """Predicts from the first feature alone."""

        def transform(self, df):
            from pyspark.ml.functions import vector_to_array
            return df.withColumn("prediction", (vector_to_array("features")[0] > 0.5).cast("double"))

    df = spark.range(4000).select("id", unit_hash("id", 3).alias("x"), unit_hash("id", 4).alias("z"))
    df = df.withColumn("y", (F.col("x") > 0.5).cast("double"))
    d = Design(df, "y", ["x", "z"], ["x", "z"], ["x", "z"])
    got = {r["Variable"]: r["accuracy_drop"] for r in permutation_importance(
        spark, Threshold(), d, "id").collect()}
    assert 0.45 < got["x"] < 0.55 and got["z"] == 0.0


def test_permutation_importance_scores_in_one_pass_and_as_one_term_at_a_time(spark):
    seen = []

    class Sum:
        def transform(self, df):
            from pyspark.ml.functions import vector_to_array
            seen.append(df)
            v = vector_to_array("features")
            return df.withColumn("prediction", (v[0] + 2 * v[1] - v[2] > 0.8).cast("double"))

    df = spark.range(2000).select("id", *[unit_hash("id", k).alias(f"x{k}") for k in (3, 4, 5)])
    df = df.withColumn("y", F.expr("x3 + 2 * x4 - x5 > 0.9").cast("int"))
    d = Design(df, "y", ["x3", "x4", "x5"], ["x3", "x4", "x5"], ["a", "b", "a"])
    got = {r["Variable"]: r["accuracy_drop"] for r in permutation_importance(spark, Sum(), d, "id").collect()}
    assert len(seen) == 1
    t = df.toPandas()
    rank = [t["id"].map({r["id"]: k for k, r in enumerate(
        df.select("id", unit_hash53("id", s).alias("h")).orderBy("h").collect())}) for s in (1, 2)]
    donor = t.set_index(rank[1].to_numpy()).loc[rank[0].to_numpy()].reset_index(drop=True)
    assert sorted(donor["id"]) == list(range(2000))

    def hit(v):
        return ((v["x3"] + 2 * v["x4"] - v["x5"] > 0.8) == t["y"].astype(bool)).mean()
    for name, cols in (("a", ["x3", "x5"]), ("b", ["x4"])):
        assert got[name] == hit(t) - hit(t.assign(**{c: donor[c] for c in cols}))
