"""Ranking and rank merging of variable importances.

Ranks over a whole table come from a range-partitioned sort and the row counts
of its partitions; no window holds all rows. Rank merging works on tables with
one row per model term or variable.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder

MISSING_RANK = 21
LOCAL_ID = (1 << 33) - 1            # the part of Spark's increasing ids that counts within a partition


def rank_rows(df: DataFrame, order: Sequence, by: Sequence[str] = (), name: str = "Rank"
              ) -> DataFrame:
    """1..n after a sort (per group when ``by`` is given).

    Without ``by`` the sorted table is written as a checkpoint, so that the
    partitions numbered are those counted even when an executor is lost; each
    row's number is its place in its partition plus the rows of the partitions
    before (one count a partition).
    """
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    shared_folder(df.sparkSession)                      # sets the checkpoint folder where unset
    placed = (df.orderBy(*order).withColumn("__part", F.spark_partition_id())
              .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL_ID)) + 1).checkpoint())
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (placed.join(F.broadcast(offsets), "__part")
            .withColumn(name, (F.col("__at") + F.col("__before")))
            .select(*df.columns, name))


def top_n_with_ties(df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = (),
                    descending: bool = False) -> DataFrame:
    """Rows whose rank by the columns ``order`` (ties share a rank) is at
    most n; nulls come last. Without ``by`` those are the rows that equal one of
    the first n rows in ``order``: a top-n and a semi join on n keys at most."""
    keys = [(F.desc_nulls_last if descending else F.asc_nulls_last)(c) for c in order]
    if by:
        w = Window.partitionBy(*by).orderBy(*keys)
        return df.withColumn("__rk", F.rank().over(w)).where(F.col("__rk") <= n).drop("__rk")
    first = df.orderBy(*keys).limit(n).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(order)]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(order)]
    return df.join(F.broadcast(first), reduce(lambda a, b: a & b, same), "left_semi")


def rank_logit(coefs: DataFrame, factors: Sequence[str], top: int = 17,
               term: str = "term", estimate: str = "estimate", p: str = "p_value") -> DataFrame:
    """Merge dummy terms into their variable, then rank variables.

    A term containing a factor name counts for that factor; the intercept is
    dropped. Per variable: smallest p-value cut into classes 1-4 at 0.001,
    0.01, 0.05 (right-closed), and the sum of absolute coefficients. Sorted by
    class, then importance (descending); the first ``top`` get ranks 1..n.
    """
    var = F.col(term)
    for f in reversed(list(factors)):
        var = F.when(F.col(term).contains(f), F.lit(f)).otherwise(var)
    t = coefs.where(~F.lower(F.col(term)).isin("intercept", "(intercept)")).withColumn("Variable", var)
    g = t.groupBy("Variable").agg(F.min(p).alias("__minp"),
                                  F.sum(F.abs(F.col(estimate))).alias("Importance"))
    mp = F.col("__minp")
    g = g.withColumn("PValueRank", F.when(mp <= 0.001, 1).when(mp <= 0.01, 2)
                     .when(mp <= 0.05, 3).otherwise(4)).drop("__minp")
    ranked = rank_rows(g, [F.col("PValueRank"), F.desc("Importance"), F.col("Variable")])
    return ranked.where(F.col("Rank") <= top).withColumn("Method", F.lit("Logistic Regression"))


def rank_by_importance(imp: DataFrame, method: str, top: int = 17,
                       var: str = "Variable", value: str = "Importance") -> DataFrame:
    """Ranks 1..top of a (variable, importance) table, largest first."""
    r = rank_rows(imp, [F.desc(value), F.col(var)])
    return r.where(F.col("Rank") <= top).select(
        F.col(var).alias("Variable"), "Rank", F.lit(method).alias("Method"))


def complete_grid(ranks: DataFrame, fill: int = MISSING_RANK) -> DataFrame:
    """Every variable x method pair; a missing rank becomes ``fill``."""
    vs = ranks.select("Variable").distinct()
    ms = ranks.select("Method").distinct()
    grid = vs.crossJoin(F.broadcast(ms))
    return (grid.join(ranks.select("Variable", "Method", "Rank"), ["Variable", "Method"], "left")
            .withColumn("Rank", F.coalesce(F.col("Rank").cast("double"), F.lit(float(fill)))))


def rank_models(ranks: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Mean rank per variable over methods, final rank, and a wide
    table with one rank column per method."""
    full = complete_grid(ranks)
    agg = full.groupBy("Variable").agg(F.avg("Rank").alias("AggregateRank"))
    final = rank_rows(agg, [F.col("AggregateRank"), F.col("Variable")], name="FinalRank")
    wide = full.groupBy("Variable").pivot("Method", list(methods)).agg(F.first("Rank"))
    for m in methods:
        wide = wide.withColumnRenamed(m, m.replace(" ", "_"))
    return wide.join(final, "Variable")
