"""Adaptive search for marketing-mix models (X6, X7) by differential evolution.

Every trial keeps a population of candidates. In each generation a member moves
towards its trial's best member and along the difference of two others, keeps
some of its old parameters, and is replaced if the new candidate fits better.
All members of all trials are fitted side by side; generations follow one
another. The state between them, a few rows per trial, is a table written in
the shared folder, so a lost executor costs one generation at most, and all
draws are hashes of (generation, member, parameter): the same search anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .evaluate import unit_hash
from .mix import candidate_params

STEP, CROSS = 0.7, 0.8  # how far a member moves, and how many parameters move


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _inside(x: Column, lo: float, hi: float) -> Column:
    """Values beyond a bound are reflected, at most back to the other bound."""
    back = F.when(x < lo, 2 * lo - x).when(x > hi, 2 * hi - x).otherwise(x)
    return F.least(F.greatest(back, F.lit(lo)), F.lit(hi))


def offspring(population: DataFrame, ranges: Mapping[str, tuple[float, float]], size: int,
              trials: int, generation: int, seed: int) -> DataFrame:
    """The next candidates of a population (``trial, slot, loss`` and the
    parameters): one per member."""
    names = list(ranges)
    best = population.groupBy("trial").agg(F.min_by(
        F.struct(*[F.col(f"`{n}`") for n in names]), F.struct("loss", "slot")).alias("best"))
    mate = population.select("trial", F.col("slot").alias("mate"), F.struct(
        *[F.col(f"`{n}`") for n in names]).alias("at"))
    # ids no earlier generation had
    fresh = (F.lit(generation) * size + F.col("slot")) * trials + F.col("trial")
    salt = seed * 1000 + 500

    def other(k: int) -> Column:
        # one of the members but itself; the second also skips the first
        return F.floor(unit_hash("candidate", salt + k) * (size - 1)).cast("int")
    own = population.select(*population.columns, fresh.cast("long").alias("candidate"))
    drawn = own.withColumns({"r1": other(1), "r2": other(2)}).withColumns({
        "r1": F.col("r1") + (F.col("r1") >= F.col("slot")).cast("int"),
        "r2": F.col("r2") + (F.col("r2") >= F.col("slot")).cast("int")})
    both = (drawn.join(mate.withColumnRenamed("mate", "r1").withColumnRenamed("at", "a"), ["trial", "r1"])
            .join(mate.withColumnRenamed("mate", "r2").withColumnRenamed("at", "b"), ["trial", "r2"])
            .join(best, "trial"))
    forced = F.floor(unit_hash("candidate", salt + 3) * len(names))  # one parameter always moves
    x = {n: F.col(f"`{n}`") for n in names}
    both = both.withColumn("forced", forced).withColumns({
        f"to{j}": x[n] + STEP * (F.col("best").getField(n) - x[n])
        + STEP * (F.col("a").getField(n) - F.col("b").getField(n)) for j, n in enumerate(names)}).withColumns({
            f"moves{j}": (unit_hash("candidate", salt + 10 + j) < CROSS) | (F.col("forced") == j)
            for j in range(len(names))})
    moved = [F.when(F.col(f"moves{j}"), _inside(F.col(f"to{j}"), lo, hi)).otherwise(x[n]).alias(n)
             for j, (n, (lo, hi)) in enumerate(ranges.items())]
    return both.select("candidate", "trial", (F.lit(generation) * size + F.col("slot")).cast("long").alias(
        "iteration"), "slot", *moved)


def adaptive_search(spark: SparkSession, ranges: Mapping[str, tuple[float, float]],
                    fit: Callable[[DataFrame], DataFrame], loss: Column, size: int = 50,
                    generations: int = 40, trials: int = 5, seed: int = 0) -> DataFrame:
    """All candidates of a search: parameters, what ``fit`` says of each, its
    ``loss`` (an expression over the columns of ``fit``, the smaller the
    better; null or NaN never wins) and ``generation``.

    ``size`` members per trial (three at least); ``size`` x ``generations``
    iterations per trial in all.
    """
    if size < 3:
        raise ValueError("a population needs three members")
    folder = f"{shared_folder(spark)}/cohortia-search-{uuid4().hex}"
    names = list(ranges)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, size * trials // 4))
    members = candidate_params(spark, ranges, size, seed, trials).withColumn(
        "slot", F.col("iteration").cast("int"))
    population, every = None, []
    for g in range(generations):
        members = members.repartition(tasks, "candidate")
        fitted = fit(members).drop("trial", "iteration").withColumn(
            "loss", F.when(F.isnan(loss) | loss.isNull(), F.lit(float("inf"))).otherwise(loss.cast("double")))
        done = _written(members.join(fitted, "candidate").withColumn("generation", F.lit(g)), folder, f"tried-{g}")
        every.append(done)
        new = done.select("trial", "slot", "loss", "candidate", *[F.col(f"`{n}`") for n in names])
        if population is not None:
            # of old and new the better one, the old one if they are even
            order = F.struct("loss", "candidate")
            new = population.unionByName(new).groupBy("trial", "slot").agg(F.min_by(F.struct(
                "loss", "candidate", *[F.col(f"`{n}`") for n in names]), order).alias("m")).select(
                "trial", "slot", "m.*")
        population = _written(new, folder, f"population-{g}")
        if g + 1 < generations:
            members = offspring(population.drop("candidate"), ranges, size, trials, g + 1, seed)
    return reduce(DataFrame.unionByName, every).drop("slot")
