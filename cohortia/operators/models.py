"""MLlib-backed models (M1-M3, M5-M8, M28, C6-C9); forests with out-of-bag votes and
full depth are in ``forest``, second-order boosting in ``boosting``.

Features are assembled once per model from the same design builder as the
linear models (treatment-coded factors with readable names). Training runs
in MLlib; scoring, importances and evaluation stay DataFrame operations.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import ordered_prefix_sums
from ..session import keep, packed, settled
from .evaluate import unit_hash53
from .linear import Design


def assemble(d: Design, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=d.cols, outputCol=out, handleInvalid="skip").transform(d.df)


# ---------------------------------------------------------------- logistic
def logit_fit(spark: SparkSession, d: Design):
    """M1: unpenalised logistic regression (binomial GLM, IRLS)."""
    data = assemble(d).withColumn("label", F.col(d.y).cast("double"))
    glr = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features",
                                      labelCol="label", maxIter=50, regParam=0.0)
    model = glr.fit(data)
    s = model.summary
    names = [*d.names, "Intercept"]
    coefs = [*model.coefficients.toArray().tolist(), model.intercept]
    rows = [(nm, float(b), float(se), float(z), float(p), float(math.exp(b)))
            for nm, b, se, z, p in zip(names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues)]
    tidy = spark.createDataFrame(rows, "term string, estimate double, std_error double, "
                                 "statistic double, p_value double, odds_ratio double")
    stats = {"deviance": float(s.deviance), "null_deviance": float(s.nullDeviance),
             "pseudo_r2": pseudo_r2(s.deviance, s.nullDeviance), "aic": float(s.aic),
             "n": int(s.numInstances)}
    return model, tidy, stats


def pseudo_r2(deviance: float, null_deviance: float) -> float:
    """M2: 1 − deviance / null deviance."""
    return float(1 - deviance / null_deviance) if null_deviance else float("nan")


def odds_ratios(tidy: DataFrame) -> DataFrame:
    """M3: exp of each coefficient."""
    return tidy.select("term", F.exp("estimate").alias("odds_ratio"))


def predict_prob(model, d: Design, keep: Sequence[str] = ()) -> DataFrame:
    """M5: probability per row as a plain double column."""
    out = scored(model, assemble(d))
    p = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*keep, F.col(d.y).cast("int").alias("label"), p.alias("score"))


# ---------------------------------------------------------------- trees
DEPTH = 30      # the deepest trees MLlib grows
BOOST_ROWS = 25_000
NODES_A_JOB = 250_000   # of a forest that scores rows


def rf_classify(d: Design, trees: int = 40, seed: int = 42, max_depth: int = DEPTH):
    """M6: random forest, sqrt(p) features per split, fully grown trees.

    Rows keep the node they have come to: else every task of every level gets
    all trees grown so far, which takes longer than the level itself.
    """
    data = assemble(d).withColumn("label", F.col(d.y).cast("double"))
    rf = RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", seed=seed,
                                maxDepth=max_depth, labelCol="label", cacheNodeIds=True)
    return rf.fit(data)


def _tree_jobs(model) -> list[list]:
    """The trees of a large forest, ``NODES_A_JOB`` nodes or one tree at a time;
    nothing for another model or a forest that may go out whole. A task unpacks
    all nodes its job sends for itself, and a full forest is as large as its table."""
    if not isinstance(model, RandomForestClassificationModel) or model.totalNumNodes <= NODES_A_JOB:
        return []
    jobs, nodes = [], 0
    for tree in model.trees:
        if not jobs or nodes + tree.numNodes > NODES_A_JOB:
            jobs.append([])
            nodes = 0
        jobs[-1].append(tree)
        nodes += tree.numNodes
    return jobs


def _add_votes(trees: list, data: DataFrame, votes: Sequence[str]) -> DataFrame:
    """``data`` with the class shares of the trees' leaves added to ``votes``, as the forest does it."""
    names = [f"__p{k}" for k in range(len(trees))]
    for name, tree in zip(names, trees):
        data = tree.setRawPredictionCol("").setPredictionCol("").setProbabilityCol(name).transform(data)
    shares = [vector_to_array(name) for name in names]
    return data.withColumns({v: sum((p[k] for p in shares), F.col(v)) for k, v in enumerate(votes)}).drop(*names)


def scored(model, data: DataFrame) -> DataFrame:
    """``data`` with the ``prediction`` (and ``probability``) of the model. The
    trees of a large forest vote in several jobs, each on the rows that the one
    before has written with its votes; sums and ties are those of the forest."""
    jobs = _tree_jobs(model)
    if not jobs:
        return model.transform(data)
    votes = [f"__v{k}" for k in range(model.numClasses)]
    out = data.withColumns({v: F.lit(0.0) for v in votes})
    for number, trees in enumerate(jobs):
        before, out = out, settled(keep(_add_votes(trees, out, votes)))
        if number:
            before.unpersist()
    every, most = sum(F.col(v) for v in votes[1:]) + F.col(votes[0]), F.greatest(*votes)
    return out.withColumns({
        "probability": array_to_vector(F.array(*[F.col(v) / every for v in votes])),
        "prediction": F.array_position(F.array(*votes), most).cast("double") - 1}).drop(*votes)


def gbt_classify(d: Design, rounds: int = 150, depth: int = 6, rate: float = 0.1,
                 subsample: float = 0.8, colsample: str = "0.8", seed: int = 42):
    """M7: gradient-boosted trees (logistic loss). A round is a job a level: a
    table of some size goes on in partitions of ``BOOST_ROWS`` rows at least
    (MLlib draws rows by partition; smaller tables keep theirs and their draws)."""
    data = assemble(d).withColumn("label", F.col(d.y).cast("double"))
    n = data.count()
    if n >= 2 * BOOST_ROWS:
        data = data.coalesce(min(data.rdd.getNumPartitions(), n // BOOST_ROWS))
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample,
                        featureSubsetStrategy=colsample, seed=seed, labelCol="label")
    return gbt.fit(data)


def logloss_by_round(model, d: Design) -> list[float]:
    """Mean log loss after each boosting round (MLlib reports twice the
    usual binary log loss for GBT; halved here)."""
    data = assemble(d).withColumn("label", F.col(d.y).cast("double"))
    return [x / 2 for x in model.evaluateEachIteration(data)]


def feature_importance(spark: SparkSession, model, d: Design) -> DataFrame:
    """M8: importance per design column, largest first."""
    imp = model.featureImportances.toArray().tolist()
    rows = [(nm, t, float(v)) for nm, t, v in zip(d.names, d.terms, imp)]
    return spark.createDataFrame(rows, "Variable string, term string, Importance double")


def permutation_importance(spark: SparkSession, model, d: Design, id_col: str,
                           threshold: float = 0.5) -> DataFrame:
    """M9: accuracy lost when one column's values are permuted.

    The permutation pairs the i-th row in one hash order with the i-th row
    in another, unrelated one; ranks come from bucketed prefix counts, no
    global window. Every row is joined with its donor once, by shuffles alone;
    the row itself and one variant a term are then scored together, so the
    model, which is as large as its table, leaves the driver once.
    """
    terms = list(dict.fromkeys(d.terms))
    features = list(dict.fromkeys(d.cols))
    ranks = [ordered_prefix_sums(
        d.df.select(id_col, unit_hash53(id_col, salt).alias("__h"), F.lit(1).alias("__one")),
        "__h", ["__one"]).select(id_col, F.col("__one_cum").alias("__rk")) for salt in (1, 2)]
    donor = (d.df.select(id_col, *[F.col(c).alias(f"__p_{c}") for c in features])
             .join(ranks[1].hint("merge"), id_col).drop(id_col))
    paired = d.df.join(ranks[0].hint("merge"), id_col).join(donor.hint("merge"), "__rk")
    variant = F.col("__variant")
    own = {c: [terms.index(t) + 1 for cc, t in zip(d.cols, d.terms) if cc == c] for c in features}
    rows = paired.withColumn("__variant", F.explode(F.sequence(F.lit(0), F.lit(len(terms))))).select(
        variant, *[F.when(variant.isin(own[c]), F.col(f"__p_{c}")).otherwise(F.col(c)).alias(c)
                   if c in own else F.col(c) for c in d.df.columns])
    out = scored(model, assemble(Design(rows, d.y, d.cols, d.names, d.terms)))
    hit = (F.col("prediction") == F.col(d.y).cast("double")).cast("double")
    got = {r["__variant"]: r["hit"] for r in out.groupBy(variant).agg(F.avg(hit).alias("hit")).collect()}
    return spark.createDataFrame([(t, float(got.get(0) - got.get(k))) for k, t in enumerate(terms, 1)],
                                 "Variable string, accuracy_drop double")


def partial_dependence(model, d: Design, col: str, points: int = 50) -> DataFrame:
    """Mean predicted probability with ``col`` set to each grid value.

    The grid (``points`` values from min to max) is broadcast; rows x grid
    is scored in one pass and averaged per grid value. Of a large forest some
    trees are scored and summed per grid value at a time; only these sums,
    ``points`` rows, are added up over the trees.
    """
    c = d.cols[d.names.index(col)]
    mm = d.df.agg(F.min(c).alias("__mn"), F.max(c).alias("__mx"))
    grid = (d.df.sparkSession.range(points).crossJoin(mm)
            .select((F.col("__mn") + (F.col("__mx") - F.col("__mn")) * F.col("id") / (points - 1))
                    .alias("grid_value")))
    rows = d.df.crossJoin(F.broadcast(grid)).withColumn(c, F.col("grid_value"))
    data, jobs = assemble(Design(rows, d.y, d.cols, d.names, d.terms)), _tree_jobs(model)
    if jobs:
        spark, votes, sums = d.df.sparkSession, ["__v0", "__v1"], []
        for trees in jobs:
            part = _add_votes(trees, data.withColumns({v: F.lit(0.0) for v in votes}), votes)
            sums += part.groupBy("grid_value").agg(F.avg("__v1").alias("share")).collect()
        return spark.createDataFrame(sums, "grid_value double, share double").groupBy("grid_value").agg(
            (F.sum("share") / model.getNumTrees).alias("partial_dependence"))
    out = model.transform(data)
    prob = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.groupBy("grid_value").agg(F.avg(prob).alias("partial_dependence"))


# ---------------------------------------------------------------- clustering
def _weighted_points(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct points with their counts (k-means on 3 scores sees ≤ 27)."""
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("w"))
            .transform(lambda x: VectorAssembler(inputCols=list(cols), outputCol="features")
                       .transform(x)))


def kmeans_best(df: DataFrame, cols: Sequence[str], k: int, starts: int = 20, seed: int = 123,
                points: DataFrame | None = None):
    """K-means keeping the lowest cost over ``starts`` seeds, fitted on
    weighted distinct points (same cost as on all rows); ``points``: those of
    ``df``, persisted, if the caller has them."""
    pts = points if points is not None else packed(_weighted_points(df, cols))

    def one(s):
        m = KMeans(k=k, seed=seed + s, weightCol="w", maxIter=100, tol=1e-9).fit(pts)
        return s, m, m.summary.trainingCost

    # restarts are independent jobs; the scheduler runs them side by side
    with ThreadPoolExecutor(max_workers=min(starts, 8)) as pool:
        fits = sorted(pool.map(one, range(starts)), key=lambda x: x[0])
    best = None
    for _, m, cost in fits:
        if best is None or cost < best[1] - 1e-9:
            best = (m, cost)
    if points is None:
        pts.unpersist()
    return best


def kmeans_elbow(spark: SparkSession, df: DataFrame, cols: Sequence[str], ks=range(1, 11),
                 starts: int = 20, seed: int = 42) -> DataFrame:
    """Within-cluster sum of squares per k (best of ``starts``);
    k = 1 is the total sum of squares, one aggregate."""
    rows, points = [], packed(_weighted_points(df, cols))
    for k in ks:
        if k == 1:
            tss = df.agg(sum(F.var_pop(c) * F.count(F.lit(1)) for c in cols)).first()[0]
            rows.append((1, float(tss)))
        else:
            rows.append((k, float(kmeans_best(df, cols, k, starts, seed, points)[1])))
    points.unpersist()
    return spark.createDataFrame(rows, "k int, wss double")


def kmeans_assign(df: DataFrame, cols: Sequence[str], k: int = 3, starts: int = 20, seed: int = 123,
                  out: str = "Cluster") -> DataFrame:
    model, _ = kmeans_best(df, cols, k, starts, seed)
    v = VectorAssembler(inputCols=list(cols), outputCol="__f").transform(df)
    return model.setFeaturesCol("__f").setPredictionCol(out).transform(v).drop("__f")


def silhouette(df: DataFrame, cols: Sequence[str], label: str, max_points: int = 20_000) -> DataFrame:
    """Mean silhouette width (Euclidean), exact, over distinct points
    weighted by their counts: a(i) excludes the point itself once.

    Compares all distinct points (score lattices have few), one side sent to
    every task: more than ``max_points`` raise ``ValueError``. On continuous
    data use ``ClusteringEvaluator`` instead.
    """
    pts = df.groupBy(label, *cols).agg(F.count(F.lit(1)).alias("w"))
    if pts.limit(max_points + 1).count() > max_points:
        raise ValueError(f"more than {max_points} distinct points; use ClusteringEvaluator")
    a = pts.select(*[F.col(c).alias(f"a_{c}") for c in cols], F.col(label).alias("la"),
                   F.col("w").alias("wa"))
    b = pts.select(*[F.col(c).alias(f"b_{c}") for c in cols], F.col(label).alias("lb"),
                   F.col("w").alias("wb"))
    dist = F.sqrt(sum((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in cols))
    pair = a.crossJoin(F.broadcast(b)).withColumn("d", dist)
    sizes = pts.groupBy(label).agg(F.sum("w").alias("n")).withColumnRenamed(label, "lb")
    per = (pair.groupBy(*[f"a_{c}" for c in cols], "la", "wa", "lb")
           .agg(F.sum(F.col("d") * F.col("wb")).alias("sd"))
           .join(F.broadcast(sizes), "lb"))
    same = F.col("la") == F.col("lb")
    per = per.withColumn("avg_d", F.when(same, F.try_divide(F.col("sd"), F.col("n") - 1))
                         .otherwise(F.col("sd") / F.col("n")))
    ab = per.groupBy(*[f"a_{c}" for c in cols], "la", "wa").agg(
        F.max(F.when(same, F.col("avg_d"))).alias("ai"),
        F.min(F.when(~same, F.col("avg_d"))).alias("bi"),
        F.max(F.when(same, F.col("n"))).alias("own"))
    s = F.when(F.col("own") <= 1, F.lit(0.0)).otherwise(
        F.try_divide(F.col("bi") - F.col("ai"), F.greatest("ai", "bi")))
    return ab.agg((F.sum(s * F.col("wa")) / F.sum("wa")).alias("silhouette"))


def _pca_fit(df: DataFrame, cols: Sequence[str], k: int):
    """Scaler and PCA models and the signed loadings (columns x k)."""
    v = VectorAssembler(inputCols=list(cols), outputCol="__f").transform(df.select(*cols).dropna())
    sc = StandardScaler(inputCol="__f", outputCol="__z", withMean=True, withStd=True).fit(v)
    m = PCA(k=k, inputCol="__z", outputCol="__pc").fit(sc.transform(v))
    load = np.array(m.pc.toArray(), copy=True)
    for j in range(k):
        if load[np.argmax(np.abs(load[:, j])), j] < 0:
            load[:, j] *= -1
    return sc, m, load


def pca(spark: SparkSession, df: DataFrame, cols: Sequence[str], k: int = 2):
    """Principal components of the standardised columns; each
    component's sign makes its largest loading positive."""
    _, m, load = _pca_fit(df, cols, k)
    rows = [(c, *[float(load[i, j]) for j in range(k)]) for i, c in enumerate(cols)]
    loadings = spark.createDataFrame(rows, "variable string, " + ", ".join(f"PC{j + 1} double" for j in range(k)))
    ev = spark.createDataFrame([(f"PC{j + 1}", float(x)) for j, x in enumerate(m.explainedVariance)],
                               "component string, explained_variance double")
    return loadings, ev


def pca_scores(df: DataFrame, cols: Sequence[str], k: int = 2) -> DataFrame:
    """Every row with its scores ``PC1`` ... on the components (null where
    a column is null); the components are fitted on the complete rows."""
    sc, _, load = _pca_fit(df, cols, k)
    mean, sd = sc.mean.toArray(), sc.std.toArray()
    z = [(F.col(c) - float(mean[i])) / float(sd[i]) if sd[i] > 0 else F.col(c) * 0.0
         for i, c in enumerate(cols)]
    return df.select("*", *[sum((z[i] * float(load[i, j]) for i in range(1, len(cols))),
                                z[0] * float(load[0, j])).alias(f"PC{j + 1}") for j in range(k)])
