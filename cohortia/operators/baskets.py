"""Basket rules (C13) and ready bundles (C14): strongest pairs, or groups of
items connected by rules.

Frequent itemsets come from MLlib's parallel FP-growth, which never lists
all item pairs of a basket: each basket is cut into conditional
transactions per frequent item and mined per item group. The reference's
limits are strict (support, confidence and lift all '>'), so the model runs
at the given minima and the strict filter follows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import keep


def baskets_to_items(lines: DataFrame, basket: str = "basket_id", item: str = "item") -> DataFrame:
    """One row per basket with its distinct items (partial distinct first)."""
    return (lines.select(basket, item).distinct()
            .groupBy(basket).agg(F.collect_list(item).alias("items")))


def basket_rules(lines: DataFrame, min_support: float = 0.01, min_confidence: float = 0.65,
                 min_lift: float = 1.2, basket: str = "basket_id", item: str = "item",
                 partitions: int | None = None) -> DataFrame:
    """Association rules with support > s, confidence > c and lift > l."""
    items = baskets_to_items(lines, basket, item)
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    if partitions:
        fp = fp.setNumPartitions(partitions)
    model = fp.fit(items)
    rules = model.associationRules
    return rules.where((F.col("support") > min_support) & (F.col("confidence") > min_confidence)
                       & (F.col("lift") > min_lift))


def rule_table(rules: DataFrame) -> DataFrame:
    """All rules, several items on the left side included, as plain columns."""
    return rules.select(F.array_join(F.array_sort("antecedent"), ", ").alias("antecedent"),
                        F.element_at("consequent", 1).alias("consequent"),
                        F.size("antecedent").cast("long").alias("n_antecedent"),
                        "support", "confidence", "lift")


def pair_rules(rules: DataFrame) -> DataFrame:
    """Rules with one item on each side, as plain columns."""
    return (rules.where((F.size("antecedent") == 1) & (F.size("consequent") == 1))
            .select(F.element_at("antecedent", 1).alias("antecedent"),
                    F.element_at("consequent", 1).alias("consequent"),
                    "support", "confidence", "lift"))


def ready_baskets(rules: DataFrame, per_item: int = 1) -> DataFrame:
    """C14: bundles: for each antecedent item the strongest partner(s) by lift
    (then confidence, then name); a bundle lists both items sorted."""
    p = pair_rules(rules)
    w = Window.partitionBy("antecedent").orderBy(F.desc("lift"), F.desc("confidence"),
                                                  F.col("consequent"))
    top = p.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_item).drop("__r")
    return (top.select(F.array_sort(F.array("antecedent", "consequent")).alias("bundle"),
                       "lift", "confidence")
            .groupBy("bundle").agg(F.max("lift").alias("lift"), F.max("confidence").alias("confidence"))
            .select(F.element_at("bundle", 1).alias("item_a"), F.element_at("bundle", 2).alias("item_b"),
                    "lift", "confidence"))


def connected_bundles(rules: DataFrame) -> DataFrame:
    """C14: groups of items connected by one-to-one rules: ``bundle`` (its
    smallest item), ``item``, ``n_items``.

    Labels move along the rules until none changes; the tables hold frequent
    items only (at most mean basket size / minimum support of them).
    """
    p = pair_rules(rules).select(F.col("antecedent").alias("a"), F.col("consequent").alias("b"))
    edges = keep(p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(edges.select(F.col("a").alias("item"), F.col("a").alias("bundle")).distinct())
    while True:
        near = (edges.join(labels, edges.b == labels.item).groupBy(F.col("a").alias("n_item"))
                .agg(F.min("bundle").alias("n_bundle")))
        moved = keep(labels.join(near, F.col("item") == F.col("n_item"), "left").select(
            "item", F.least("bundle", "n_bundle").alias("bundle"),
            (F.col("n_bundle") < F.col("bundle")).alias("__moved")))
        if moved.where("__moved").isEmpty():
            break
        labels = moved.drop("__moved")
    sizes = labels.groupBy("bundle").agg(F.count(F.lit(1)).alias("n_items"))
    return labels.join(sizes, "bundle")
