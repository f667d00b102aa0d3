"""Tables that many short jobs read: few partitions, the same rows."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortia.operators import linear as lm
from cohortia.operators import models as md
from cohortia.plans import catalog
from cohortia.plans.rfm import rfm_segments
from cohortia.session import packed


@pytest.fixture
def wide(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_packed_keeps_rows_in_few_partitions(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(0, 5000, 1, 200)
    for rows, most in ((1, 2 * cores), (1000, 5), (5000, 1)):
        got = packed(df, rows)
        assert got.rdd.getNumPartitions() <= most
        assert sorted(r[0] for r in got.collect()) == list(range(5000))
        got.unpersist()
    empty = packed(df.where("id < 0"), 10)
    assert empty.count() == 0 and empty.rdd.getNumPartitions() == 1
    empty.unpersist()


def test_packed_large_tables_keep_more_partitions(spark):
    df = spark.range(0, 5000, 1, 200)
    for most, parts in ((5000 // 100, 100), (1, 200)):
        got = packed(df, most=most)
        assert got.rdd.getNumPartitions() == max(parts, min(200, 2 * spark.sparkContext.defaultParallelism))
        assert got.count() == 5000
        got.unpersist()


def test_customers_of_the_rfm_chain_are_few_tasks(wide):
    rows = [(c, dt.date(2020, 1, 1) + dt.timedelta(days=(c * 7 + k * (c % 13 + 2)) % 700), 10.0 + c % 50 + k,
             9.0 + c % 50, 0.0, 1, 2, "A") for c in range(400) for k in range(c % 9 + 1)]
    r = rfm_segments(wide.createDataFrame(rows, "id_customer long, date date, gross_sales double, net_sales double, "
                                                "PL_gross_sales double, number_item_PL long, "
                                                "number_items_other long, store_type string"))
    for t in (r.customers, r.kept, r.lapsed, r.super_, r.regular):
        assert t.rdd.getNumPartitions() <= 2 * wide.sparkContext.defaultParallelism < 64
    assert r.customers.count() == 400 == r.kept.count() + r.lapsed.count()
    assert r.kept.count() == r.super_.count() + r.regular.count()


def test_points_of_k_means_are_few_tasks_and_made_once(wide, monkeypatch):
    seen = []
    fit = md.KMeans.fit

    def noted(self, pts, *a):
        seen.append((pts.rdd.getNumPartitions(), pts.count()))
        return fit(self, pts, *a)
    monkeypatch.setattr(md.KMeans, "fit", noted)
    df = wide.createDataFrame([(float(i % 3), float(i % 5)) for i in range(300)], "a double, b double")
    got = {r["k"]: r["wss"] for r in md.kmeans_elbow(wide, df, ["a", "b"], ks=(1, 2, 15), starts=3).collect()}
    assert got[1] == pytest.approx(800) and got[2] < got[1] and got[15] == pytest.approx(0, abs=1e-9)
    assert {n for _, n in seen} == {15}
    assert max(k for k, _ in seen) <= 2 * wide.sparkContext.defaultParallelism < 64


@pytest.fixture
def labelled(wide):
    rows = [(i, float(i * 37 % 101), float(i * 53 % 89), int((i * 37 % 101 > 50) != (i % 7 == 0))) for i in range(600)]
    return lm.design(wide.createDataFrame(rows, "id long, a double, b double, y int").repartition(6), "y", ["a", "b"])


def test_boosting_reads_few_partitions_of_a_large_table_only(labelled, monkeypatch):
    seen = []
    fit = md.GBTClassifier.fit

    def noted(self, data, *a):
        seen.append((data.rdd.getNumPartitions(), data.count()))
        return fit(self, data, *a)
    monkeypatch.setattr(md.GBTClassifier, "fit", noted)
    for least in (200, 301):
        monkeypatch.setattr(md, "BOOST_ROWS", least)
        assert md.gbt_classify(labelled, rounds=2).getNumTrees == 2
    assert seen == [(3, 600), (6, 600)]


def test_forest_rows_keep_their_nodes_and_the_trees_are_the_same(labelled, monkeypatch):
    seen = []
    fit = md.RandomForestClassifier.fit

    def both(self, data, *a):
        seen.append(self.getCacheNodeIds())
        return fit(self, data, *a), fit(self.copy({self.cacheNodeIds: False}), data, *a)
    monkeypatch.setattr(md.RandomForestClassifier, "fit", both)
    got, plain = md.rf_classify(labelled, trees=3)
    assert seen == [True] and got.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]


def test_rates_score_every_row_once(labelled):
    model = md.rf_classify(labelled, trees=3)
    got = catalog._test_rates(model, labelled)
    assert "UDF" not in got._jdf.queryExecution().withCachedData().toString().split("InMemoryRelation")[0]
    r = got.first()
    assert r["TN"] + r["FP"] + r["FN"] + r["TP"] == 600 and r["auc"] > 0.9


def test_churn_table_makes_the_transactions_once(spark, tmp_path, monkeypatch):
    d = str(tmp_path)
    n = 400
    spark.createDataFrame([(k, f"Brand#{k}") for k in range(1, 26)], "p_partkey long, p_brand string"
                          ).write.parquet(f"{d}/part.parquet")
    spark.range(n).selectExpr(
        "id o_orderkey", "id % 40 o_custkey", "timestamp(date_add(date'1997-01-01', int(id * 7 % 700))) o_orderdate",
        "element_at(array('1-URGENT', '5-LOW'), int(id % 2) + 1) o_orderpriority").write.parquet(f"{d}/orders.parquet")
    spark.range(3 * n).selectExpr(
        "id % 400 l_orderkey", "id % 25 + 1 l_partkey", "double(id % 9 + 1) l_quantity",
        "100.0d + id * 13 % 977 l_extendedprice", "0.01d * (id % 10 + 1) l_discount").write.parquet(f"{d}/lineitem.parquet")
    made = []
    make = catalog.fx.transactions
    monkeypatch.setattr(catalog.fx, "transactions", lambda *a: made.append(make(*a)) or made[-1])
    table = catalog.churn_model_table(spark, d)
    assert len(made) == 1 and not made[0].is_cached
    assert table.count() == table.select("id_customer").distinct().count() == 40
    catalog.clear_memo()


def test_churn_table_leaves_its_plan_behind(spark):
    """The driver keeps the plan text of every query, with the plans of the
    persisted tables it reads written out once for each place they are read."""
    rows = catalog.churn_model_table(spark, "/root/testdata/sf0.001")
    assert rows.is_cached
    text = rows.select("id_customer").join(rows, "id_customer").join(
        rows.selectExpr("id_customer", "Churn c"), "id_customer")._jdf.queryExecution().toString()
    assert "Scan ExistingRDD" in text and len(text) < 100_000 and "lineitem" not in text
    catalog.clear_memo()


def test_settled_table_keeps_rows_and_partitions(spark):
    from cohortia.session import keep, settled
    held = keep(spark.range(1000).repartition(5).withColumn("part", F.spark_partition_id()))
    was = held.rdd.glom().map(len).collect()
    got = settled(held)
    assert got.is_cached and not held.is_cached and got.rdd.getNumPartitions() == 5
    assert got.rdd.glom().map(len).collect() == was and got.filter("part <> spark_partition_id()").count() == 0
    assert sorted(r["id"] for r in got.collect()) == list(range(1000))
    got.unpersist()


def _orders(spark, d, n=400):
    """Tables of ``n`` orders of 40 customers."""
    spark.createDataFrame([(k, f"Brand#{k}") for k in range(1, 26)], "p_partkey long, p_brand string"
                          ).write.parquet(f"{d}/part.parquet")
    spark.range(n).selectExpr(
        "id o_orderkey", "id % 40 o_custkey", "timestamp(date_add(date'1997-01-01', int(id * 7 % 700))) o_orderdate",
        "element_at(array('1-URGENT', '5-LOW'), int(id % 2) + 1) o_orderpriority").write.parquet(f"{d}/orders.parquet")
    spark.range(3 * n).selectExpr(
        f"id % {n} l_orderkey", "id % 25 + 1 l_partkey", "double(id % 9 + 1) l_quantity",
        "100.0d + id * 13 % 977 l_extendedprice", "0.01d * (id % 10 + 1) l_discount").write.parquet(f"{d}/lineitem.parquet")
    return d


def test_large_sides_are_not_broadcast_for_the_transactions(spark, tmp_path, monkeypatch):
    """The size of column files says little about the rows the driver would collect."""
    d, got = _orders(spark, str(tmp_path)), []
    for most, broadcast in ((3_000_000, True), (49, False)):
        monkeypatch.setattr(catalog.fx, "BROADCAST_CELLS", most)
        tx = catalog.fx.transactions(spark, d)
        assert ("Broadcast" in tx._jdf.queryExecution().executedPlan().toString()) == broadcast
        got.append(sorted(tx.collect()))
    assert len(got[0]) == 400 and [[pytest.approx(v) if isinstance(v, float) else v for v in r] for r in got[0]] == [
        list(r) for r in got[1]]
    assert "Broadcast" in catalog.fx.not_broadcast(spark.range(49).alias("a"), "merge").join(
        spark.range(10), "id")._jdf.queryExecution().executedPlan().toString()


def test_survival_table_makes_the_transactions_once_and_leaves_its_plan(spark, tmp_path, monkeypatch):
    d, made = _orders(spark, str(tmp_path)), []
    make = catalog.fx.transactions
    monkeypatch.setattr(catalog.fx, "transactions", lambda *a: made.append(make(*a)) or made[-1])
    table = catalog.survival_input(spark, d)
    assert len(made) == 1 and not made[0].drop("PL_gross_sales").is_cached and table.is_cached
    assert table.count() == 40 and "lineitem" not in table._jdf.queryExecution().toString()
    want = catalog.ch.customer_churn(catalog.cu.churn_customers(made[0]), catalog.ch.churn_flags(made[0], 31))
    assert sorted(table.collect()) == sorted(want.select(table.columns).collect())


def test_profile_reads_its_table_once(spark, tmp_path):
    rows = [(float(k % 7), k % 3, None if k % 5 == 0 else f"v{k % 2}") for k in range(50)]
    spark.createDataFrame(rows, "a double, b long, c string").write.parquet(f"{tmp_path}/t.parquet")
    got = catalog.qa.profile(spark.read.parquet(f"{tmp_path}/t.parquet"))
    plan = got._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation") >= 4 and "parquet" not in "".join(
        x for x in plan.splitlines() if "InMemoryRelation" not in x and "FileScan" not in x)
    r = {x["column"]: x for x in got.collect()}
    assert [r[c]["count"] for c in "abc"] == [50, 50, 40] and r["c"]["missing"] == 10 and r["a"]["distinct"] == 7
    assert r["a"]["median"] == 3.0 and r["b"]["q1"] == 0.0 and r["c"]["mode"] == "v0"


def test_a_large_forest_scores_some_trees_at_a_time(labelled, monkeypatch):
    model = md.rf_classify(labelled, trees=5)
    data = md.assemble(labelled)
    probability = md.vector_to_array("probability")
    want = sorted(model.transform(data).select(*labelled.cols, "prediction", probability).collect())
    effect = {r["grid_value"]: r["partial_dependence"] for r in md.partial_dependence(model, labelled, "a", 7).collect()}
    monkeypatch.setattr(md, "NODES_A_JOB", 2 * max(t.numNodes for t in model.trees))
    assert 3 <= len(md._tree_jobs(model)) and sum(map(len, md._tree_jobs(model))) == 5
    got = md.scored(model, data)
    assert "UDF(features" not in got._jdf.queryExecution().toString()
    assert sorted(got.select(*labelled.cols, "prediction", probability).collect()) == want
    parts = {r["grid_value"]: r["partial_dependence"] for r in md.partial_dependence(model, labelled, "a", 7).collect()}
    assert len(parts) == 7 and parts == {k: pytest.approx(v) for k, v in effect.items()}
    r = catalog._test_rates(model, labelled).first()
    assert r["TN"] + r["FP"] + r["FN"] + r["TP"] == 600
