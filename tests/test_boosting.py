"""Second-order boosting against a plain version."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import boosting as bo
from cohortia.operators import linear as lm


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    n = 1200
    x = rng.normal(size=(n, 4)).round(2)
    y = (x[:, 0] + (x[:, 1] > 0.5) + rng.logistic(size=n) > 0).astype(int)
    rows = [(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row long, a double, b double, c double, d double, y int")
    yield df.persist()
    df.unpersist()


def design(df):
    return lm.design(df, "y", ["a", "b", "c", "d"], keep=["row"])


def t(g, alpha):
    return np.sign(g) * max(abs(g) - alpha, 0)


def plain_tree(bins, g, h, p, rows, node, depth, out):
    """Recursive: out[node] = (column, bin) or the leaf's weight."""
    G, H = g[rows].sum(), h[rows].sum()
    best = None
    for j in range(bins.shape[1]) if depth < p.depth else ():
        for cut in np.unique(bins[rows, j])[:-1]:
            left = rows[bins[rows, j] <= cut]
            a, b = g[left].sum(), h[left].sum()
            if b < p.min_child_weight or H - b < p.min_child_weight:
                continue
            gain = (t(a, p.alpha) ** 2 / (b + p.lambda_) + t(G - a, p.alpha) ** 2 / (H - b + p.lambda_)
                    - t(G, p.alpha) ** 2 / (H + p.lambda_))
            if best is None or gain > best[0] + 1e-9:
                best = (gain, j, cut)
    if best is None or best[0] <= p.gamma:
        out[node] = -p.rate * t(G, p.alpha) / (H + p.lambda_)
        return
    _, j, cut = best
    out[node] = (j, int(cut))
    inside = bins[rows, j] <= cut
    plain_tree(bins, g, h, p, rows[inside], 2 * node, depth + 1, out)
    plain_tree(bins, g, h, p, rows[~inside], 2 * node + 1, depth + 1, out)


@pytest.mark.parametrize("options", [{}, {"gamma": 1.0, "alpha": 2.0, "lambda_": 5.0, "min_child_weight": 8.0}])
def test_trees_equal_a_plain_version(spark, table, options):
    d = design(table)
    p = bo.Boosting(rounds=3, depth=4, rate=0.3, subsample=1.0, colsample=1.0, bins=32, **options)
    model, scores = bo.fit(d, p, "row")
    rows = table.orderBy("row").toPandas()
    bins = bo._binned(rows[["a", "b", "c", "d"]].to_numpy(float), model.edges)
    y, margin = rows["y"].to_numpy(), np.zeros(len(rows))
    for tree, (_, loss, none) in zip(model.trees, model.losses):
        share = 1 / (1 + np.exp(-margin))
        want = {}
        plain_tree(bins, share - y, share * (1 - share), p, np.arange(len(y)), 1, 0, want)
        got = {n: s[:2] for n, s in tree.splits.items()} | tree.leaves
        assert set(got) == set(want)
        assert all(got[n] == want[n] if isinstance(want[n], tuple) else abs(got[n] - want[n]) < 1e-9 for n in want)
        margin += tree.margins(bins)
        assert none is None and loss == pytest.approx(np.logaddexp(0, np.where(y > 0, -margin, margin)).mean())
    got = {r["id"]: r["score"] for r in scores.collect()}
    assert np.allclose([got[i] for i in rows["row"]], 1 / (1 + np.exp(-margin)))


def test_many_blocks_give_the_trees_of_one(spark, table, monkeypatch):
    train, test = design(table.filter("row % 4 > 0")), design(table.filter("row % 4 = 0"))
    p = bo.Boosting(rounds=4, depth=3, subsample=0.7, colsample=0.5)
    one, a = bo.fit(train, p, "row", test)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 250)
    monkeypatch.setattr(bo, "CHECKPOINT_ROUNDS", 2)
    used = []
    together = bo._grow_together
    monkeypatch.setattr(bo, "_grow_together", lambda *x: used.append(1) or together(*x))
    many, b = bo.fit(train, p, "row", test)
    assert used and len(one.trees) == len(many.trees) == 4
    for u, v in zip(one.trees, many.trees):
        assert {n: s[:2] for n, s in u.splits.items()} == {n: s[:2] for n, s in v.splits.items()}
        assert u.leaves == pytest.approx(v.leaves)
    assert np.allclose(np.array(one.losses, float), np.array(many.losses, float))
    a, b = ({r["id"]: r["score"] for r in s.collect()} for s in (a, b))
    assert a == pytest.approx(b) and len(a) == 1200


def test_losses_fall_and_models_predict(spark, table):
    train, test = design(table.filter("row % 4 > 0")), design(table.filter("row % 4 = 0"))
    p = bo.Boosting(rounds=60, depth=3)
    model, scores = bo.fit(train, p, "row", test)
    losses = np.array(model.losses, float)
    assert losses.shape == (60, 3) and (np.diff(losses[:, 1]) < 1e-3).all() and losses[-1, 2] < losses[0, 2]
    for turn, tree in enumerate(model.trees):  # one draw of columns per tree
        assert {s[0] for s in tree.splits.values()} <= set(bo._columns(p, 4, turn))
    assert len({tuple(bo._columns(p, 4, turn)) for turn in range(20)}) > 1
    again = {r["row"]: r["score"] for r in bo.predict(model, test, ["row"]).collect()}
    first = {r["id"]: r["score"] for r in scores.filter("test").collect()}
    assert again == pytest.approx(first)
    gains = {r["Variable"]: r["Importance"] for r in bo.gain_importance(spark, model).collect()}
    assert sum(gains.values()) == pytest.approx(1) and min(gains["a"], gains["b"]) > max(gains["c"], gains["d"])


def test_gamma_can_forbid_every_split(spark, table):
    model, scores = bo.fit(design(table), bo.Boosting(rounds=2, gamma=1e9, rate=1.0), "row")
    assert all(not tree.splits and list(tree.leaves) == [1] for tree in model.trees)
    assert scores.select("score").distinct().count() == 1


def test_rows_drawn_anew_for_every_tree():
    keys = np.arange(20000) * 7919
    drawn = np.array([bo._drawn(keys, turn, 1, 0.8) for turn in range(3)])
    assert np.allclose(drawn.mean(1), 0.8, atol=0.01)
    assert np.abs(np.corrcoef(drawn) - np.eye(3)).max() < 0.03


def test_no_rows(spark, table):
    with pytest.raises(ValueError):
        bo.fit(design(table.filter(F.lit(False))), bo.Boosting(rounds=1), "row")


def test_blocks_lie_in_no_more_partitions_than_cores(spark, table, monkeypatch):
    monkeypatch.setattr(bo, "BLOCK_ROWS", 10)
    d = design(table.repartition(64))
    edges = bo.bin_edges(d.df, d.cols, 32)
    blocks = bo._blocks(d, "row", edges, False, 0.0)
    assert blocks.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert blocks.agg(F.sum("n")).first()[0] == 1200
    # merged over many blocks the best split is that of all rows at once
    args = (bo.Boosting(subsample=1.0), 0, bo.Tree(), [1], list(range(4)), 4, 33, True)
    many = bo._best_splits(blocks, *args)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 10_000)
    one = bo._best_splits(bo._blocks(d, "row", edges, False, 0.0), *args)
    a, b = (x[x.node == 1].iloc[0] for x in (many, one))
    assert (a["column"], a["bin"]) == (b["column"], b["bin"]) and a["gain"] == pytest.approx(b["gain"])
    assert many[many.node == -1]["H"].iloc[0] == 1200 and many[many.node == -2]["H"].iloc[0] == 0
