"""Marketing-mix and survey operators against closed forms and brute force."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import mix as mm
from cohortia.operators import survey as sv


def test_adstock_equals_closed_form(spark):
    rng = np.random.default_rng(0)
    rows = []
    for ch, th in (("a", 0.3), ("b", 0.9)):
        x = rng.uniform(0, 100, 40)
        rows += [(ch, t, float(v), th) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "channel string, t int, x double, theta double")
    out = mm.adstock_geometric(df, ["channel"], "t", "x", "theta").orderBy("channel", "t").toPandas()
    for ch, th in (("a", 0.3), ("b", 0.9)):
        sub = out[out.channel == ch]
        x = sub.x.to_numpy()
        want = [sum(x[s] * th ** (t - s) for s in range(t + 1)) for t in range(len(x))]
        assert np.allclose(sub.adstock.to_numpy(), want, rtol=1e-12)


def test_hill_inflexion_point(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (0.0, 5.0, 10.0)], "k int, x double")
    out = mm.saturation_hill(df, ["k"], "x", 2.0, 0.5).orderBy("x").collect()
    assert [round(r["saturated"], 12) for r in out] == [0.0, 0.5, 0.8]


def test_allocation_matches_brute_force_and_bounds(spark):
    rng = np.random.default_rng(4)
    rows = [(f"c{i}", float(rng.uniform(50, 150)), float(rng.uniform(10, 40)),
             float(rng.uniform(0.6, 2.5)), float(rng.uniform(40, 120))) for i in range(3)]
    curves = spark.createDataFrame(rows, "channel string, current double, beta double, alpha double, inflexion double")
    res = mm.allocate_budget(curves, 0.7, 1.5, 20).toPandas().set_index("channel")
    budget = sum(r[1] for r in rows)

    def resp(s, b, a, i):
        return b * s ** a / (s ** a + i ** a)

    unit = budget / 20
    spends = [[0.7 * r[1] + k * unit for k in range(int(0.8 * r[1] / unit) + 1)] for r in rows]
    levels = [[(s, resp(s, *r[2:])) for s in of] for of, r in zip(spends, rows)]
    best = max((c for c in itertools.product(*levels) if sum(s for s, _ in c) <= budget + 1e-6),
               key=lambda c: sum(v for _, v in c))
    assert abs(res["total_response"].iloc[0] - sum(v for _, v in best)) < 1e-9
    for r, (s, _) in zip(rows, best):
        assert abs(res.loc[r[0], "spend_opt"] - s) < 1e-9
        assert 0.7 * r[1] - 1e-9 <= res.loc[r[0], "spend_opt"] <= 1.5 * r[1] + 1e-9
    assert res["spend_opt"].sum() <= budget + 1e-6


def test_allocation_states_stay_on_the_grid_for_many_channels_and_brands(spark):
    rng = np.random.default_rng(5)
    rows = [(b, f"c{i:02d}", float(rng.uniform(50, 150)), float(rng.uniform(10, 40)),
             float(rng.uniform(0.6, 2.5)), float(rng.uniform(40, 120)))
            for b, n in (("x", 12), ("y", 2)) for i in range(n)]
    curves = spark.createDataFrame(
        rows, "brand string, channel string, current double, beta double, alpha double, inflexion double")
    res = mm.allocate_budget(curves, 0.7, 1.5, 50, by=["brand"]).toPandas()
    assert res.groupby("brand").size().to_dict() == {"x": 12, "y": 2}
    for _, g in res.groupby("brand"):
        assert g.spend_opt.sum() <= g.current.sum() * (1 + 1e-9)
        assert abs(g.response_opt.sum() - g.total_response.iloc[0]) < 1e-9
        assert (g.spend_opt >= 0.7 * g.current - 1e-9).all() and (g.spend_opt <= 1.5 * g.current + 1e-9).all()


def test_fit_candidates_matches_a_direct_refit(spark):
    rng = np.random.default_rng(8)
    weeks = 80
    spend = rng.uniform(0, 100, (weeks, 2))
    ctl = np.arange(weeks, dtype=float)
    sales = 50 + 0.5 * ctl + spend[:, 0] + rng.normal(0, 5, weeks)
    long = spark.createDataFrame([(t, c, float(spend[t, k])) for t in range(weeks) for k, c in enumerate("ab")],
                                 "week int, channel string, spend double")
    target = spark.createDataFrame([(t, float(sales[t]), float(ctl[t])) for t in range(weeks)],
                                   "week int, sales double, trend double")
    ranges = {f"{c}_{p}": r for c in "ab" for p, r in
              (("theta", (0.1, 0.9)), ("alpha", (0.5, 3.0)), ("gamma", (0.3, 1.0)))}
    cand = mm.candidate_params(spark, {**ranges, "share": (0.5, 0.8)}, 20, seed=3, trials=2)
    got = mm.fit_candidates(cand, long, ["a", "b"], target, 0.1, "share", ["trend"]).toPandas()
    assert len(got) == 40
    for p in cand.toPandas().sample(3, random_state=1).to_dict("records"):
        cols = []
        for k, c in enumerate("ab"):
            acc, a = 0.0, []
            for v in spend[:, k]:
                acc = v + p[f"{c}_theta"] * acc
                a.append(acc)
            a = np.array(a)
            i = (1 - p[f"{c}_gamma"]) * a.min() + p[f"{c}_gamma"] * a.max()
            cols.append(a ** p[f"{c}_alpha"] / (a ** p[f"{c}_alpha"] + i ** p[f"{c}_alpha"]))
        x = np.column_stack([*cols, ctl])
        n = int(weeks * p["share"])
        b0, b = mm.ridge_signed(x[:n], sales[:n], 0.1, [True, True, False])
        z = (x[:n] - x[:n].mean(0)) / x[:n].std(0)
        free = np.linalg.solve(z.T @ z + 0.1 * n * np.eye(3), z.T @ (sales[:n] - sales[:n].mean()))
        if (free[:2] >= 0).all():
            assert np.allclose(b * x[:n].std(0), free, atol=1e-6)
        yhat = b0 + x @ b
        v = n + (weeks - n) // 2
        row = got[got.candidate == p["candidate"]].iloc[0]
        for name, part in (("nrmse", slice(None)), ("nrmse_train", slice(0, n)),
                           ("nrmse_val", slice(n, v)), ("nrmse_test", slice(v, None))):
            e = sales[part] - yhat[part]
            assert abs(row[name] - np.sqrt((e ** 2).mean()) / np.ptp(sales[part])) < 1e-8


def test_every_holiday_of_the_calendar_is_kept(spark):
    w = spark.createDataFrame([("2024-01-01",), ("2024-05-20",)], "week string").selectExpr("date(week) week")
    cal = spark.createDataFrame([("2024-05-22", "LOCAL DAY")], "ds string, holiday string").selectExpr(
        "date(ds) ds", "holiday")
    out = {str(r["week"]): r["LOCAL DAY"] for r in mm.holiday_join(w, cal).collect()}
    assert out == {"2024-01-01": 0, "2024-05-20": 1}


def test_pareto_front_has_no_dominated_model(spark):
    rng = np.random.default_rng(2)
    pts = rng.uniform(0, 1, (400, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)],
                               "candidate long, nrmse double, decomp_rssd double")
    fr = mm.pareto_fronts(df, fronts=1, buckets=8).toPandas()
    f = fr[["nrmse", "decomp_rssd"]].to_numpy()
    for a in f:
        assert not ((pts[:, 0] <= a[0]) & (pts[:, 1] <= a[1]) & ((pts[:, 0] < a[0]) | (pts[:, 1] < a[1]))).any()
    nd = [i for i, a in enumerate(pts)
          if not ((pts[:, 0] <= a[0]) & (pts[:, 1] <= a[1]) & ((pts[:, 0] < a[0]) | (pts[:, 1] < a[1]))).any()]
    assert sorted(fr.candidate) == nd


def test_ridge_sign_rule():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = 2 * x[:, 0] - 1.5 * x[:, 1] + rng.normal(0, 0.1, 300)
    b0, b = mm.ridge_signed(x, y, 1e-8, [True, True, False])
    assert b[1] == 0.0 and b[0] > 1.5
    _, b_free = mm.ridge_signed(x, y, 1e-8, [False] * 3)
    assert np.allclose(b_free, np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0][1:],
                       atol=1e-4)


@pytest.fixture(scope="module")
def survey_df(spark):
    rng = np.random.default_rng(11)
    n = 800
    f1 = rng.normal(size=n)
    f2 = 0.7 * f1 + np.sqrt(1 - 0.49) * rng.normal(size=n)
    items = np.column_stack([f1 + 0.5 * rng.normal(size=n) for _ in range(4)] +
                            [f2 + 0.5 * rng.normal(size=n) for _ in range(3)])
    rows = [(i, *map(float, r)) for i, r in enumerate(items)]
    cols = [f"x{j}" for j in range(7)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols)), items


BLOCKS = {"F1": ["x0", "x1", "x2", "x3"], "F2": ["x4", "x5", "x6"]}


def test_pls_recovers_structure(spark, survey_df):
    df, items = survey_df
    m = sv.pls_fit(df, BLOCKS, {"F1": "A", "F2": "A"}, [("F1", "F2")])
    assert all(l > 0.8 for l in m.loadings["F1"]) and all(l > 0.8 for l in m.loadings["F2"])
    assert 0.55 < m.path_coefs[("F1", "F2")] < 0.75
    s = sv.construct_scores(df, m, "id").toPandas()
    assert abs(s["F1"].std(ddof=1) - 1) < 1e-9
    assert abs(np.corrcoef(s["F1"], s["F2"])[0, 1] - m.path_coefs[("F1", "F2")]) < 1e-9


def test_bootstrap_is_partition_independent(spark, survey_df):
    df, _ = survey_df
    cols = ["x0", "x1", "x2"]
    a = sv.bootstrap_moments(df, "id", cols, 50, seed=3).orderBy("rep").toPandas()
    b = sv.bootstrap_moments(df.repartition(7), "id", cols, 50, seed=3).orderBy("rep").toPandas()
    assert np.allclose(a.to_numpy(), b.to_numpy(), rtol=1e-12)
    assert abs(a["w"].mean() / 800 - 1) < 0.05


def test_cronbach_matches_numpy(spark, survey_df):
    df, items = survey_df
    got = {r["construct"]: r["alpha"] for r in sv.cronbach_alpha(df, BLOCKS).collect()}
    x = items[:, :4]
    k = 4
    want = k / (k - 1) * (1 - x.var(0, ddof=1).sum() / x.sum(1).var(ddof=1))
    assert abs(got["F1"] - want) < 1e-9


def test_consistent_pls_removes_attenuation(spark, survey_df):
    df, _ = survey_df
    m = sv.pls_fit(df, BLOCKS, {"F1": "A", "F2": "A"}, [("F1", "F2")])
    c = sv.pls_consistent(m)
    plain = m.path_coefs[("F1", "F2")]
    fixed = c["path_coefs"][("F1", "F2")]
    assert fixed > plain and abs(fixed - 0.7) < abs(plain - 0.7) and abs(fixed - 0.7) < 0.06
    assert all(0.8 < v < 1.0 for v in c["rho_a"].values())


def test_consistent_pls_reports_a_block_without_reliability():
    # two items of block a that correlate negatively: no reliability
    items = ["a1", "a2", "b1", "b2"]
    corr = np.array([[1, -0.2, 0.3, 0.3], [-0.2, 1, 0.3, 0.3], [0.3, 0.3, 1, 0.6], [0.3, 0.3, 0.6, 1]])
    blocks, modes, paths = {"a": items[:2], "b": items[2:]}, {"a": "A", "b": "A"}, [("a", "b")]
    w, load, coefs, r2, it = sv.pls_from_corr(corr, items, blocks, modes, paths)
    m = sv.PlsModel(blocks, modes, paths, w, load, coefs, r2, {}, {}, it, corr, items)
    out = sv.pls_consistent(m)
    assert out["rho_a"]["a"] <= 0 < out["rho_a"]["b"]
    assert out["path_coefs"] == {("a", "b"): None} and out["r2"] == {"b": None}
    assert "rho_A of a" in out["reason"]["b"] and out["loadings"]["a"] is None
    # with a common factor behind each block the correction is finite and larger
    good = np.array([[1, 0.5, 0.3, 0.3], [0.5, 1, 0.3, 0.3], [0.3, 0.3, 1, 0.6], [0.3, 0.3, 0.6, 1]])
    w, load, coefs, r2, it = sv.pls_from_corr(good, items, blocks, modes, paths)
    out = sv.pls_consistent(sv.PlsModel(blocks, modes, paths, w, load, coefs, r2, {}, {}, it, good, items))
    assert coefs[("a", "b")] < out["path_coefs"][("a", "b")] < 1 and not out["reason"]
