import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabreg.models import iterative, linear
from tabreg.models.gram import Gram, fold_column, grams, total
from tabreg.models.leaderboard import adjusted, leaderboard
from tabreg.models.registry import REGRESSORS, SPACES, make as build, tune
from tabreg.models.search import LogUniform, RandInt, Uniform, draw, random_search
from tabreg.operators.split import train_test_split
from tabreg.roles import Roles

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.5, 2] + [10, 0, -3, 100]
    y = 3 * x[:, 0] - 2 * x[:, 1] + 7 + rng.normal(size=300)
    return x, y


@pytest.fixture(scope="module")
def df(spark, data):
    x, y = data
    rows = [(*map(float, r), float(t), i) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double, id long").repartition(5).cache()


def centred(data):
    x, y = data
    return x - x.mean(0), y - y.mean()


def test_gram_blocks_add_up(df, data):
    x, y = data
    blocks = grams(df, NAMES, "y", F.col("id") % 3)
    g = total(blocks)
    c, v, w = g.moments(True)
    xc, yc = centred(data)
    np.testing.assert_allclose(c, xc.T @ xc / 300, atol=1e-9)
    np.testing.assert_allclose(v, xc.T @ yc / 300, atol=1e-9)
    assert abs(w - yc @ yc / 300) < 1e-9
    c0, v0, w0 = g.moments(False)
    np.testing.assert_allclose(c0, x.T @ x / 300)
    np.testing.assert_allclose(v0, x.T @ y / 300)
    assert abs(w0 - y @ y / 300) < 1e-6
    rest = g - blocks[0]
    keep = np.arange(300) % 3 != 0
    np.testing.assert_allclose(rest.moments(False)[0], x[keep].T @ x[keep] / keep.sum(), rtol=1e-9)


def test_least_squares_and_ridge(df, data):
    x, y = data
    full = np.column_stack([x, np.ones(300)])
    want = np.linalg.lstsq(full, y, rcond=None)[0]
    m = build("LinearRegression").fit(df, NAMES, "y")
    np.testing.assert_allclose([*m.coef, m.intercept], want, rtol=1e-7)
    m = build("LinearRegression", fit_intercept=False).fit(df, NAMES, "y")
    np.testing.assert_allclose(m.coef, np.linalg.lstsq(x, y, rcond=None)[0], rtol=1e-6)
    xc, yc = centred(data)
    m = build("Ridge", alpha=25.0).fit(df, NAMES, "y")
    np.testing.assert_allclose(m.coef, np.linalg.solve(xc.T @ xc + 25 * np.eye(4), xc.T @ yc), rtol=1e-9)


@pytest.mark.parametrize("alpha,ratio", [(0.5, 1.0), (2.0, 1.0), (0.7, 0.4)])
def test_elastic_net_optimality(df, data, alpha, ratio):
    xc, yc = centred(data)
    b = np.array(build("ElasticNet", alpha=alpha, l1_ratio=ratio).fit(df, NAMES, "y").coef)
    slope = xc.T @ (yc - xc @ b) / 300 - alpha * (1 - ratio) * b
    for g, v in zip(slope, b):
        assert abs(g - alpha * ratio * np.sign(v)) < 1e-4 if v else abs(g) <= alpha * ratio + 1e-4
    same = build("LassoLars", alpha=alpha).fit(df, NAMES, "y").coef
    if ratio == 1.0:
        np.testing.assert_allclose(same, b, atol=1e-4)


def test_positive_lasso(df):
    assert min(build("Lasso", alpha=0.1, positive=True).fit(df, NAMES, "y").coef) >= 0.0


def test_paths_end_at_least_squares(df):
    ols = build("LinearRegression").fit(df, NAMES, "y").coef
    np.testing.assert_allclose(build("Lars").fit(df, NAMES, "y").coef, ols, atol=1e-6)
    one = np.array(build("Lars", n_nonzero_coefs=1).fit(df, NAMES, "y").coef)
    assert np.count_nonzero(one) == 1 and one[1] < 0
    for name in ("LarsCV", "LassoLarsCV", "LassoCV", "ElasticNetCV", "OrthogonalMatchingPursuitCV", "LassoLarsIC"):
        coef = np.array(build(name).fit(df, NAMES, "y").coef)
        assert abs(coef[0] - 3) < 0.4 and abs(coef[1] + 2) < 0.2, name


@pytest.mark.parametrize("name", ["ElasticNetCV", "LarsCV", "LassoCV", "LassoLarsCV", "OrthogonalMatchingPursuitCV"])
def test_folds_reach_the_tasks(df, name):
    """The fold column itself went to the tasks, and no cross-validated fit could start."""
    fold = fold_column(df, 5)
    rows = df.select(*NAMES, "y", fold.alias("fold")).toPandas()
    plain = {}
    for f, part in rows.groupby("fold"):
        x, y, n = part[NAMES].to_numpy(), part["y"].to_numpy(), len(part)
        plain[f] = Gram(n, x.sum(0), y.sum(), x.T @ x, x.T @ y, y @ y, np.zeros(4), 0.0)
    want = build(name).from_blocks(plain, NAMES)
    got = build(name).fit(df, NAMES, "y")
    np.testing.assert_allclose([*got.coef, got.intercept], [*want.coef, want.intercept], rtol=1e-5, atol=1e-6)
    assert {f: g.n for f, g in grams(df, NAMES, "y", fold).items()} == {f: g.n for f, g in plain.items()} and len(plain) == 5


def test_path_against_elastic_net_on_correlated_columns():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(400, 6))
    x = z @ rng.normal(size=(6, 6))
    y = x @ [1, -2, 0, 0, 3, 0.5] + rng.normal(size=400)
    x, y = x - x.mean(0), y - y.mean()
    c, v = x.T @ x / 400, x.T @ y / 400
    alphas, knots = linear.angle_path(c, v, True, 6)
    for a in np.geomspace(alphas[0] * 0.9, alphas[0] * 0.002, 12):
        want = linear.coordinate_descent(c, v, a, 0.0, max_iter=200_000, tol=1e-12)
        np.testing.assert_allclose(linear.at_alpha(alphas, knots, a), want, atol=1e-5)


def test_matching_pursuit_is_greedy(df):
    coef = np.array(build("OrthogonalMatchingPursuit", n_nonzero_coefs=2).fit(df, NAMES, "y").coef)
    assert set(np.flatnonzero(coef)) == {0, 1}


def test_ridge_cv_uses_exact_leave_one_out(df, data):
    x, y = data
    alphas, losses = (0.01, 50.0, 5000.0), []
    for a in alphas:
        e = 0.0
        for i in range(300):
            k = np.arange(300) != i
            xm, ym = x[k].mean(0), y[k].mean()
            b = np.linalg.solve((x[k] - xm).T @ (x[k] - xm) + a * np.eye(4), (x[k] - xm).T @ (y[k] - ym))
            e += (y[i] - ym - (x[i] - xm) @ b) ** 2
        losses.append(e)
    m = build("RidgeCV", alphas=alphas).fit(df, NAMES, "y")
    assert m.info["alpha"] == alphas[int(np.argmin(losses))]


def test_bayesian_ridge_fixed_point(df, data):
    xc, yc = centred(data)
    m = build("BayesianRidge", tol=1e-10).fit(df, NAMES, "y")
    shrink = m.info["lambda_"] / m.info["alpha"]
    np.testing.assert_allclose(m.coef, np.linalg.solve(xc.T @ xc + shrink * np.eye(4), xc.T @ yc), rtol=1e-6)
    assert abs(1 / m.info["alpha"] - 1.0) < 0.25


def loss_of(m, data, fn):
    x, y = data
    return fn(y - x @ np.array(m.coef) - m.intercept)


@pytest.mark.parametrize("tau", [0.5, 0.9])
def test_quantile_regression_is_near_optimal(df, data, tau):
    def pinball(e):
        return np.where(e > 0, tau * e, (tau - 1) * e).sum()

    m = build("QuantileRegressor", quantile=tau).fit(df, NAMES, "y")
    base = loss_of(m, data, pinball)
    x, y = data
    assert abs(np.mean(y <= x @ np.array(m.coef) + m.intercept) - tau) < 0.03
    rng = np.random.default_rng(0)
    for _ in range(200):
        step = rng.normal(size=5) * [0.02, 0.004, 0.04, 0.01, 0.05]
        e = y - x @ (np.array(m.coef) + step[:4]) - m.intercept - step[4]
        assert pinball(e) > base * (1 - 1e-4)


def test_linear_support_vector_objective(df, data):
    x, y = data

    def objective(b, c0):
        e = np.abs(y - x @ b - c0)
        return 0.5 * b @ b + 2.0 * np.maximum(e - 0.5, 0).sum()

    m = iterative.SupportVector(C=2.0, epsilon=0.5, max_iter=60, tol=1e-7).fit(df, NAMES, "y")
    base = objective(np.array(m.coef), m.intercept)
    rng = np.random.default_rng(1)
    for _ in range(200):
        step = rng.normal(size=5) * [0.02, 0.004, 0.04, 0.01, 0.05]
        assert objective(np.array(m.coef) + step[:4], m.intercept + step[4]) > base * (1 - 1e-3)


def test_robust_fits_ignore_outliers(spark, df):
    bad = spark.createDataFrame([(10.0 + i / 10, 0.0, -3.0, 100.0, 500.0 + i, 1000 + i) for i in range(40)], df.schema)
    both = df.unionByName(bad)
    for name, args in (("RANSACRegressor", {}), ("HuberRegressor", {"max_iter": 200}), ("QuantileRegressor", {})):
        m = build(name, **args).fit(both, NAMES, "y")
        assert abs(m.coef[0] - 3) < 0.5 and abs(m.coef[1] + 2) < 0.1, name
    big = build("RANSACRegressor", min_samples=0.5, residual_threshold=4.0, max_trials=20)
    big.max_drawn = 10
    assert abs(big.fit(df, NAMES, "y").coef[1] + 2) < 0.1


def test_nu_is_the_share_of_rows_outside_the_tube(df):
    from pyspark.sql import functions as F

    for nu in (0.2, 0.6):
        m = build("NuSVR", kernel="linear", nu=nu, C=100.0).fit(df, NAMES, "y")
        outside = m.predict(df, "p").select(F.avg((F.abs(F.col("p") - F.col("y")) > m.info["epsilon"]).cast("int"))).first()[0]
        assert abs(outside - nu) < 0.05


@pytest.mark.parametrize("settings", [{}, {"min_samples": 0.2}, {"min_samples": 0.9}, {"min_samples": 7}])
def test_ransac_runs_every_trial_and_ignores_the_layout(df, settings):
    found = []
    for parts in (1, 7, 37):
        m = build("RANSACRegressor", max_trials=60, **settings).fit(df.repartition(parts), NAMES, "y")
        assert m.info["trials"] == 60
        found.append([*m.coef, m.intercept])
    np.testing.assert_allclose(found[1:], [found[0]] * 2, atol=1e-6)


def test_sgd_reaches_the_least_squares_line(df):
    m = build("SGDRegressor", max_iter=80, tol=1e-7).fit(df, NAMES, "y")
    assert abs(m.coef[0] - 3) < 0.3 and abs(m.coef[1] + 2) < 0.1


def test_tweedie_identity_is_scaled_ridge(df, data):
    xc, yc = centred(data)
    m = build("TweedieRegressor", power=0, alpha=0.5).fit(df, NAMES, "y")
    np.testing.assert_allclose(m.coef, np.linalg.solve(xc.T @ xc / 300 + 0.5 * np.eye(4), xc.T @ yc / 300), rtol=1e-7)


def test_poisson_penalty_matches_its_objective(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    y = rng.poisson(np.exp(1.0 + 0.5 * x)).astype(float)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    m = build("PoissonRegressor", alpha=0.3, tol=1e-10).fit(d, ["x"], "y")

    def objective(b, c):
        eta = b * x + c
        return np.mean(np.exp(eta) - y * eta) + 0.15 * b * b

    base = objective(m.coef[0], m.intercept)
    for db in (-0.02, 0.02):
        assert objective(m.coef[0] + db, m.intercept) > base - 1e-5


@pytest.mark.parametrize("kind", ["log", "yeo-johnson", "box-cox", "quantile"])
def test_transformed_target_round_trip(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 2, 400)
    y = np.exp(1 + x + 0.01 * rng.normal(size=400))
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    m = build("TransformedTargetRegressor", transformer=kind).fit(d, ["x"], "y")
    out = m.predict(d).toPandas()
    share = 1 - ((out["y"] - out["prediction"]) ** 2).mean() / out["y"].var(ddof=0)
    assert share > (0.93 if kind == "quantile" else 0.99)


def test_kernel_ridge_and_radial_machine_bend(spark):
    x = np.linspace(-3, 3, 400)
    y = np.sin(2 * x)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    for m in (build("KernelRidge", kernel="rbf", gamma=2.0, alpha=0.01).fit(d, ["x"], "y"),
              build("SVR", C=100.0, gamma=2.0, epsilon=0.01).fit(d, ["x"], "y")):
        out = m.predict(d).toPandas()
        assert np.abs(out["prediction"] - out["y"]).mean() < 0.1


def test_dummy_strategies(df, data):
    _, y = data
    for args, want in (({}, y.mean()), ({"strategy": "median"}, np.median(y)),
                       ({"strategy": "quantile", "quantile": 0.25}, np.quantile(y, 0.25)),
                       ({"strategy": "constant", "constant": 4.0}, 4.0)):
        assert abs(build("DummyRegressor", **args).fit(df, NAMES, "y").intercept - want) < 1e-9


def test_knn_regressor_weights(spark):
    d = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "x double, y double")
    near = build("KNeighborsRegressor", n_neighbors=3).fit(d, ["x"], "y").predict(spark.createDataFrame([(5.2,)], "x double"))
    assert abs(near.first()["prediction"] - (16 + 25 + 36) / 3) < 1e-9
    m = build("KNeighborsRegressor", n_neighbors=3, weights="distance").fit(d, ["x"], "y")
    got = sorted(r["prediction"] for r in m.predict(spark.createDataFrame([(5.0,), (5.2,)], "x double")).collect())
    w = np.array([1 / 1.2, 1 / 0.2, 1 / 0.8])
    assert abs(got[0] - 25.0) < 1e-9 and abs(got[1] - (w @ [16, 25, 36]) / w.sum()) < 1e-9


def test_adaboost_beats_one_tree(df):
    from tabreg.operators.evaluate import regression_metrics

    tree = build("DecisionTreeRegressor", max_depth=3).fit(df, NAMES, "y")
    boost = build("AdaBoostRegressor", n_estimators=8).fit(df, NAMES, "y")
    r2 = [regression_metrics(m.predict(df), "y", "prediction").first()["r2"] for m in (tree, boost)]
    assert r2[1] > r2[0]


def test_missing_cells_are_refused(spark):
    d = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (2.0, 5.0)], "a double, y double")
    with pytest.raises(Exception, match="impute"):
        build("LinearRegression").fit(d, ["a"], "y")


def test_samplers_and_draws():
    picks = draw({"u": Uniform(2, 3), "i": RandInt(1, 4), "l": LogUniform(1e-3, 1.0), "c": (True,)}, 200, 42)
    assert all(2 <= p["u"] <= 5 and p["i"] in (1, 2, 3) and 1e-3 <= p["l"] <= 1 for p in picks)
    assert picks == draw({"u": Uniform(2, 3), "i": RandInt(1, 4), "l": LogUniform(1e-3, 1.0), "c": (True,)}, 200, 42)
    assert len(draw({"b": (True, False)}, 50, 1)) == 2
    assert set(SPACES) <= set(REGRESSORS)


@pytest.mark.parametrize("scoring", ["r2", "neg_mean_absolute_error", "neg_root_mean_squared_error"])
def test_gram_search_equals_plain_folds(df, scoring):
    from tabreg.models.search import _fold_scores, _gram_scores

    settings = [{"alpha": 0.1}, {"alpha": 500.0, "fit_intercept": False}]
    view = df.select(*NAMES, "y")
    fast = _gram_scores(linear.Ridge(), view, NAMES, "y", settings, 3, 42, scoring)
    slow = _fold_scores(linear.Ridge(), view, NAMES, "y", settings, 3, 42, scoring, 2)
    np.testing.assert_allclose(fast, slow, rtol=1e-6)


def test_search_fallback_and_custom_ranges(df):
    found = random_search(build("Ridge"), df.select(*NAMES, "y"), NAMES, "y", {"alpha": (float("nan"),)}, n_iter=2, folds=3)
    assert found.status == "default" and found.params == {}
    found = tune("GradientBoostingRegressor", df.select(*NAMES, "y"), NAMES, "y", n_iter=1, folds=2,
                 custom={"n_estimators": (3,), "max_depth": (2,), "subsample": (1.0,), "loss": ("squared",),
                         "min_weight_fraction_leaf": (0.0,), "min_impurity_decrease": (0.0,)})
    assert found.status == "tuned" and found.params["n_estimators"] == 3 and found.seconds > 0
    with pytest.raises(ValueError):
        tune("Ridge", df, NAMES, "y", custom={"alpha": (1.0,)})


def test_leaderboard(spark, df):
    d = df.withColumn("few", F.concat(F.lit("v"), (F.col("id") % 3).cast("string"))) \
        .withColumn("many", F.concat(F.lit("w"), (F.col("id") % 20).cast("string"))) \
        .withColumn("few", F.when(F.col("id") % 10 != 0, F.col("few"))) \
        .withColumn("c", F.when(F.col("id") % 7 != 0, F.col("c")))
    roles = Roles([*NAMES, "few", "many"], "y", ["few", "many"], row_id=["id"])
    train, test = train_test_split(d, ["id"])
    board = leaderboard(train, test, roles, ["LinearRegression", "DummyRegressor", "Nope"],
                        custom_metric=lambda y, yhat: F.max(F.abs(y - yhat)), handle_unknown="keep")
    rows = {r["model"]: r for r in board.scores.collect()}
    assert rows["Nope"]["status"] == "failed" and "unknown model" in rows["Nope"]["error"]
    assert rows["LinearRegression"]["r_squared"] > 0.95 and rows["LinearRegression"]["custom_metric"] > 0
    n, r2 = test.count(), rows["LinearRegression"]["r_squared"]
    assert abs(rows["LinearRegression"]["adjusted_r_squared"] - (1 - (1 - r2) * (n - 1) / (n - 7))) < 1e-12
    assert board.best(1) == ["LinearRegression"]
    assert {"few_missing", "few_v0", "many"} <= set(board.prepared.features)
    wide = board.predictions(["id"])
    assert wide.columns == ["id", "y", "LinearRegression", "DummyRegressor"] and wide.count() == n
    again = leaderboard(train, test, roles, ["LinearRegression"], fitted=board.fitted, handle_unknown="keep")
    assert again.fitted["LinearRegression"] is board.fitted["LinearRegression"]
    assert adjusted(0.5, 5, 4) is None


def test_unknown_category_is_an_error_by_default(spark):
    from tabreg.operators.encode import ordinal_encode

    train = spark.createDataFrame([("b",), ("a",)], "s string")
    test = spark.createDataFrame([("a",), ("z",)], "s string")
    with pytest.raises(Exception, match="unknown value"):
        ordinal_encode(train, test, ["s"]).collect()
    assert sorted(r[0] for r in ordinal_encode(train, test, ["s"], "keep").collect()) == [-1, 0]
