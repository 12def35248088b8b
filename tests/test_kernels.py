import numpy as np
import pytest
from pyspark.sql import functions as F

from tabreg.models.kernels import Kernel, draw_candidates, landmark_map
from tabreg.models.registry import SPACES, make
from tabreg.sources.artifacts import load_model, save_model

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) * [2, 30] + [1, -5]
    return x, np.sin(x[:, 0]) + 0.01 * x[:, 1] + 0.05 * rng.normal(size=300)


def frame(spark, x, y, parts=4):
    rows = [(*map(float, r), float(t), i) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, y double, id long").repartition(parts)


def predictions(model, df):
    return np.array([r.prediction for r in model.predict(df).orderBy("id").collect()])


@pytest.mark.parametrize("settings", [
    {"kernel": "rbf", "gamma": 0.7, "alpha": 0.1}, {"kernel": "poly", "degree": 3, "coef0": 0.5, "alpha": 1.0}, {"kernel": "poly", "degree": 1, "alpha": 2.0},
    {"kernel": "sigmoid", "gamma": 0.2, "coef0": 0.1, "alpha": 0.5}])
def test_all_rows_as_landmarks_are_the_exact_machine(spark, data, settings):
    x, y = data
    df = frame(spark, x, y)
    z = (x - x.mean(0)) / x.std(0)
    k = Kernel(settings["kernel"], settings.get("gamma", 0.5), settings.get("degree", 3), settings.get("coef0", 1.0))(z, z)
    want = k @ np.linalg.solve(k + settings["alpha"] * np.eye(300), y)
    assert np.allclose(predictions(make("KernelRidge", **settings).fit(df, NAMES, "y"), df), want, atol=1e-5)


def test_error_falls_with_landmarks_and_not_with_the_layout(spark, data):
    x, y = data
    z = (x - x.mean(0)) / x.std(0)
    k = Kernel("rbf", 0.5)(z, z)
    want = k @ np.linalg.solve(k + 0.1 * np.eye(300), y)
    off = []
    for m in (5, 20, 60):
        a, b = (predictions(make("KernelRidge", kernel="rbf", gamma=0.5, alpha=0.1, components=m).fit(frame(spark, x, y, n), NAMES, "y"), frame(spark, x, y, n))
                for n in (1, 7))
        assert np.allclose(a, b, atol=1e-8)
        off.append(np.sqrt(((a - want) ** 2).mean()))
    assert off[0] > off[1] > off[2] and off[2] < 0.02


def test_gaussian_process_mean_and_spread(spark, data):
    x, y = data
    df, far = frame(spark, x, y), frame(spark, x + 0.3, y)
    model = make("GaussianProcessRegressor", alpha=0.01, length_scale=0.8).fit(df, NAMES, "y")
    units = lambda v: (v - x.mean(0)) / x.std(0)
    kernel = Kernel("rbf", 0.5 / 0.8 ** 2)
    inner = np.linalg.inv(kernel(units(x), units(x)) + 0.01 * np.eye(300))
    cross = kernel(units(x + 0.3), units(x))
    got = model.predict_spread(model.predict(far)).orderBy("id").collect()
    assert np.allclose([r.prediction for r in got], cross @ inner @ y, atol=1e-4)
    want = np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", cross, inner, cross), 0))
    assert np.allclose([r.deviation for r in got], want, atol=1e-4)
    centred = make("GaussianProcessRegressor", alpha=0.01, length_scale=0.8, normalize_y=True).fit(frame(spark, x, y + 500), NAMES, "y")
    assert np.abs(predictions(centred, df) - 500 - y).max() < 0.5


def test_repeated_rows_and_few_rows(spark):
    rows = [(float(k % 5), 1.0, float(k % 5) ** 2, k) for k in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, y double, id long").repartition(6)
    x, u = draw_candidates(df, NAMES, 100, 1)
    assert len(x) == 5 == len(set(u))
    model = make("KernelRidge", kernel="rbf", gamma=1.0, alpha=1e-6).fit(df, NAMES, "y")
    assert np.allclose(predictions(model, df), [r[2] for r in rows], atol=1e-3)
    with pytest.raises(ValueError):
        landmark_map(df.filter("false"), NAMES, Kernel("rbf", 1.0), 5, 1.0, 1, (np.zeros(2), np.ones(2)))
    for bad in ({"kernel": "laplacian"},):
        with pytest.raises(ValueError):
            make("KernelRidge", **bad).fit(df, NAMES, "y")
    assert {"degree", "coef0"} <= set(SPACES["KernelRidge"])


@pytest.mark.parametrize("name,settings", [
    ("KernelRidge", {"kernel": "poly", "components": 20}), ("SVR", {"components": 20, "max_iter": 3}), ("NuSVR", {"components": 20, "max_iter": 3}),
    ("GaussianProcessRegressor", {"components": 20, "alpha": 0.1}), ("XGBRegressor", {"n_estimators": 2, "max_depth": 2}),
    ("ExtraTreeRegressor", {"max_depth": 3}), ("TransformedTargetRegressor", {"transformer": "yeo-johnson"}),
    ("TransformedTargetRegressor", {"transformer": "quantile"})])
def test_models_are_saved_and_loaded(spark, data, tmp_path, name, settings):
    df = frame(spark, *data)
    model = make(name, **settings).fit(df, NAMES, "y")
    save_model(spark, model, str(tmp_path), "m")
    again = load_model(spark, str(tmp_path), "m")
    assert type(again) is type(model) and again.importances == model.importances
    assert np.allclose(predictions(again, df), predictions(model, df), atol=1e-12)
    if name.startswith("Gaussian"):
        both = [m.predict_spread(df).agg(F.sum("deviation")).first()[0] for m in (model, again)]
        assert both[0] == pytest.approx(both[1])


def test_mapped_rows_come_in_slices_and_predictions_skip_the_features(make):
    import pandas as pd

    from tabreg.models.base import FittedMapped
    from tabreg.models.gram import MAPPED_CELLS, grams, total
    from tabreg.models.kernels import Kernel, LandmarkMap

    class Short(LandmarkMap):
        def __call__(self, x):
            assert len(x) <= max(256, MAPPED_CELLS // self.turn.shape[1]), "a whole batch at once"
            return LandmarkMap.__call__(self, x)

    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 2))
    table = make(pd.DataFrame(x, columns=["a", "b"]).assign(y=x.sum(1)), 1)
    made = LandmarkMap.of(np.zeros(2), np.ones(2), Kernel("rbf", 0.5), rng.normal(size=(300, 2)) * 3)
    short = Short(made.mean, made.wide, made.kernel, made.landmarks, made.turn, made.sign)
    g, phi = total(grams(table, ["a", "b"], "y", mapper=short)), made(x)
    np.testing.assert_allclose(g.xx, phi.T @ phi, atol=1e-6)
    coef = rng.normal(size=phi.shape[1])
    got = FittedMapped(["a", "b"], short, coef, 2.0).predict(table).toPandas()
    np.testing.assert_allclose(got["prediction"], made(got[["a", "b"]].to_numpy()) @ coef + 2.0, atol=1e-6)
