import numpy as np
import pytest

from tabreg.models import iterative
from tabreg.models.registry import make

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3)) * [1, 20, 0.1] + [5, 0, 2]
    return x, 2 * x[:, 0] - 0.3 * x[:, 1] + 9 * x[:, 2] + 4 + 0.2 * rng.normal(size=900)


def frame(spark, x, y, parts):
    return spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double").repartition(parts)


@pytest.mark.parametrize("name,settings", [("SGDRegressor", {}), ("SGDRegressor", {"loss": "huber", "penalty": "elasticnet", "alpha": 0.01}),
                                           ("PassiveAggressiveRegressor", {}),
                                           ("PassiveAggressiveRegressor", {"loss": "squared_epsilon_insensitive", "C": 0.5})])
def test_result_depends_on_rows_and_seed_only(spark, data, monkeypatch, name, settings):
    monkeypatch.setattr(iterative, "WALK_ROWS", 200)  # several walks
    got = [make(name, max_iter=6, **settings).fit(frame(spark, *data, n), NAMES, "y") for n in (1, 7, 37)]
    for other in got[1:]:
        assert np.allclose(got[0].coef, other.coef, rtol=1e-9, atol=1e-9) and other.intercept == pytest.approx(got[0].intercept, abs=1e-9)
    other = make(name, max_iter=6, random_state=5, **settings).fit(frame(spark, *data, 2), NAMES, "y")
    assert other.coef != got[0].coef


@pytest.mark.parametrize("loss", ["epsilon_insensitive", "squared_epsilon_insensitive"])
def test_passive_aggressive_stays_near_the_tube(spark, data, loss):
    x, y = data
    model = make("PassiveAggressiveRegressor", loss=loss).fit(frame(spark, x, y, 3), NAMES, "y")
    error = np.abs(x @ model.coef + model.intercept - y) / y.std()
    assert np.maximum(error - 0.1, 0).mean() < 0.01
    with pytest.raises(ValueError):
        make("PassiveAggressiveRegressor", loss="hinge").fit(frame(spark, x, y, 1), NAMES, "y")


def test_repeated_rows_weigh_as_often_as_they_occur(spark, data):
    x, y = data[0][:200], data[1][:200]
    one = make("SGDRegressor", max_iter=8).fit(frame(spark, x, y, 2), NAMES, "y")
    three = make("SGDRegressor", max_iter=8).fit(frame(spark, np.repeat(x, 3, axis=0), np.repeat(y, 3), 5), NAMES, "y")
    assert np.allclose(one.coef, three.coef, atol=1e-9)
    view, n = iterative.walks(frame(spark, np.repeat(x, 500, axis=0)[:50_000], np.repeat(y, 500)[:50_000], 8), NAMES, "y", 1)
    assert n == 50_000 and view.count() == 1  # a hundred different rows
