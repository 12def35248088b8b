import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabreg.models.registry import make as build
from tabreg.plans.pipeline import STEPS, PipelineSpec, kept
from tabreg.roles import Roles
from tabreg.sources import storage
from tabreg.sources.artifacts import load_model, save_model
from tabreg.sources.runlog import ModelLog


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(120).select(
        F.col("id"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("s"),
        (F.col("id") % 17 * 2.0 + F.col("id") % 5 + 1.0).alias("y"))


def test_log_appends_and_keeps_the_record(spark, tmp_path):
    log = ModelLog(spark, str(tmp_path / "log"))
    record = {"model_name": "Ridge", "metrics": {"mae": 1, "rmse": 2.5}, "cv_folds": 5, "steps": [{"step": "x"}]}
    log.log_iteration(record)
    log.log_iteration({**record, "model_name": "Lasso"})
    assert "metrics" in record and "timestamp" not in record
    rows = log.frame().collect()
    assert [r["model_name"] for r in rows] == ["Ridge", "Lasso"] and rows[0]["mae"] == 1.0
    assert json.loads(rows[0]["steps"]) == [{"step": "x"}]
    log.write_csv(str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns[0] == "timestamp"
    with pytest.raises(ValueError):
        log.log_iteration({"colour": "red"})


@pytest.mark.parametrize("name,args", [
    ("LinearRegression", {}), ("PoissonRegressor", {"alpha": 0.1}), ("RandomForestRegressor", {"n_estimators": 3}),
    ("GradientBoostingRegressor", {"n_estimators": 3}), ("AdaBoostRegressor", {"n_estimators": 3}),
    ("KNeighborsRegressor", {"row_id": "id"})])
def test_models_survive_saving(spark, df, tmp_path, name, args):
    model = build(name, **args).fit(df, ["a", "b"], "y")
    for _ in range(2):  # the second save replaces the first
        save_model(spark, model, str(tmp_path), name)
    again = load_model(spark, str(tmp_path), name)
    one = {r["id"]: r["prediction"] for r in model.predict(df).collect()}
    two = {r["id"]: r["prediction"] for r in again.predict(df).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_pipeline_runs_and_round_trips(df):
    roles = Roles(["a", "b", "s"], "y", ["s"], order_by=["id"], row_id=["id"])
    spec = (PipelineSpec().then("drop_first_rows", n=3).then("replace_with_null", values="4")
            .then("remove_outliers_iqr", cols=["a"], multiplier=3.0).then("impute_missing", method="median")
            .then("smooth_features", method="moving_average", window_size=3).then("impute_missing", method="mean")
            .then("encode_categories", method="one_hot").then("scale_features", kind="minmax").then("best_features", k=3))
    assert PipelineSpec.from_json(spec.to_json()) == spec
    out, after = spec.apply(df, roles)
    assert len(after.features) == 3 and set(after.features) <= set(out.columns)
    assert out.agg(*[F.max(c) for c in after.features]).first()[0] <= 1.0
    with pytest.raises(ValueError):
        PipelineSpec().then("dance")
    assert {"resample", "parse_datetime", "principal_components", "all_relevant"} <= set(STEPS)


@pytest.mark.parametrize("method,args", [("exponential", {"alpha": 0.4}), ("savgol", {"window_size": 5}),
                                         ("lowess", {"fraction": 0.3})])
def test_smoothing_steps_leave_the_target(df, method, args):
    roles = Roles(["a", "b"], "y", order_by=["id"], row_id=["id"])
    out, _ = PipelineSpec().then("smooth_features", method=method, **args).apply(df, roles)
    assert out.columns == df.columns
    assert out.agg(F.sum("y")).first() == df.agg(F.sum("y")).first()
    assert out.join(df.withColumnRenamed("a", "old"), "id").where("abs(a - old) > 0.5").count() > 0


def test_cut_lineage_uses_the_named_folder(spark, tmp_path):
    class Named:
        """A session whose cluster names a checkpoint folder."""

        class conf:
            @staticmethod
            def get(key, default=None):
                return str(tmp_path) if key == "spark.checkpoint.dir" else default

    assert storage.shared_path(Named, "cut").startswith(str(tmp_path) + "/cut-")
    assert storage.shared_folder(spark) == storage.shared_folder(spark)
    assert storage.cut_lineage(spark.range(5)).count() == 5


def test_kept_releases(df):
    with kept(df) as held:
        assert held.count() == 120 and held.is_cached
    assert not held.is_cached


def test_full_run(spark, df, tmp_path):
    from tabreg.models.leaderboard import leaderboard
    from tabreg.models.registry import tune
    from tabreg.operators.evaluate import regression_metrics
    from tabreg.operators.split import train_test_split

    roles = Roles(["a", "b", "s"], "y", ["s"], row_id=["id"])
    train, test = train_test_split(df, ["id"])
    board = leaderboard(train, test, roles, ["LinearRegression", "Ridge", "DummyRegressor"])
    name = board.best(1)[0]
    prepared = board.prepared.transform(train, ["id", "y"])
    found = tune(name, prepared, board.prepared.features, "y", n_iter=3, folds=3)
    scores = regression_metrics(found.model.predict(board.test), "y", "prediction").first().asDict()
    assert scores["r2"] > 0.99
    log = ModelLog(spark, str(tmp_path / "log"))
    log.log_iteration({"model_name": name, "tuning_time_seconds": found.seconds, "cv_folds": 3,
                       "metrics": {k: scores[k] for k in ("mae", "mse", "rmse", "r2")}})
    assert log.frame().count() == 1
