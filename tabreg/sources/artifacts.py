"""Saving and loading fitted models, one folder per model name."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import SparkSession

from tabreg.models.base import Fitted, FittedLinear, FittedMapped, FittedSpark
from tabreg.models.ensembles import FittedLog, FittedMedianTrees
from tabreg.models.iterative import Back, FittedBack, FourierMap
from tabreg.models.kernels import FittedProcess, Kernel, LandmarkMap
from tabreg.models.knn import FittedNeighbors
from tabreg.models.trees import FittedTrees, Tree, trees_of_spark
from tabreg.models.wide import FittedWide

MAPS = {"fourier": FourierMap, "landmarks": LandmarkMap}


def _plain(value):
    """Arrays and dataclasses as what JSON holds."""
    return value.tolist() if isinstance(value, np.ndarray) else {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def _map_of(note: dict):
    parts = {k: np.array(v) if isinstance(v, list) else Kernel(**v) if isinstance(v, dict) else v for k, v in note["parts"].items()}
    return MAPS[note["map"]](**parts)


def _save_trees(spark: SparkSession, trees, path: str) -> None:
    nodes = pd.concat([pd.DataFrame({**asdict(t), "tree": i, "node": np.arange(len(t.feature))}) for i, t in enumerate(trees)])
    spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/nodes")


def _load_trees(spark: SparkSession, path: str) -> list[Tree]:
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])  # the model itself
    columns = ["feature", "threshold", "left", "right", "value", "missing_left", "cover"]
    return [Tree(*[g[c].to_numpy() for c in columns]) for _, g in nodes.groupby("tree")]


def save_model(spark: SparkSession, model: Fitted, folder: str, name: str) -> str:
    """Write a model below ``folder``; an older one of the same name is replaced."""
    path = f"{folder.rstrip('/')}/{name}"
    note: dict = {"features": list(model.features)}
    if isinstance(model, FittedLog):
        note |= {"kind": "log", "coef": model.coef, "intercept": model.intercept}
    elif isinstance(model, FittedLinear):
        note |= {"kind": "linear", "coef": model.coef, "intercept": model.intercept}
    elif isinstance(model, FittedSpark):
        note |= {"kind": "spark", "importances": model.importances}
        inputs = VectorAssembler(inputCols=model.features, outputCol="__x", handleInvalid="error")
        PipelineModel([inputs, model.model.setFeaturesCol("__x")]).write().overwrite().save(f"{path}/stages")
    elif isinstance(model, FittedMedianTrees):
        note |= {"kind": "voting_trees", "weights": model.weights}
        _save_trees(spark, model.trees, path)
    elif isinstance(model, FittedNeighbors):
        note |= {"kind": "neighbors", "options": model.options}
        model.train.write.mode("overwrite").parquet(f"{path}/rows")
    elif isinstance(model, FittedTrees):
        note |= {"kind": "trees", "weights": model.weights, "base": model.base, "link": model.link, "importances": model.importances}
        _save_trees(spark, model.trees, path)
    elif isinstance(model, FittedMapped):
        name_of = next(k for k, kind in MAPS.items() if isinstance(model.mapper, kind))
        note |= {"kind": "mapped", "map": name_of, "parts": _plain(asdict(model.mapper)), "coef": _plain(np.asarray(model.coef)),
                 "intercept": model.intercept}
        if isinstance(model, FittedProcess):
            note |= {"kind": "process", "spread": _plain(model.spread), "scale": model.scale}
    elif isinstance(model, FittedWide):
        note |= {"kind": "wide", "numeric": model.numeric, "coef": model.coef, "intercept": model.intercept, "totals": model.totals}
        for i, table in enumerate(model.tables.values()):
            table.write.mode("overwrite").parquet(f"{path}/values{i}")
    elif isinstance(model, FittedBack):
        note |= {"kind": "back", "back": asdict(model.back)}
        save_model(spark, model.inner, path, "inner")
    else:
        raise TypeError(f"{type(model).__name__} is not a model of this library")
    spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")
    return path


def load_model(spark: SparkSession, folder: str, name: str) -> Fitted:
    path = f"{folder.rstrip('/')}/{name}"
    note = json.loads(spark.read.text(f"{path}/note").first()[0])
    kind, features = note["kind"], note["features"]
    if kind in ("linear", "log"):
        rule = FittedLinear(features, note["coef"], note["intercept"])
        return rule if kind == "linear" else FittedLog(rule)
    if kind == "neighbors":
        return FittedNeighbors(spark.read.parquet(f"{path}/rows"), features, note["options"])
    if kind == "trees":
        shares = note["importances"]
        return FittedTrees(features, _load_trees(spark, path), note["weights"], note["base"], note["link"], None if shares is None else [shares[c] for c in features])
    if kind in ("mapped", "process"):
        parts = features, _map_of(note), np.array(note["coef"]), note["intercept"]
        return FittedMapped(*parts) if kind == "mapped" else FittedProcess(*parts, np.array(note["spread"]), note["scale"])
    if kind == "wide":
        totals = {c: tuple(v) for c, v in note["totals"].items()}
        tables = {c: spark.read.parquet(f"{path}/values{i}") for i, c in enumerate(totals)}
        return FittedWide(note["numeric"], note["coef"], note["intercept"], tables, totals)
    if kind == "back":
        return FittedBack(load_model(spark, path, "inner"), Back(**note["back"]))
    if kind == "voting_trees":
        return FittedMedianTrees(features, _load_trees(spark, path), note["weights"])
    stages = PipelineModel.load(f"{path}/stages").stages
    if kind == "median_trees":  # as saved before the trees were flat arrays
        return FittedMedianTrees(features, [trees_of_spark(m, spark, features).trees[0] for m in stages], note["weights"])
    weights = note["importances"]
    return FittedSpark(features, stages[-1], None if weights is None else [weights[c] for c in features])
