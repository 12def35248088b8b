"""Append-only log of model runs."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FIELDS = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("missing_values_method", T.StringType()),
    T.StructField("smoothing_method", T.StringType()), T.StructField("normalization_method", T.StringType()),
    T.StructField("categorical_encoding", T.StringType()), T.StructField("model_name", T.StringType()),
    T.StructField("mae", T.DoubleType()), T.StructField("mse", T.DoubleType()), T.StructField("rmse", T.DoubleType()),
    T.StructField("r2", T.DoubleType()), T.StructField("split_percentage", T.DoubleType()),
    T.StructField("cv_folds", T.IntegerType()), T.StructField("tuning_time_seconds", T.DoubleType()),
    T.StructField("steps", T.StringType())])


class ModelLog:
    """One row per run; rows are appended, never rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log_iteration(self, record: dict) -> None:
        """Flatten ``metrics`` into columns, add the time, append; the caller's record is left as it is."""
        flat = {**record, **record.get("metrics", {})}
        flat.pop("metrics", None)
        unknown = set(flat) - set(FIELDS.names)
        if unknown:
            raise ValueError(f"unknown log fields {sorted(unknown)}")
        flat["timestamp"] = datetime.now(timezone.utc).isoformat(timespec="microseconds")
        steps = flat.get("steps")
        if steps is not None and not isinstance(steps, str):
            flat["steps"] = json.dumps(steps)
        row = []
        for f in FIELDS.fields:
            v = flat.get(f.name)
            row.append(float(v) if isinstance(f.dataType, T.DoubleType) and v is not None else v)
        self.spark.createDataFrame([tuple(row)], FIELDS).write.mode("append").parquet(self.path)

    def frame(self) -> DataFrame:
        return self.spark.read.schema(FIELDS).parquet(self.path).orderBy("timestamp")

    def write_csv(self, path: str) -> None:
        """The whole log as CSV with a header, timestamp first."""
        self.frame().write.mode("overwrite").option("header", True).csv(path)
