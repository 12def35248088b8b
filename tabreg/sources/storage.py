"""Shared storage for cut lineages and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is named (local runs)."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tabreg-")
    return _LOCAL[app]


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to shared storage and read them back: iterations do not pile up plans, and a
    lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Free the storage of a table made by ``cut_lineage`` once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path is None:
        return
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    df._cut_path = None


PIECE_ROWS = 500_000


def spread(df: DataFrame) -> DataFrame:
    """Even pieces for work that reads a table many times; a table of many files is left as it is."""
    files = len(df.inputFiles())
    return df.hint("rebalance") if files < df.sparkSession.sparkContext.defaultParallelism else df


def pieces(df: DataFrame, rows: int) -> DataFrame:
    """``spread`` for fits that hold rows as objects of many times their stored size: at most about PIECE_ROWS rows a piece."""
    many = rows > PIECE_ROWS * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(-(-rows // PIECE_ROWS)) if many else spread(df)
