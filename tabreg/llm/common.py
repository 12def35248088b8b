"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabreg.sources.shipping import ship_package
from tabreg.sources.storage import cut_lineage, discard, shared_path

__all__ = ["crc_fold", "cut_lineage", "discard", "few_ids", "narrow", "pieces_of_batches", "release_memory", "salted_lookup", "shared_path",
           "ship_package", "table", "train_rows", "with_ids", "without_ids"]

SALTS = 64
FEW_IDS = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast, under the operator's own names; whatever else a table holds cannot clash.

    ``columns`` maps a name to ``"source column:type"``."""
    return df.select(*[F.col(f"`{c.rpartition(':')[0]}`").cast(c.rpartition(":")[2]).alias(n) for n, c in columns.items()])


def crc_fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; fold 0 is held out. A NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def train_rows(labels: DataFrame, value: str) -> DataFrame:
    """One 0/1 label per id outside the held-out fold. Repeated rows agree by their largest label; NULLs teach nothing."""
    got = narrow(labels, doc_id="doc_id:long", label=f"{value}:int")
    return (got.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_fold(F.col("doc_id")) != 0))
            .groupBy("doc_id").agg(F.max("label").alias("label")))


def pieces_of_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``limit`` bytes at most; a longer single value stays whole."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def release_memory() -> None:
    """Give memory that earlier tasks of this worker process left over back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's, where it has one
    if trim:
        trim(0)


def salted_lookup(rows: DataFrame, key: str, facts: list[Column], spread_by: str, keep: Column | None = None) -> DataFrame:
    """Join each row with facts about its whole key group, however many rows one key has.

    ``facts`` are aggregates (named with alias) that can be taken in two steps (min, max, sum of the same column): they are
    taken per (key, salt) first, then per key; each key's facts go back only to the salts it occurs in (``SALTS`` at most), so
    a hot key is dealt over that many tasks. ``keep`` filters the key groups."""
    salt = f"__salt_{key}"
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(F.col(spread_by)), F.lit(SALTS)).cast("int"))
    parts = rows.groupBy(key, salt).agg(*facts)
    names = [c for c in parts.columns if c not in (key, salt)]
    again = {n: (F.sum if n.startswith("n_") else F.max if n.startswith("max_") else F.min) for n in names}
    whole = parts.groupBy(key).agg(*[f(n).alias(n) for n, f in again.items()], F.collect_set(salt).alias("__salts"))
    if keep is not None:
        whole = whole.filter(keep)
    whole = whole.select(F.col(key).alias("__k"), F.explode("__salts").alias("__s"), *names)
    return (rows.join(whole, (F.col(key) == F.col("__k")) & (F.col(salt) == F.col("__s")), "inner")
            .drop("__k", "__s", salt))


def few_ids(ids: DataFrame) -> DataFrame:
    """The ids with a broadcast hint if they are counted as few (16 MB of numbers); else as they are, for a shuffle join."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def _by_id(df: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    name = "__id"
    while name in df.columns:
        name += "_"
    ids = ids.select(F.col(ids.columns[0]).alias(name)).distinct()
    return df.join(few_ids(ids), F.col(f"`{column}`").cast("long") == F.col(name), how)


def with_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is in the one-column table ``ids``; wide rows move only where there are many ids."""
    return _by_id(df, column, ids, "left_semi")


def without_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is not in the one-column table ``ids``, rows with a NULL among them."""
    return _by_id(df, column, ids, "left_anti")
