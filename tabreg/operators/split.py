"""Exact-size, repeatable train/test split."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import q
from tabreg.operators.order import INDEX, with_row_index

def shuffle_key(row_id: Sequence[str], seed: int = 42) -> Column:
    """MD5 text of a row's id: uniform, the same in every engine, and compared without decoding."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[q(c).cast("string") for c in row_id]))


def _key_at(share: float) -> str:
    """Key below which a share of all keys lies."""
    return format(min(max(int(share * 16 ** 13), 0), 16 ** 13 - 1), "013x")


def shuffle(df: DataFrame, row_id: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows numbered in a seeded random order."""
    keyed = df.withColumn("__key", shuffle_key(row_id, seed))
    return with_row_index(keyed, ["__key", *row_id]).drop("__key")


def split_sizes(n: int, train_fraction: float) -> tuple[int, int]:
    """(train, test) with test = ceil(n * (1 - p)), in decimal arithmetic."""
    test = math.ceil(n * (1 - Decimal(str(train_fraction))))
    return n - test, test


def train_test_split(df: DataFrame, row_id: Sequence[str], train_fraction: float = 0.7,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Disjoint parts of exact size; both are filters, no row is shuffled.

    The test part is the rows with the smallest hash keys.  The cut-off row is found by counting
    below a narrow bracket and ranking only the rows inside it.  ``row_id`` must be unique.
    """
    if not row_id:
        raise ValueError("row_id columns are required")
    if not 0.0 < train_fraction < 1.0:
        raise ValueError("train_fraction must be between 0 and 1")
    key, n = shuffle_key(row_id, seed), df.count()
    _, size = split_sizes(n, train_fraction)
    if size in (0, n):
        raise ValueError("the table is too small to split")
    rank = size - 1
    slack = 3.0 / math.sqrt(n) + 2.0 / n  # six deviations of a uniform rank on either side
    lo, hi = _key_at(rank / n - slack), _key_at(rank / n + slack) + "~"
    keyed = df.select(key.alias("__key"), *[q(c) for c in row_id])
    below, upto = (F.sum(t.cast("long")) for t in (F.col("__key") < lo, F.col("__key") <= hi))
    found = keyed.agg(below, upto).first()
    if found[0] <= rank < found[1]:
        # about 6 * sqrt(n) keys: two million for a hundred billion rows
        near = keyed.where(F.col("__key").between(lo, hi)).select("__key").toPandas()["__key"]
        cut = near.sort_values().iloc[rank - found[0]]
    else:
        cut = with_row_index(keyed, ["__key", *row_id], n=n).where(F.col(INDEX) == rank).first()["__key"]
    # two ids with one MD5 are not to be expected, so the key alone decides
    return df.where(key > cut), df.where(key <= cut)
