"""Seeded permutations without a sort.

``permuted_position`` is a bijection of [0, n) for every seed. ``random_blocks`` deals rows with random positions into blocks of bounded
size, written once; inside a block any number of columns can then be shuffled, each in its own way, with no join. As a row's block is
itself random, so is the row whose value it gets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.operators.order import INDEX
from tabreg.sources.storage import cut_lineage

BLOCK_ROWS = 4_096
BLOCK_CELLS = 1 << 20


def permuted_position(index: Column, n: int, seed: int) -> Column:
    """Partner position of a row: swap-or-not rounds (Hoang, Morris & Rogaway 2012), a bijection of [0, n) for any n."""
    rounds = 6 * max(1, math.ceil(math.log2(max(n, 2))))
    keys = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda i: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(max(n, 1))))

    def one(at: Column, key: Column) -> Column:
        other = F.pmod(key - at, F.lit(max(n, 1)))
        return F.when(F.xxhash64(key, F.greatest(at, other), F.lit(seed)) % 2 == 0, other).otherwise(at)

    return F.aggregate(keys, index.cast("long"), one)


def random_blocks(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(block, one array per column) of rows that have a random position in INDEX, in the order of positions."""
    size = max(64, min(BLOCK_ROWS, BLOCK_CELLS // max(len(columns), 1)))
    block = F.floor(F.col(INDEX) / F.lit(size)).alias("block")
    held = rows.groupBy(block).agg(F.array_sort(F.collect_list(F.struct(INDEX, *[F.col(f"`{c}`") for c in columns]))).alias("rows"))
    return cut_lineage(held.select("block", *[F.col("rows").getField(c).alias(c) for c in columns]))


def from_blocks(blocks: DataFrame, columns: Sequence[str], schema: str,
                make: Callable[[int, list[np.ndarray]], Iterable[list[np.ndarray]]]) -> DataFrame:
    """Rows made of every block: ``make(block, its columns)`` gives lists of new columns."""
    names = [part.strip().split(" ")[0].strip("`") for part in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in enumerate(batch.column(0).to_pylist()):
                held = [batch.column(i + 1)[k].values.to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))]
                for made in make(block, held):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in made], names)

    return blocks.select("block", *[f"`{c}`" for c in columns]).mapInArrow(run, schema)


def shuffler(seed: int, *salts: int) -> np.random.Generator:
    """The same generator for the same seed and salts, in any task."""
    return np.random.default_rng([seed, *salts])
