"""Global order without a single-partition stage.

A sorted table is cut into range buckets whose bounds are taken from a bounded key sample and then
written into the plan as literals.  Bucket membership is therefore a plain expression of the row:
nothing has to be cached, and a lost executor recomputes exactly the same buckets.  Full key tuples
are compared, so one hot value of the leading key is still split by the tie-breaking keys.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabreg.functions.columns import q

BUCKET = "__bucket"
HALO = "__halo"
INDEX = "__idx"

ROWS_PER_BUCKET = 1_000_000
MIN_ROWS_PER_BUCKET = 10_000
MAX_BUCKETS = 4_000
SAMPLE_PER_BUCKET = 60


@dataclass(frozen=True)
class Buckets:
    """A DataFrame with a bucket column, plus the number of rows of every bucket."""

    df: DataFrame
    order_by: tuple[str, ...]
    counts: tuple[int, ...]

    @property
    def rows(self) -> int:
        return sum(self.counts)

    @property
    def offsets(self) -> list[int]:
        out, total = [], 0
        for c in self.counts:
            out.append(total)
            total += c
        return out

    def window(self):
        return Window.partitionBy(BUCKET).orderBy(*[q(k) for k in self.order_by])

    def offset(self) -> Column:
        return pick(self.offsets, F.col(BUCKET))


def pick(values: Sequence[int], index: Column) -> Column:
    """``values[index]`` for a short driver-side list of whole numbers."""
    return F.get(F.expr(f"array({', '.join(f'{v}L' for v in values)})"), index)


def bucket_target(df: DataFrame, n: int, rows_per_bucket: int) -> int:
    cores = df.sparkSession.sparkContext.defaultParallelism
    by_size = -(-n // rows_per_bucket)
    by_cores = min(cores, n // min(MIN_ROWS_PER_BUCKET, rows_per_bucket))
    return max(1, min(MAX_BUCKETS, max(by_size, by_cores)))


def _sampled_bounds(df: DataFrame, keys: Sequence[str], n: int, b: int) -> list[tuple]:
    """At most b-1 key tuples that cut the table into about equal parts."""
    plain = (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType)
    kinds = [df.schema[k].dataType for k in keys]
    shown = [q(k) if isinstance(t, plain) and not isinstance(t, T.DecimalType) else q(k).cast("string")
             for k, t in zip(keys, kinds)]
    share = min(1.0, 1.5 * SAMPLE_PER_BUCKET * b / n)
    picked = df.select(*[q(k) for k in keys])
    if share < 1.0:
        picked = picked.sample(share, seed=42)
    rows = picked.orderBy(*[q(k) for k in keys]).select(*shown).collect()
    if not rows:
        return []
    cuts = [tuple(rows[len(rows) * i // b]) for i in range(1, b)]
    return list(dict.fromkeys(cuts))


def _position(key: Column, bounds: list[Column], first: int) -> Column:
    """Number of bounds at or below the key, as a shallow tree of CASE branches."""
    if not bounds:
        return F.lit(first)
    width = 1 if len(bounds) <= 64 else -(-len(bounds) // 64)
    out = None
    for start in range(0, len(bounds), width):
        block = bounds[start:start + width]
        inner = _position(key, block[:-1], first + start)
        test = key < block[-1]
        out = F.when(test, inner) if out is None else out.when(test, inner)
    return out.otherwise(F.lit(first + len(bounds)))


def order_buckets(df: DataFrame, order_by: Sequence[str], *, min_rows: int = 0,
                  rows_per_bucket: int = ROWS_PER_BUCKET, n: int | None = None) -> Buckets:
    """Cut ``df`` into ordered buckets of at least ``min_rows`` rows each."""
    keys = tuple(order_by)
    if not keys:
        raise ValueError("an order-dependent operator needs order_by columns")
    n = df.count() if n is None else n
    b = bucket_target(df, n, rows_per_bucket)
    if b == 1:
        return Buckets(df.withColumn(BUCKET, F.lit(0)), keys, (n,))
    kinds = [df.schema[k].dataType for k in keys]
    bounds = [F.struct(*[F.lit(v).cast(t) for v, t in zip(cut, kinds)])
              for cut in _sampled_bounds(df, keys, n, b)]
    key = F.struct(*[q(k) for k in keys])
    raw = df.withColumn(BUCKET, _position(key, bounds, 0))
    found = {r[0]: r[1] for r in raw.groupBy(BUCKET).count().collect()}
    merged, counts = [], []
    for i in range(len(bounds) + 1):
        if not counts or counts[-1] >= max(min_rows, 1):
            counts.append(0)
        counts[-1] += found.get(i, 0)
        merged.append(len(counts) - 1)
    if len(counts) > 1 and counts[-1] < max(min_rows, 1):
        counts[-2] += counts.pop()
        merged = [min(m, len(counts) - 1) for m in merged]
    if merged != list(range(len(merged))):
        # neighbouring small buckets become one: renumber by the first raw bucket of each group
        starts = [merged.index(m) for m in range(len(counts))]
        kept = [bounds[s - 1] for s in starts[1:]]
        raw = df.withColumn(BUCKET, _position(key, kept, 0))
    return Buckets(raw, keys, tuple(counts))


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = INDEX, **options) -> DataFrame:
    """Zero-based position of every row in the given order."""
    parts = order_buckets(df, order_by, **options)
    position = parts.offset() + F.row_number().over(parts.window()).cast("long") - 1
    return parts.df.withColumn(name, position).drop(BUCKET)


def with_halo(parts: Buckets, before: int, after: int) -> DataFrame:
    """Add to every bucket copies of the neighbouring rows that a moving window reaches.

    The copies come from a row_number limit per bucket, which Spark applies before its shuffle, so
    at most (before + after) rows per bucket travel twice.  Result columns: HALO and INDEX.
    """
    base = parts.df.withColumn(HALO, F.lit(False))
    pieces = [base]
    last = len(parts.counts) - 1
    if last > 0:
        keys = [q(k) for k in parts.order_by]
        for size, step, order in ((before, 1, [k.desc_nulls_last() for k in keys]),
                                  (after, -1, [k.asc_nulls_first() for k in keys])):
            if size <= 0:
                continue
            near = (base.withColumn("__rank", F.row_number().over(Window.partitionBy(BUCKET).orderBy(*order)))
                    .where(F.col("__rank") <= size).drop("__rank")
                    .withColumn(BUCKET, F.col(BUCKET) + step).withColumn(HALO, F.lit(True))
                    .where(F.col(BUCKET).between(0, last)))
            pieces.append(near)
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    shifts = [off - (before if i else 0) for i, off in enumerate(parts.offsets)]
    position = pick(shifts, F.col(BUCKET)) + F.row_number().over(parts.window()).cast("long") - 1
    return out.withColumn(INDEX, position)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(HALO, BUCKET, INDEX)


def locate(offsets: Sequence[int], index: int) -> int:
    """Bucket that holds a global position."""
    return bisect_right(offsets, index) - 1
