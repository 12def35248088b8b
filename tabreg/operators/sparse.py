"""Dummies of columns with any number of values: one sparse vector per row instead of one column per value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import q
from tabreg.operators.encode import attach_codes, code_table
from tabreg.sources.storage import cut_lineage

PLACE = "__place"


@dataclass(frozen=True)
class SparseDummies:
    """Codes of each column's values in sorted order; column after column they number the places of one vector."""

    tables: dict[str, DataFrame]           # (value, code, rows), in shared storage
    totals: dict[str, tuple[int, int]]     # rows with a value, different values
    drop_first: bool = False

    def kept(self, c: str) -> int:
        return max(self.totals[c][1] - int(self.drop_first), 0)

    @property
    def offsets(self) -> dict[str, int]:
        at, out = 0, {}
        for c in self.tables:
            out[c] = at
            at += self.kept(c)
        return out

    @property
    def width(self) -> int:
        return sum(self.kept(c) for c in self.tables)

    def names(self) -> DataFrame:
        """(place, column, value, rows) of every place."""
        parts = [t.where(F.col("code") >= int(self.drop_first)).select(
            (F.col("code") - int(self.drop_first) + self.offsets[c]).alias("place"), F.lit(c).alias("column"), "value", "rows")
            for c, t in self.tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def with_places(self, df: DataFrame) -> DataFrame:
        """``__place0``, ``__place1``, ...: the place of each column's value; NULL for none, an unseen and a dropped one."""
        for i, (c, table) in enumerate(self.tables.items()):
            df = attach_codes(df, c, table, f"{PLACE}{i}", *self.totals[c])
            code = F.col(f"{PLACE}{i}") - int(self.drop_first)
            df = df.withColumn(f"{PLACE}{i}", F.when(code >= 0, code + self.offsets[c]))
        return df

    def places(self) -> list[Column]:
        return [F.col(f"{PLACE}{i}") for i in range(len(self.tables))]

    def transform(self, df: DataFrame, name: str = "dummies") -> DataFrame:
        """The text columns give way to one vector column of ``width`` places."""
        rest = [q(c) for c in df.columns if c not in self.tables]
        df, parts = self.with_places(df), sum(self.kept(c) > 0 for c in self.tables)
        if not parts:
            return df.select(*rest, array_to_vector(F.array().cast("array<double>")).alias(name))
        return df.select(*rest, _as_vector(_cells(self.places(), self.width, parts)).alias(name))


# the cells are those of a vector already; an encoder or assembler would also keep a name of every place on the driver
_as_vector = F.arrow_udf(lambda cells: cells, VectorUDT())


def _cells(places: Sequence[Column], width: int, parts: int) -> Column:
    """The cells of a vector with 1 at the places, in ascending order; several columns of few values take the dense form where it is
    the shorter one, as Spark's own assembler does."""
    indices = F.array_compact(F.array(*[p.cast("int") for p in places]))
    sparse = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(width).cast("int").alias("size"), indices.alias("indices"),
                      F.transform(indices, lambda _: F.lit(1.0)).alias("values"))
    if parts == 1 or 1.5 * (parts + 1) < width:
        return sparse
    every = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.array_contains(indices, k).cast("double"))
    dense = F.struct(F.lit(1).cast("byte").alias("type"), F.lit(None).cast("int").alias("size"),
                     F.lit(None).cast("array<int>").alias("indices"), every.alias("values"))
    return F.when(1.5 * (F.size(indices) + 1) < width, sparse).otherwise(dense)


def fit_sparse_dummies(df: DataFrame, cols: Sequence[str], drop_first: bool = False) -> SparseDummies:
    """Values are counted and numbered by Spark and stay in shared storage; the driver sees two counts per column."""
    tables, totals = {}, {}
    for c in cols:
        tables[c] = cut_lineage(code_table(df, c))
        row = tables[c].agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
        totals[c] = int(row[0]), int(row[1])
    return SparseDummies(tables, totals, drop_first)


def sparse_dummies(df: DataFrame, cols: Sequence[str], drop_first: bool = False, name: str = "dummies") -> DataFrame:
    """One vector of 0/1 places instead of ``cols``, values of a column in sorted order, column after column.

    A missing value gives zeros.  There is no limit on the number of values."""
    return fit_sparse_dummies(df, cols, drop_first).transform(df, name)
