"""Column roles that travel beside a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Roles:
    features: tuple[str, ...]
    target: str
    categorical: tuple[str, ...] = ()
    order_by: tuple[str, ...] = field(default=())
    row_id: tuple[str, ...] = field(default=())

    def __post_init__(self):
        for name in ("features", "categorical", "order_by", "row_id"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if self.target in self.features:
            raise ValueError(f"target {self.target!r} is also listed as a feature")

    @property
    def numeric(self) -> tuple[str, ...]:
        """Features that are not categorical, in column order."""
        return tuple(c for c in self.features if c not in self.categorical)

    def columns(self) -> list[str]:
        seen = dict.fromkeys((*self.features, *self.categorical, self.target))
        return list(seen)

    def with_features(self, features: Iterable[str], categorical: Sequence[str] | None = None) -> "Roles":
        cats = self.categorical if categorical is None else tuple(categorical)
        return replace(self, features=tuple(features), categorical=cats)


def select_roles(df: DataFrame, roles: Roles, keep: Sequence[str] = ()) -> DataFrame:
    """Keep features and target (plus row-id and ordering columns)."""
    if not roles.features:
        raise ValueError("no feature column is left")
    wanted = dict.fromkeys((*keep, *roles.row_id, *roles.order_by, *roles.columns()))
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    return df.select(*wanted)


def repair_selection(df: DataFrame, remembered: Sequence[str]) -> list[str]:
    """Drop remembered names that left the table; fall back to every column."""
    kept = [c for c in remembered if c in df.columns]
    return kept or list(df.columns)
