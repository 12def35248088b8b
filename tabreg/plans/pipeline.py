"""A preparation plan: named steps with arguments, applied lazily and kept as JSON beside the results."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tabreg.functions.columns import numeric_columns
from tabreg.operators import clean, encode, impute, reduce, rowstats, select, smooth, sparse, spectral, timeops, wrappers
from tabreg.operators.order import INDEX
from tabreg.roles import Roles, select_roles

Step = Callable[..., tuple[DataFrame, Roles]]
STEPS: dict[str, Step] = {}


def step(fn: Step) -> Step:
    STEPS[fn.__name__] = fn
    return fn


def _plain(name: str, call: Callable) -> None:
    def run(df, roles, **args):
        return call(df, **args), roles

    STEPS[name] = run


_plain("replace_with_null", clean.replace_with_null)
_plain("replace_range_with_null", clean.replace_range_with_null)
_plain("remove_outliers_iqr", clean.remove_outliers_iqr)
_plain("remove_by_threshold", clean.remove_by_threshold)
_plain("parse_datetime", timeops.parse_datetime)
_plain("resample", timeops.resample)


@step
def drop_first_rows(df, roles, n):
    return clean.drop_first_rows(df, n, roles.order_by).drop(INDEX), roles


@step
def select_columns(df, roles):
    return select_roles(df, roles), roles


@step
def impute_missing(df, roles, method="mean", k=5, features_only=False):
    cols = [c for c in roles.features if c in numeric_columns(df) or method == "mode"] if features_only else None
    out = impute.impute(df, method, k, roles.row_id, cols)
    return out, roles.with_features([c for c in roles.features if c in out.columns],
                                    [c for c in roles.categorical if c in out.columns])


@step
def smooth_features(df, roles, method="moving_average", window_size=3, alpha=0.3, fraction=None):
    """Features only: the target is left as it is."""
    if method == "lowess" and fraction is not None:
        window_size = int(fraction * df.count())
    cols = [c for c in roles.numeric if c in numeric_columns(df)]
    return smooth.smooth(df, method, roles.order_by, window_size, alpha, cols), roles


@step
def encode_categories(df, roles, method="one_hot", drop_first=False):
    cats = [c for c in roles.categorical if df.schema[c].dataType.typeName() == "string"]
    if method == "label":
        return encode.label_encode(df, cats), roles.with_features(roles.features, ())
    if method == "sparse":  # one vector column, for models that take vectors
        kept = [c for c in roles.features if c not in cats]
        return sparse.sparse_dummies(df, cats, drop_first), roles.with_features(kept, [c for c in roles.categorical if c not in cats])
    fitted = encode.fit_one_hot(df, cats, drop_first)
    names = [n for c in cats for n in fitted.names(c)]
    kept = [c for c in roles.features if c not in cats]
    return fitted.transform(df), roles.with_features([*kept, *names], [c for c in roles.categorical if c not in cats])


@step
def scale_features(df, roles, kind="standard"):
    """All rows decide the scale; dummy columns are scaled too, the target is not."""
    cols = [c for c in roles.features if c in numeric_columns(df)]
    return encode.scale(df, cols, kind), roles


@step
def principal_components(df, roles, variance_percentage=98.0):
    return reduce.pca(df, roles, variance_percentage)


@step
def row_statistics(df, roles):
    return rowstats.row_features(df, roles), roles.with_features(rowstats.STATISTICS)


@step
def band_indices(df, roles, pairs):
    keep = list(dict.fromkeys((*roles.row_id, *roles.order_by, *roles.categorical, roles.target)))
    out = spectral.ndsi_apply(df, [tuple(p) for p in pairs], keep)
    return out, roles.with_features([f"{a}-{b}" for a, b in pairs])


@step
def best_features(df, roles, k):
    return select.select_k_best(df, roles, k)


@step
def recursive_elimination(df, roles, n):
    return wrappers.rfe(df, roles, n)


@step
def all_relevant(df, roles, max_iter=100, alpha=0.05):
    return wrappers.boruta_select(df, roles, max_iter=max_iter, alpha=alpha)


@dataclass(frozen=True)
class PipelineSpec:
    """Ordered (name, arguments) records."""

    steps: tuple[tuple[str, dict], ...] = field(default=())

    def then(self, name: str, **args) -> "PipelineSpec":
        if name not in STEPS:
            raise ValueError(f"unknown step {name!r}; choose from {sorted(STEPS)}")
        return PipelineSpec((*self.steps, (name, args)))

    def apply(self, df: DataFrame, roles: Roles) -> tuple[DataFrame, Roles]:
        for name, args in self.steps:
            df, roles = STEPS[name](df, roles, **args)
        return df, roles

    def to_json(self) -> str:
        return json.dumps([{"step": n, **a} for n, a in self.steps])

    @staticmethod
    def from_json(text: str) -> "PipelineSpec":
        spec = PipelineSpec()
        for record in json.loads(text):
            args = dict(record)
            spec = spec.then(args.pop("step"), **args)
        return spec


class kept:
    """Hold a table in memory and on disk inside a ``with`` block, and release it afterwards."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __enter__(self) -> DataFrame:
        return self.df.persist(StorageLevel.MEMORY_AND_DISK)

    def __exit__(self, *exc) -> None:
        self.df.unpersist()
