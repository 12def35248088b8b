import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_points
from check_oracle import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["resample_half_hour_mean", "resample_day_median", "iqr_filter_sequential", "impute_median", "knn_impute_exact",
           "moving_average_5", "exponential_smoothing", "train_test_split_rows", "row_statistics", "ndsi_local_extrema",
           "ordinal_encode_part_names", "coefficients_RidgeCV", "parse_day_first_dates", "prepared_table"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_contract():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) >= 90


def test_importing_needs_no_session():
    code = "import __spark_entry__ as e; e.queries(); e.oracle_sql()"
    root = os.path.dirname(os.path.abspath(entry_points.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_flagship(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["ts", "value"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    cur = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), names)


def test_permutation_importance_uses_all_repeats(spark, monkeypatch):
    from tabreg.operators import explain

    seen = []
    real = explain.permutation_importance
    monkeypatch.setattr(explain, "permutation_importance", lambda m, df, y, ids, n=10, seed=42: seen.append(n) or real(m, df, y, ids, n, seed))
    entry_points.queries()["permutation_importance"](spark, FOLDER)
    assert seen == [10]


def test_extra_trees_are_registered_with_their_defaults(spark, monkeypatch):
    """20 trees of depth 6 were fitted, of 100 of depth 10."""
    from tabreg.models.trees import ExtraTrees

    seen = []

    def fit(self, df, features, target):
        seen.append((self.params, df.count()))
        raise RuntimeError("seen")

    monkeypatch.setattr(ExtraTrees, "fit", fit)
    with pytest.raises(RuntimeError, match="seen"):
        entry_points.queries()["fit_ExtraTreesRegressor"](spark, FOLDER)
    assert seen == [(ExtraTrees.defaults, spark.read.parquet(f"{FOLDER}/lineitem.parquet").count())]
