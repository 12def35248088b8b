import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabreg.operators import clean, impute, profile, quantiles
from tabreg.sources.tables import read_table


@pytest.fixture
def mixed(make):
    return make(pd.DataFrame({
        "a": [1.0, -999.0, 3.0, np.nan, 5.0], "b": [1, -999, 3, 4, 5], "s": ["x", "-999", "y", None, "5"]}))


@pytest.mark.parametrize("limit", [150, 1_000_000])
def test_quantiles_match_numpy(make, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "LIMIT", limit)  # a low limit forces the narrowing scans
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=9000), "b": rng.integers(0, 3, 9000).astype(float), "c": [2.0] * 9000,
                        "hot": np.where(rng.random(9000) < 0.34, 0.5, rng.random(9000))})
    pdf.loc[::7, "a"] = np.nan
    wanted = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    got = quantiles.column_quantiles(make(pdf, 4), list(pdf), wanted)
    for c in pdf:
        np.testing.assert_allclose(got[c], pdf[c].quantile(wanted), atol=1e-12)


def test_quantiles_of_nothing(make):
    assert quantiles.column_quantiles(make(pd.DataFrame({"a": [np.nan, np.nan]})), ["a"], [0.5]) == {"a": [None]}


@pytest.mark.parametrize("limit", [150, 1_000_000])
def test_group_quantiles_match_pandas(make, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.where(rng.random(8000) < 0.4, 1, rng.integers(2, 9, 8000)), "v": rng.normal(size=8000),
                        "w": rng.integers(0, 4, 8000).astype(float)})
    pdf.loc[pdf["g"] == 3, "v"] = np.nan
    got = quantiles.group_quantiles(make(pdf), ["g"], ["v", "w"], 0.5).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")[["v", "w"]].median()
    np.testing.assert_allclose(got[["v", "w"]].astype(float), want, atol=1e-12)


def test_nan_is_null_on_load(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "x double").write.parquet(path)
    df = read_table(spark, path, "parquet")
    assert df.where("x IS NULL").count() == 2
    assert {r[0] for r in clean.remove_by_threshold(df, "x", "less than", 0.0).collect()} == {1.0, float("inf")}


def test_threshold_drops_nan_without_normalising(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (9.0,)], "x double")
    assert [r[0] for r in clean.remove_by_threshold(df, "x", "less than", 0.5).collect()] == [1.0, 9.0]
    assert clean.remove_by_threshold(df, "nope", "less than", 1.0) is df
    assert clean.remove_by_threshold(df, "x", "less than") is df


def test_unreadable_formats_are_refused(spark):
    for path in ("a.xls", "a.xlsx"):
        with pytest.raises(ValueError):
            read_table(spark, path)


def test_replace_value_hits_numbers_and_text(mixed):
    got = clean.replace_with_null(mixed, "-999").toPandas()
    assert got.isna().sum().tolist() == [2, 1, 2]
    many = clean.replace_with_null(mixed, "-999, 5, x").toPandas()
    assert many.isna().sum().tolist() == [3, 2, 4]


def test_replace_range_reads_text_as_numbers(mixed):
    got = clean.replace_range_with_null(mixed, 4, 6).toPandas()
    assert got.isna().sum().tolist() == [2, 2, 2]
    report = {r["column"]: (r["replaced"], r["checked"]) for r in clean.range_report(mixed, 4, 6).collect()}
    assert report == {"a": (1, True), "b": (2, True), "s": (1, True)}


@pytest.mark.parametrize("multiplier", [1.0, 1.5, 3.0])
def test_iqr_is_sequential_like_pandas(make, multiplier):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.standard_t(2, 800), "b": rng.integers(0, 100, 800) ** 3, "c": rng.standard_t(1, 800)})
    pdf.loc[::31, "c"] = np.nan
    want = pdf
    for c in ("a", "b", "c"):
        lo, hi = want[c].quantile([0.25, 0.75])
        want = want[(want[c] >= lo - multiplier * (hi - lo)) & (want[c] <= hi + multiplier * (hi - lo))]
    got = clean.remove_outliers_iqr(make(pdf), ["a", "missing", "b", "c"], multiplier)
    assert got.count() == len(want)
    with pytest.raises(ValueError):
        clean.remove_outliers_iqr(make(pdf), ["a"], 4.0)


def test_int32_columns_are_filtered_too(spark):
    df = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 1000]], "x int")
    assert clean.remove_outliers_iqr(df, ["x"]).count() == 4


def test_drop_null_rows_and_columns(mixed):
    assert clean.drop_null_rows(mixed).count() == 4
    assert clean.drop_null_columns(mixed).columns == ["b"]


def test_drop_first_rows(make):
    pdf = pd.DataFrame({"k": range(50)})
    got = clean.drop_first_rows(make(pdf), 7, ["k"]).orderBy("k").collect()
    assert [(r["k"], r["__idx"]) for r in got] == [(k, k - 7) for k in range(7, 50)]
    with pytest.raises(ValueError):
        clean.drop_first_rows(make(pdf), 0, ["k"])


def test_profile(mixed):
    assert {r["column"]: r["nulls"] for r in profile.null_counts(mixed).collect()} == {"a": 1, "b": 0, "s": 1, "__total__": 2}
    assert profile.column_kinds(mixed) == {"numeric": ["a", "b"], "text": ["s"], "other": []}
    assert profile.shape(mixed).first().asDict() == {"rows": 5, "columns": 3}


def test_cardinality_rule_is_more_than_eleven(make):
    pdf = pd.DataFrame({"e": [f"v{i % 11}" for i in range(24)], "t": [f"v{i % 12}" for i in range(24)]})
    assert profile.cardinality_split(make(pdf), ["e", "t"]) == (["e"], ["t"])


def test_imputation_matches_pandas(make):
    pdf = pd.DataFrame({"a": [1.0, 2.0, np.nan, 10.0], "b": [3.0, np.nan, 3.0, 1.0], "n": [1, 2, 3, 4], "s": ["q", None, "p", "p"]})
    df = make(pdf)
    for method, fill in (("mean", pdf[["a", "b"]].mean()), ("median", pdf[["a", "b"]].median()), ("zero", {"a": 0, "b": 0})):
        got = impute.impute(df, method)
        assert got.schema["n"].dataType.simpleString() == "bigint"
        pd.testing.assert_frame_equal(got.toPandas().sort_values("n").reset_index(drop=True), pdf.fillna(fill), check_dtype=False)
    got = impute.impute(df, "mode").toPandas().sort_values("n").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, pdf.fillna(pdf.mode().iloc[0]), check_dtype=False)
    assert impute.impute(df, "drop_rows").count() == 2
    assert impute.impute(df, "drop_cols").columns == ["n"]
    with pytest.raises(ValueError):
        impute.impute(df, "guess")


def test_mode_ties_pick_the_smallest(make):
    pdf = pd.DataFrame({"x": [2.0, 2.0, 1.0, 1.0, 3.0], "s": ["b", "a", "b", "a", "c"], "i": [9, 9, 4, 4, 5]})
    assert impute.column_modes(make(pdf)) == {"x": 1.0, "s": "a", "i": 4}


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "a double, s string")
    assert impute.impute(empty, "mean").count() == 0
    assert clean.remove_outliers_iqr(empty, ["a"]).count() == 0
    assert {r["nulls"] for r in profile.null_counts(empty).collect()} == {0}
    one = spark.createDataFrame([(1.5, "x")], "a double, s string")
    assert profile.basic_statistics(one).first()["std"] is None
    assert clean.remove_outliers_iqr(one, ["a"]).count() == 1


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("unused")).write.parquet(path)
    df = clean.remove_by_threshold(read_table(spark, path, normalise_nan=False), "x", "greater than", 5.0).select("x")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(x,5.0)" in plan and "unused" not in plan


def test_modes_of_every_type(spark):
    from datetime import date, datetime
    rows = [(True, date(2020, 1, 1), datetime(2020, 1, 1, 5), 1), (True, date(2020, 1, 2), datetime(2020, 1, 1, 5), 2),
            (False, date(2020, 1, 2), datetime(2021, 1, 1), 3), (None, None, None, 4)]
    df = spark.createDataFrame(rows, "b boolean, d date, t timestamp, n int").repartition(3)
    df = df.withColumn("u", df["t"].cast("timestamp_ntz"))
    got = impute.column_modes(df, ["b", "d", "t", "u"])
    assert got == {"b": True, "d": date(2020, 1, 2), "t": datetime(2020, 1, 1, 5), "u": datetime(2020, 1, 1, 5)}
    filled = impute.impute(df, "mode").filter("n = 4").first()
    assert (filled.b, filled.d, filled.t, filled.u) == (True, date(2020, 1, 2), datetime(2020, 1, 1, 5), datetime(2020, 1, 1, 5))
    assert impute.impute(df, "mode").dtypes == df.dtypes
