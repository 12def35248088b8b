import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabreg.operators import lowess, order, smooth, split

SMALL = {"rows_per_bucket": 20}


def signal(n=157, seed=1, gaps=True):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(size=n))
    if gaps:
        x[[0, 1, 5, 50, 51, 52, n - 1]] = np.nan
    return pd.DataFrame({"t": np.arange(n) // 3, "k": np.arange(n), "x": x})


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_row_index_is_the_sorted_position(make, parts):
    pdf = pd.DataFrame({"a": [7] * 90 + list(range(60)), "b": range(150)})
    got = order.with_row_index(make(pdf, parts), ["a", "b"], **SMALL).toPandas().sort_values(["a", "b"])
    assert list(got["__idx"]) == list(range(150))


def test_hot_leading_key_is_split(make):
    pdf = pd.DataFrame({"a": [1] * 400, "b": range(400)})
    parts = order.order_buckets(make(pdf), ["a", "b"], **SMALL)
    assert len(parts.counts) > 10 and max(parts.counts) < 80 and sum(parts.counts) == 400


def test_null_keys_sort_first(make):
    pdf = pd.DataFrame({"a": [np.nan, 3.0, 1.0, np.nan, 2.0] * 20, "b": range(100)})
    got = order.with_row_index(make(pdf), ["a", "b"], **SMALL).orderBy("__idx").toPandas()
    assert got["a"].isna().tolist() == [True] * 40 + [False] * 60
    assert got["a"].dropna().is_monotonic_increasing


@pytest.mark.parametrize("w", [1, 2, 3, 4, 7, 21])
@pytest.mark.parametrize("parts", [1, 37])
def test_moving_average_matches_pandas(make, w, parts):
    pdf = signal()
    got = smooth.moving_average(make(pdf, parts), w, ["t", "k"], ["x"], **SMALL).toPandas().sort_values("k")
    want = pdf["x"].rolling(w, center=True).mean()
    np.testing.assert_allclose(got["x"], want, atol=1e-9)


@pytest.mark.parametrize("alpha", [0.05, 0.3, 1.0])
@pytest.mark.parametrize("parts", [1, 4])
def test_exponential_matches_pandas(make, alpha, parts):
    pdf = signal()
    got = smooth.exponential(make(pdf, parts), alpha, ["t", "k"], ["x"], **SMALL).toPandas().sort_values("k")
    np.testing.assert_allclose(got["x"].astype(float), pdf["x"].ewm(alpha=alpha).mean(), rtol=1e-9)


def test_exponential_cuts_big_buckets_by_position(make, monkeypatch):
    monkeypatch.setattr(smooth, "CHUNK_ROWS", 7)
    pdf = signal()
    for alpha in (0.3, 1.0):
        got = smooth.exponential(make(pdf), alpha, ["t", "k"], ["x"], **SMALL).toPandas().sort_values("k")
        np.testing.assert_allclose(got["x"].astype(float), pdf["x"].ewm(alpha=alpha).mean(), rtol=1e-9)


def test_exponential_refuses_zero(make):
    with pytest.raises(ValueError):
        smooth.exponential(make(signal()), 0.0, ["k"])


@pytest.mark.parametrize("w", [5, 9])
@pytest.mark.parametrize("n", [9, 10, 157])
def test_savgol_matches_local_cubic_fits(make, w, n):
    pdf = signal(n, gaps=False)
    x, half = pdf["x"].to_numpy(), w // 2
    want = np.empty(n)
    for i in range(n):
        start = min(max(i - half, 0), n - w)
        at = np.arange(w)
        want[i] = np.polyval(np.polyfit(at, x[start:start + w], 3), i - start)
    got = smooth.savitzky_golay(make(pdf), w, ["k"], ["x"], **SMALL).toPandas().sort_values("k")
    np.testing.assert_allclose(got["x"], want, atol=1e-8)


def test_savgol_needs_a_wide_window(make):
    with pytest.raises(ValueError):
        smooth.savitzky_golay(make(signal()), 3, ["k"])
    with pytest.raises(ValueError):
        smooth.savitzky_golay(make(signal(4, gaps=False)), 5, ["k"], ["x"])


def reference_lowess(y, k, rounds=3):
    """Straight loop over rows, written from the published definition."""
    n, x, robust = len(y), np.arange(len(y), dtype=float), np.ones(len(y))
    fit = np.zeros(n)
    for r in range(rounds + 1):
        for i in range(n):
            left = 0
            while left + k < n and x[i] > (x[left] + x[left + k]) / 2:
                left += 1
            j = np.arange(left, left + k)
            h = max(x[i] - x[left], x[left + k - 1] - x[i])
            u = np.abs(x[j] - x[i]) / h
            w = np.where(u > .999, 0, np.where(u < .001, 1, (1 - u ** 3) ** 3)) * robust[j]
            sw = w.sum()
            mx, my = (w * x[j]).sum() / sw, (w * y[j]).sum() / sw
            sxx = (w * (x[j] - mx) ** 2).sum()
            fit[i] = my + (w * (x[j] - mx) * y[j]).sum() / sxx * (x[i] - mx)
        if r < rounds:
            e = np.abs(y - fit)
            u = e / (6 * np.median(e))
            robust = np.where(u > .999, 0, np.where(u < .001, 1, (1 - u ** 2) ** 2))
    return fit


@pytest.mark.parametrize("k", [10, 31])
def test_lowess_is_exact_on_small_tables(make, k):
    pdf = signal(120, gaps=False)
    pdf.loc[40, "x"] += 30
    got = lowess.lowess(make(pdf), k, ["k"], ["x"], **SMALL).toPandas().sort_values("k")
    np.testing.assert_allclose(got["x"], reference_lowess(pdf["x"].to_numpy(), k), atol=1e-6)


@pytest.mark.parametrize("k", [9, 80, 250, 400])
def test_lowess_is_exact_across_chunks_and_keeps_gaps(make, k):
    pdf = signal(400, gaps=False)
    pdf.loc[[7, 150, 399], "x"] -= 40
    got = lowess.lowess(make(pdf), k, ["k"], ["x"], chunk=60, **SMALL).toPandas().sort_values("k")
    np.testing.assert_allclose(got["x"], reference_lowess(pdf["x"].to_numpy(), k), atol=1e-6)
    holes = lowess.lowess(make(signal(120)), 20, ["k"], ["x"], **SMALL).toPandas().sort_values("k")
    assert holes["x"].isna().tolist() == signal(120)["x"].isna().tolist()


@pytest.mark.parametrize("n", [3_999, 4_001, 40_000])
def test_lowess_does_not_change_with_size(spark, n):
    from pyspark.sql import functions as F

    table = spark.range(n).select(F.col("id").alias("k"), (F.sin(F.col("id") * 2 * np.pi / 40) + F.pmod("id", F.lit(7)) / 20).alias("x"))
    got = lowess.lowess(table, 11, ["k"], ["x"], robust_rounds=0).toPandas().sort_values("k")["x"].to_numpy()
    y = np.sin(np.arange(n) * 2 * np.pi / 40) + np.arange(n) % 7 / 20
    for i in (0, 3, n // 2, n - 2):  # the definition at some rows
        left = int(np.clip(np.ceil(i - 5.5), 0, n - 11))
        j = np.arange(left, left + 11)
        u = np.abs(j - i) / max(i - left, left + 10 - i)
        w = np.where(u > .999, 0, np.where(u < .001, 1, (1 - u ** 3) ** 3))
        line = np.polyfit(j - i, y[j], 1, w=np.sqrt(w))
        assert abs(got[i] - line[1]) < 1e-9


def test_no_single_partition_stage(make):
    df = make(signal())
    for out in (smooth.moving_average(df, 5, ["k"], ["x"], **SMALL), smooth.savitzky_golay(df, 5, ["k"], ["x"], **SMALL),
                order.with_row_index(df, ["k"], **SMALL)):
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n,p", [(10, 0.7), (157, 0.8), (1000, 0.33)])
def test_split_sizes_and_repeatability(make, n, p):
    pdf = pd.DataFrame({"id": range(n), "v": range(n)})
    sets = []
    for parts in (1, 4, 37):
        train, test = split.train_test_split(make(pdf, parts), ["id"], p)
        a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
        assert not a & b and len(a | b) == n
        assert (len(a), len(b)) == split.split_sizes(n, p)
        sets.append(b)
    assert sets[0] == sets[1] == sets[2]
    assert split.split_sizes(10, 0.7) == (7, 3)


def test_split_is_shuffle_free(make):
    train, _ = split.train_test_split(make(pd.DataFrame({"id": range(200)})).select("id"), ["id"])
    plan = train.select(F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
