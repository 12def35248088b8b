import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabreg.models import wide
from tabreg.models.linear import Ridge
from tabreg.models.wide import WideRidge
from tabreg.operators import encode, sparse
from tabreg.sources.artifacts import load_model, save_model


def mixed(n=300, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": range(n), "x": rng.normal(50, 2, n), "z": rng.normal(-1, 30, n)})
    for c, k in zip("abc", (2, 7, 25)):
        pdf[c] = [f"{c}{v}" for v in rng.integers(0, k, n)]
    pdf.loc[rng.integers(0, n, 20), "c"] = None
    pdf["y"] = 3 * pdf["x"] - pdf["z"] / 7 + pdf["b"].str[1:].astype(int) * 2 + rng.normal(size=n)
    return pdf


@pytest.mark.parametrize("drop", [False, True])
@pytest.mark.parametrize("small", [0, 1000])
def test_vectors_equal_dense_dummies(make, monkeypatch, drop, small):
    monkeypatch.setattr(encode, "SMALL_CODE_TABLE", small)
    df = make(mixed())
    got = sparse.sparse_dummies(df, ["a", "b", "c"], drop)
    assert got.columns == ["id", "x", "z", "y", "dummies"]
    rows = got.select("id", vector_to_array("dummies").alias("v")).toPandas().sort_values("id")
    want = encode.one_hot(df, ["a", "b", "c"], drop).toPandas().sort_values("id")
    names = [c for c in want.columns if c[0] in "abc"]
    np.testing.assert_array_equal(np.stack(rows["v"]), want[names].to_numpy())


def test_missing_single_and_unseen_values(make, spark):
    train = make(pd.DataFrame({"s": ["u", "u", None], "t": [None, None, None], "id": range(3)}).astype({"t": object}))
    fitted = sparse.fit_sparse_dummies(train, ["s", "t"])
    assert fitted.width == 1 and [tuple(r) for r in fitted.names().collect()] == [(0, "s", "u", 2)]
    new = make(pd.DataFrame({"s": ["u", "w", None], "t": ["k", None, None], "id": range(3)}))
    rows = fitted.transform(new).select("id", vector_to_array("dummies").alias("v")).orderBy("id").collect()
    assert [r["v"] for r in rows] == [[1.0], [0.0], [0.0]]
    empty = sparse.sparse_dummies(train.where("id > 5"), ["s", "t"])
    assert empty.count() == 0 and empty.columns == ["id", "dummies"]
    bare = sparse.fit_sparse_dummies(train.where("id > 5"), ["s"]).transform(train.select("s", "id"))
    assert [len(r["v"]) for r in bare.select(vector_to_array("dummies").alias("v")).collect()] == [0, 0, 0]


def test_the_plan_names_no_places(make, monkeypatch):
    """Names of the places would fill the driver: one per value, in the schema of every plan."""
    df = make(mixed())
    for small in (0, 1000):
        monkeypatch.setattr(encode, "SMALL_CODE_TABLE", small)
        got = sparse.sparse_dummies(df, ["a", "b", "c"])
        assert not got.schema["dummies"].metadata and len(got.schema.json()) < 2_000
        vectors = [r["dummies"] for r in got.collect()]
        assert {v.size for v in vectors} == {2 + 7 + 25} and {len(v.indices) for v in vectors} == {2, 3}


@pytest.mark.parametrize("cols", [["a"], ["a", "b"], ["a", "c"]])
def test_forms_are_those_of_the_assembler(make, cols):
    """Few places in all are dense, one column alone and many places sparse."""
    from pyspark.ml.feature import VectorAssembler

    df = make(mixed().assign(c=lambda t: t["c"].where(t["c"].isin(["c1", "c2"]), None)))
    got = sparse.sparse_dummies(df, cols).orderBy("id")
    parts = [f"v{i}" for i in range(len(cols))]
    for i, c in enumerate(cols):
        alone = sparse.sparse_dummies(df.select("id", c), [c], name=f"v{i}").withColumnRenamed("id", f"id{i}")
        got = got.join(alone, F.col("id") == F.col(f"id{i}"))
    want = VectorAssembler(inputCols=parts, outputCol="want").transform(got) if len(cols) > 1 else got.withColumn("want", F.col("v0"))
    rows = want.select("dummies", "want").collect()
    assert len(rows) == 300 and all(type(r["dummies"]) is type(r["want"]) and r["dummies"] == r["want"] for r in rows)


def test_ridge_equals_the_dense_one(make):
    df = make(mixed())
    got = WideRidge(alpha=2.0).fit(df, ["x", "z", "a", "b", "c"], "y")
    assert got.info["residual"] <= 1e-10
    dense = encode.one_hot(df, ["a", "b", "c"])
    names = ["x", "z", *[c for c in dense.columns if c[0] in "abc"]]
    want = Ridge(alpha=2.0).fit(dense, names, "y")
    a = got.predict(df).select("id", "prediction").toPandas().sort_values("id")["prediction"]
    b = want.predict(dense).select("id", "prediction").toPandas().sort_values("id")["prediction"]
    np.testing.assert_allclose(a.to_numpy(), b.to_numpy(), rtol=0, atol=1e-6)
    np.testing.assert_allclose(got.coef, want.coef[:2], atol=1e-7)


def test_long_directions_are_shuffled_to_the_same_result(make, monkeypatch):
    df, found = make(mixed()), []
    for limit in (1_000_000, 0):
        monkeypatch.setattr(wide, "SMALL_DIRECTION", limit)
        model = WideRidge(max_iter=2).fit(df, ["x", "b", "c"], "y")
        found.append([model.intercept, *model.coef, *[r[0] for t in model.tables.values() for r in t.orderBy("value").select("code").collect()]])
    np.testing.assert_allclose(found[0], found[1], rtol=1e-9, atol=1e-12)


def test_a_hundred_thousand_values(spark, tmp_path):
    n, k, alpha = 300_000, 150_000, 0.5
    level = F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(k)))  # one value holds a third
    df = spark.range(n).select("id", F.concat(F.lit("v"), level.cast("string")).alias("s"), (level % 11 + F.col("id") % 5).cast("double").alias("y"))
    kinds = df.select("s").distinct().count()
    assert kinds > 100_000
    vectors = sparse.sparse_dummies(df, ["s"]).select("id", F.unwrap_udt("dummies").alias("v"))
    seen = vectors.agg(F.sum(F.size("v.indices")), F.min("v.size"), F.max("v.size"), F.count_distinct(F.col("v.indices")[0])).first()
    assert tuple(seen) == (n, kinds, kinds, kinds)
    model = WideRidge(alpha=alpha).fit(df, ["s"], "y")
    g = df.groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("t")).toPandas()
    share = alpha / (g["n"] + alpha)
    mean = (g["t"] * share).sum() / (g["n"] * share).sum()
    g["want"] = mean + (g["t"] - g["n"] * mean) / (g["n"] + alpha)
    save_model(spark, model, str(tmp_path), "wide")
    back = load_model(spark, str(tmp_path), "wide")
    got = back.predict(df).groupBy("s").agg(F.min("prediction").alias("low"), F.max("prediction").alias("high")).toPandas()
    both = g.merge(got, on="s")
    assert len(both) == kinds
    np.testing.assert_allclose(both["low"], both["want"], atol=1e-7)
    np.testing.assert_allclose(both["high"], both["want"], atol=1e-7)


def test_no_rows_and_missing_target(make):
    pdf = mixed(40)
    with pytest.raises(ValueError):
        WideRidge().fit(make(pdf).where("id < 0"), ["x", "b"], "y")
    pdf.loc[3, "y"] = np.nan
    with pytest.raises(Exception, match="missing cells"):
        WideRidge().fit(make(pdf), ["x", "b"], "y")


def test_step_of_a_plan(make):
    from tabreg.plans.pipeline import PipelineSpec
    from tabreg.roles import Roles

    df = make(mixed(30))
    table, roles = PipelineSpec().then("encode_categories", method="sparse").apply(df, Roles(["x", "a", "b"], "y", categorical=["a", "b"]))
    assert list(roles.features) == ["x"] and "dummies" in table.columns and "a" not in table.columns and table.count() == 30
