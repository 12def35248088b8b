import numpy as np
import pytest
from pyspark.sql import functions as F

from tabreg.models.registry import make
from tabreg.operators import explain, permute
from tabreg.operators.order import INDEX
from tabreg.operators.permute import permuted_position, random_blocks
from tabreg.operators.wrappers import LABEL, boruta, with_shadows
from tabreg.roles import Roles


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000])
def test_every_seed_is_a_bijection(spark, n):
    seen = set()
    for seed in (1, 2, 3):
        got = [r[0] for r in spark.range(n).select("id", permuted_position(F.col("id"), n, seed).alias("to")).orderBy("id").select("to").collect()]
        assert sorted(got) == list(range(n))
        seen.add(tuple(got))
    assert n < 90 or len(seen) == 3


def test_positions_of_two_seeds_are_unrelated(spark):
    n = 5000
    rows = spark.range(n).select("id", *[permuted_position(F.col("id"), n, s).alias(f"p{s}") for s in (1, 2)]).toPandas()
    assert np.abs(np.corrcoef(rows.to_numpy().T) - np.eye(3)).max() < 0.06
    step = np.diff(rows.sort_values("id")["p1"])
    assert len(np.unique(step)) > n / 2  # not a rotation


@pytest.mark.parametrize("size", [4096, 64])
def test_shadows_keep_values_and_are_shuffled_each_by_itself(spark, monkeypatch, size):
    monkeypatch.setattr(permute, "BLOCK_ROWS", size)
    n = 1500
    rows = spark.range(n).select(permuted_position(F.col("id"), n, 9).alias(INDEX), F.col("id").cast("double").alias("f0"),
                                 (F.col("id") % 7).cast("double").alias("f1"), F.col("id").cast("double").alias(LABEL))
    columns = ["f0", "f1", LABEL]
    blocks = random_blocks(rows, columns)
    made = with_shadows(blocks, columns, [0, 1], [0, 1, 0, 1, 0], 5)
    got = made.toPandas()
    assert len(got) == n and (got["f0"] == got[LABEL]).all()
    for k, i in enumerate([0, 1, 0, 1, 0]):
        assert sorted(got[f"s{k}"]) == sorted(got[f"f{i}"])
    c = np.abs(np.corrcoef(got[["f0", "s0", "s2", "s4"]].to_numpy().T) - np.eye(4)).max()
    assert c < 0.12  # copies of one feature are shuffled apart
    again = with_shadows(random_blocks(rows.repartition(7), columns), columns, [0, 1], [0, 1, 0, 1, 0], 5).toPandas()
    key = ["f0"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_boruta_and_permutation_importance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    rows = [(i, *map(float, r), float(5 * r[0] + 0.1 * rng.normal())) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3)
    got = {r.feature: r for r in boruta(df, Roles(["a", "b", "c"], "y", row_id=["id"]), max_iter=14, num_trees=10).collect()}
    assert got["a"].decision == "confirmed" and got["a"].hits > max(got["b"].hits, got["c"].hits)
    model = make("LinearRegression").fit(df, ["a", "b", "c"], "y")
    ranked = explain.permutation_importance(model, df, "y", ["id"], n_repeats=3).collect()
    assert ranked[0].feature == "a" and ranked[0].importance == pytest.approx(2.0, abs=0.25)  # twice the share of variance
    assert all(abs(r.importance) < 0.01 for r in ranked[1:])
