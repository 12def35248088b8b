import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabreg.models import trees
from tabreg.models.registry import SPACES, make
from tabreg.models.trees import Penalty, Tree, drawn, mixed, tree_attributions
from tabreg.operators import explain

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 12, 400), rng.integers(0, 5, 400), rng.integers(0, 30, 400)]).astype(float)
    y = np.where(x[:, 0] > 5, 20.0, 0.0) + x[:, 1] * (x[:, 2] > 10) + rng.normal(size=400)
    x[::17, 2] = np.nan
    return x, y


@pytest.fixture(scope="module")
def df(spark, data):
    return frame(spark, *data)


def frame(spark, x, y, parts=4):
    rows = [(*[None if math.isnan(v) else float(v) for v in r], float(t), i) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, id long").repartition(parts)


def best_split(x, g, h, rows, pen):
    """(gain, feature, value, missing left) by trying every value of every feature."""
    found = (-np.inf,)
    for f in range(x.shape[1]):
        v = x[rows, f]
        for cut in np.unique(v[~np.isnan(v)])[:-1]:
            for missing in (False, True) if np.isnan(v).any() else (False,):
                left = rows[(v <= cut) | (np.isnan(v) & missing)]
                right = np.setdiff1d(rows, left)
                if min(len(left), len(right)) < pen.min_child_samples or min(h[left].sum(), h[right].sum()) < pen.min_child_weight:
                    continue
                score = sum(float(pen.pull(g[s].sum()) ** 2 / (h[s].sum() + pen.reg_lambda)) * k for s, k in ((left, 1), (right, 1), (rows, -1)))
                if score > found[0] + 1e-9:
                    found = (score, f, cut, missing, left, right)
    return found


def brute(x, y, pen, rounds, rate, depth, leaves):
    """Predictions of boosted trees grown best leaf first, one tree at a time, by plain loops."""
    margin = np.full(len(y), y.mean())
    for _ in range(rounds):
        g, h = margin - y, np.ones(len(y))
        done = [(np.arange(len(y)), 0)]
        open_ = [(best_split(x, g, h, done[0][0], pen), 0)]
        n = 1
        step = np.zeros(len(y))
        ready = []
        nodes = [(done[0][0], 0, open_[0][0])]
        while n < leaves:
            can = [k for k, (_, d, s) in enumerate(nodes) if s[0] > pen.min_split_gain and d < depth]
            if not can:
                break
            k = max(can, key=lambda i: nodes[i][2][0])
            _, d, s = nodes.pop(k)
            nodes += [(part, d + 1, best_split(x, g, h, part, pen)) for part in (s[4], s[5])]
            n += 1
        for rows, _, _ in nodes:
            step[rows] = pen.leaf(g[rows].sum(), h[rows].sum())
        margin = margin + rate * step
    return margin


@pytest.mark.parametrize("settings,leaves", [
    ({"max_depth": 2, "reg_lambda": 3.0, "reg_alpha": 2.0}, 10 ** 9), ({"max_depth": 3, "min_child_weight": 20}, 10 ** 9),
    ({"max_depth": 0, "max_leaves": 5, "min_child_samples": 15, "reg_lambda": 0.5}, 5), ({"max_depth": 4, "max_leaves": 6, "min_split_gain": 5.0}, 6)])
def test_boosting_equals_plain_loops(df, data, settings, leaves):
    x, y = data
    model = make("XGBRegressor", n_estimators=3, learning_rate=0.5, **settings).fit(df, NAMES, "y")
    pen = Penalty(**{k: settings.get(k, d) for k, d in (("reg_lambda", 1.0), ("reg_alpha", 0.0), ("min_split_gain", 0.0), ("min_child_weight", 1.0),
                                                       ("min_child_samples", 1))})
    want = brute(x, y, pen, 3, 0.5, settings["max_depth"] or 99, leaves)
    got = {r.id: r.prediction for r in model.predict(df).collect()}
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-8)


def test_scans_grow_with_depth_not_with_leaves(df, monkeypatch):
    calls = []
    real = trees.Booster._splits
    monkeypatch.setattr(trees.Booster, "_splits", lambda self, *a: calls.append(1) or real(self, *a))
    model = make("LGBMRegressor", n_estimators=1, num_leaves=24, min_child_samples=2, learning_rate=1.0).fit(df, NAMES, "y")
    assert (model.trees[0].feature < 0).sum() == 24
    depth = max(len(path) for _, path in model.trees[0].paths())
    assert len(calls) <= 2 * depth + 2 < 24


def test_result_does_not_depend_on_partitions(spark, data):
    settings = {"n_estimators": 4, "subsample": 0.6, "colsample_bytree": 0.7, "max_depth": 3}
    a, b = (make("XGBRegressor", **settings).fit(frame(spark, *data, parts=n), NAMES, "y") for n in (1, 7))
    x = data[0]
    assert np.allclose(a.margin(x), b.margin(x), atol=1e-9)


def test_margins_written_on_the_way_change_nothing(df, data, monkeypatch):
    whole = make("XGBRegressor", n_estimators=5, max_depth=2).fit(df, NAMES, "y")
    monkeypatch.setattr(trees, "KEPT_TREES", 2)
    cut = make("XGBRegressor", n_estimators=5, max_depth=2).fit(df, NAMES, "y")
    assert np.allclose(whole.margin(data[0]), cut.margin(data[0]), atol=1e-9)


@pytest.mark.parametrize("kind", ["gbdt", "dart", "rf"])
def test_kinds_of_boosting_learn(df, data, kind):
    x, y = data
    model = make("LGBMRegressor", n_estimators=8, num_leaves=6, learning_rate=0.4, boosting_type=kind, subsample=0.8, subsample_freq=1, drop_rate=0.4).fit(df, NAMES, "y")
    assert ((model.margin(x) - y) ** 2).mean() < 0.5 * y.var()
    assert sum(model.importances.values()) == pytest.approx(1.0)


def test_poisson_objective(spark):
    rows = [(float(k % 2), float((k % 2) * 4 + k % 3), k) for k in range(300)]
    df = spark.createDataFrame(rows, "a double, y double, id long")
    model = make("XGBRegressor", objective="poisson", n_estimators=40, max_depth=1, learning_rate=0.5, reg_lambda=0.0).fit(df, ["a"], "y")
    got = {r.a: r.prediction for r in model.predict(df).collect()}
    assert got == pytest.approx({0.0: 1.0, 1.0: 5.0}, abs=1e-3)


def test_settings_are_checked(df):
    for bad in ({"objective": "rank"}, {"boosting_type": "goss"}):
        with pytest.raises(ValueError):
            make("XGBRegressor", **bad).fit(df, NAMES, "y")
    assert {"reg_alpha", "reg_lambda"} <= set(SPACES["XGBRegressor"]) & set(SPACES["LGBMRegressor"])
    with pytest.raises(ValueError):
        make("XGBRegressor").fit(df.filter("false"), NAMES, "y")


# ---- attributions ------------------------------------------------------------------------------------------------------

def value_of(tree, x, known):
    """The prediction if only some features are known: shares of the training rows decide elsewhere."""
    def walk(k):
        f = tree.feature[k]
        if f < 0:
            return tree.value[k]
        left, right = tree.left[k], tree.right[k]
        if f in known:
            return walk(left if x[f] <= tree.threshold[k] or (math.isnan(x[f]) and tree.missing_left[k]) else right)
        return (tree.cover[left] * walk(left) + tree.cover[right] * walk(right)) / tree.cover[k]
    return walk(0)


def by_definition(tree, x, p):
    out = np.zeros(p)
    for j in range(p):
        rest = [i for i in range(p) if i != j]
        for size in range(p):
            for s in itertools.combinations(rest, size):
                w = math.factorial(size) * math.factorial(p - 1 - size) / math.factorial(p)
                out[j] += w * (value_of(tree, x, {*s, j}) - value_of(tree, x, set(s)))
    return out


def random_tree(rng, p, depth):
    rows = []

    def grow(d, cover):
        at = len(rows)
        rows.append(None)
        if d == 0 or rng.random() < 0.15:
            rows[at] = (-1, 0.0, -1, -1, float(rng.normal()), False, cover)
            return at
        share = rng.uniform(0.1, 0.9)
        left, right = grow(d - 1, cover * share), grow(d - 1, cover * (1 - share))
        rows[at] = (int(rng.integers(p)), float(rng.normal()), left, right, 0.0, bool(rng.random() < 0.5), cover)
        return at

    grow(depth, 100.0)
    return Tree.of(rows)


def test_attributions_equal_the_subset_definition():
    rng = np.random.default_rng(0)
    for p, depth in [(1, 2), (2, 3), (4, 4), (5, 6)]:
        tree = random_tree(rng, p, depth)
        x = rng.normal(size=(12, p))
        x[0, 0] = np.nan
        got = tree_attributions(tree, x, p)
        assert np.allclose(got, [by_definition(tree, r, p) for r in x])
        assert np.allclose(got.sum(axis=1) + tree.mean(), tree.predict(x))


def test_long_paths_use_the_patterns_that_occur():
    rng = np.random.default_rng(2)
    chain, n = [], 20
    for k in range(n):  # a path with twenty different features
        chain += [(k, 0.0, 2 * k + 1, 2 * k + 2, 0.0, False, 2.0 ** (n - k)), (-1, 0.0, -1, -1, float(k), False, 2.0 ** (n - k - 1))]
    tree = Tree.of([*chain, (-1, 0.0, -1, -1, 99.0, False, 1.0)])
    x = rng.normal(size=(40, n))
    assert np.allclose(tree_attributions(tree, x, n).sum(axis=1) + tree.mean(), tree.predict(x))


@pytest.mark.parametrize("name,settings", [("DecisionTreeRegressor", {"max_depth": 4}), ("RandomForestRegressor", {"n_estimators": 5, "max_depth": 3}),
                                           ("GradientBoostingRegressor", {"n_estimators": 4}), ("XGBRegressor", {"n_estimators": 4, "max_depth": 3}),
                                           ("ExtraTreesRegressor", {"n_estimators": 4, "max_depth": 4})])
def test_attributions_add_up_to_the_prediction(spark, data, name, settings):
    x, y = np.nan_to_num(data[0], nan=7.0), data[1]
    df = frame(spark, x, y)
    model = make(name, **settings).fit(df, NAMES, "y")
    got = explain.shap_values(model, df, ["id"])
    assert got.columns == ["id", *NAMES, "base_value"]
    total = {r.id: r.a + r.b + r.c + r.base_value for r in got.collect()}
    want = {r.id: r.prediction for r in model.predict(df).collect()}
    assert total == pytest.approx(want, abs=1e-9)
    assert explain.shap_values(model, df.filter("false"), ["id"]).count() == 0


# ---- extremely randomised trees ----------------------------------------------------------------------------------------

def replayed(x, y, seed, tree, depth, least=1):
    """Predictions of one tree, every cut taken again from the seed."""
    out = np.zeros(len(y))
    stack = [(np.arange(len(y)), 1, 0)]
    while stack:
        rows, number, d = stack.pop()
        found = None
        if d < depth and len(rows) >= 2:
            for f in range(x.shape[1]):
                low, high = x[rows, f].min(), x[rows, f].max()
                if high <= low:
                    continue
                cut = low + drawn(seed, tree, number, f) * (high - low)
                left = rows[x[rows, f] <= cut]
                right = np.setdiff1d(rows, left)
                if min(len(left), len(right)) < least:
                    continue
                gain = y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right) - y[rows].sum() ** 2 / len(rows)
                if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = gain, left, right
        if found is None:
            out[rows] = y[rows].mean()
        else:
            stack += [(found[1], 2 * number, d + 1), (found[2], 2 * number + 1, d + 1)]
    return out


def test_random_cuts_can_be_replayed_from_the_seed(spark, data):
    x, y = np.nan_to_num(data[0], nan=7.0), data[1]
    model = make("ExtraTreesRegressor", n_estimators=3, max_depth=3, random_state=9, min_samples_leaf=4).fit(frame(spark, x, y), NAMES, "y")
    want = np.mean([replayed(x, y, 9, t, 3, 4) for t in range(3)], axis=0)
    assert np.allclose(model.margin(x), want, atol=1e-8)
    again = make("ExtraTreesRegressor", n_estimators=3, max_depth=3, random_state=9, min_samples_leaf=4).fit(frame(spark, x, y, 7), NAMES, "y")
    assert np.allclose(model.margin(x), again.margin(x), atol=1e-9)


def test_extra_trees_settings(spark, data):
    x, y = np.nan_to_num(data[0], nan=7.0), data[1]
    df = frame(spark, x, y)
    model = make("ExtraTreesRegressor", n_estimators=6, max_depth=6, max_features="sqrt", bootstrap=True).fit(df, NAMES, "y")
    assert ((model.margin(x) - y) ** 2).mean() < 0.6 * y.var() and sum(model.importances.values()) == pytest.approx(1.0)
    flat = make("ExtraTreeRegressor").fit(df.withColumn("a", F.lit(1.0)), ["a"], "y")
    assert flat.margin(np.ones((1, 1)))[0] == pytest.approx(y.mean())
    with pytest.raises(ValueError):
        make("ExtraTreeRegressor").fit(frame(spark, *data), NAMES, "y")


def test_mixed_is_even_and_repeatable():
    u = mixed(np.arange(20_000), 3, 4)
    assert (u == mixed(np.arange(20_000), 3, 4)).all() and 0 <= u.min() and u.max() < 1
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u, mixed(np.arange(20_000), 3, 5))[0, 1]) < 0.03


def test_pieces_of_a_fit_hold_a_bounded_number_of_rows(spark, monkeypatch, tmp_path):
    """A piece is held as objects; by bytes alone its rows grew with the table."""
    from tabreg.models.ensembles import prepared
    from tabreg.sources import storage

    monkeypatch.setattr(storage, "PIECE_ROWS", 500)
    rows = 500 * spark.sparkContext.defaultParallelism * 3
    spark.range(rows).selectExpr("cast(id % 2 as double) AS flag", "cast(id as double) AS y").coalesce(1).write.parquet(str(tmp_path / "t"))
    held = prepared(spark.read.parquet(str(tmp_path / "t")), ["flag"], "y").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(held) == rows and max(held) <= 600


def test_stored_rows_hold_many_rows(spark, data, monkeypatch):
    """A scan meets a row per block, not a row per row of the table; blocks of any size give the same tree and predictions."""
    x, y = data
    wide = frame(spark, x, y, 1).select(*NAMES, "y")
    stored = []
    real = trees.cut_lineage
    monkeypatch.setattr(trees, "cut_lineage", lambda df: stored.append(real(df)) or stored[-1])
    monkeypatch.setattr(trees, "discard", lambda df: None)
    found = {}
    for most in (50, 65_536):
        monkeypatch.setattr(trees, "BLOCK_ROWS", most)
        stored.clear()
        model = make("LGBMRegressor", n_estimators=3, min_child_samples=5).fit(wide, NAMES, "y")
        assert {t.count() for t in stored} == {math.ceil(400 / most)}
        found[most] = model.margin(x)
        stored.clear()
        whole = wide.na.fill(0.0)
        make("ExtraTreeRegressor", max_depth=3).fit(whole, NAMES, "y")
        assert {t.count() for t in stored} == {math.ceil(400 / most)}
    assert np.allclose(found[50], found[65_536])


@pytest.mark.parametrize("levels", [3, 6])
def test_adaboost_grows_the_trees_of_spark(spark, data, levels, tmp_path):
    """Three rounds over blocks against weighted trees of Spark ML; no round meets a row of the table by itself."""
    from pyspark.ml import regression as M

    from tabreg.models import ensembles
    from tabreg.models.base import assemble
    from tabreg.sources.artifacts import load_model, save_model

    x, y = np.nan_to_num(data[0]), data[1]
    x[:, 2] += np.arange(400) / 1000  # more values than bins
    wide = frame(spark, x, y, 3).select(*NAMES, "y")
    stored, real = [], ensembles.cut_lineage
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ensembles, "cut_lineage", lambda df: stored.append(real(df)) or stored[-1])
        patch.setattr(ensembles, "discard", lambda df: None)
        model = make("AdaBoostRegressor", n_estimators=3, max_depth=levels).fit(wide, NAMES, "y")
    assert [t.count() <= 3 for t in stored] == [True] * 3
    w, votes, weights = np.ones(len(y)), [], []
    for _ in range(3):
        rows = spark.createDataFrame([(*map(float, r), float(t), float(v)) for r, t, v in zip(x, y, w, strict=True)], [*NAMES, "y", "w"])
        tree = M.DecisionTreeRegressor(featuresCol="__x", labelCol="y", weightCol="w", maxDepth=levels, seed=42).fit(assemble(rows.coalesce(1), NAMES))
        votes.append(trees.trees_of_spark(tree, spark, NAMES).trees[0].predict(x))
        unit = np.abs(y - votes[-1]) / np.abs(y - votes[-1]).max()
        mean = (w * unit).sum() / w.sum()
        beta = mean / (1 - mean)
        weights.append(np.log(1 / beta))
        w = w / w.mean() * beta ** (1 - unit)
    assert np.allclose(np.column_stack([t.predict(x) for t in model.trees]), np.column_stack(votes))
    assert np.allclose(model.weights, weights)
    save_model(spark, model, str(tmp_path), "boost")
    got = load_model(spark, str(tmp_path), "boost").predict(wide).collect()
    expect = [v[o][np.argmax(np.cumsum(np.array(weights)[o]) >= sum(weights) / 2)] for v in np.column_stack(votes) for o in [np.argsort(v)]]
    assert np.allclose(sorted(r["prediction"] for r in got), sorted(expect))


def test_weighted_cuts():
    from tabreg.models.ensembles import weighted_cuts

    assert weighted_cuts(np.array([3.0, 1.0, 1.0, 2.0]), np.ones(4), 32).tolist() == [1.5, 2.5]
    assert weighted_cuts(np.arange(8.0), np.ones(8), 4).tolist() == [1.5, 3.5, 5.5]
    assert weighted_cuts(np.arange(8.0), np.r_[np.ones(4), np.full(4, 5.0)], 2).tolist() == [5.5]
    assert len(weighted_cuts(np.ones(5), np.ones(5), 32)) == 0


def test_parted_rows_meet_their_leaves(data):
    """Walking node by node finds each row's leaf, for values and for codes, and only of the nodes asked for."""
    x = data[0]
    t = Tree.of([(0, 5.0, 1, 2, 0, False, 1), (2, 10.0, 3, 4, 0, True, 1), (-1, 0.0, -1, -1, 1.0, False, 1), (-1, 0.0, -1, -1, 2.0, False, 1),
                 (1, 2.0, 5, 6, 0, False, 1), (-1, 0.0, -1, -1, 3.0, False, 1), (-1, 0.0, -1, -1, 4.0, False, 1)])
    plain = np.array([t.leaf_of(r[None]) for r in x]).ravel()
    assert (t.leaf_of(x) == plain).all() and set(plain) == {2, 3, 5, 6}
    codes = [np.where(np.isnan(c), 255, c).astype("u1") for c in x.T]
    slots = np.array([-1, -1, -1, 0, -1, -1, 1])
    for columns, missing in ((x.T, None), (codes, 255)):
        got = {slot: rows.tolist() for slot, rows in t.parted(columns, slots, missing)}
        assert got == {0: np.flatnonzero(plain == 3).tolist(), 1: np.flatnonzero(plain == 6).tolist()}
