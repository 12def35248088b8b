"""Queries: neighbours, reduction, wrappers, models, search, explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabreg.models.ensembles import RandomForest
from tabreg.models.leaderboard import leaderboard
from tabreg.models.linear import LinearRegression, Ridge
from tabreg.models.registry import make, tune
from tabreg.models.wide import WideRidge
from tabreg.operators import explain, impute, layout, lowess, neighbors, reduce, timeops, wrappers
from tabreg.operators.evaluate import regression_metrics
from tabreg.operators.split import train_test_split
from tabreg.plans.pipeline import PipelineSpec
from tabreg.queries.catalog import load, r, register, round_all
from tabreg.queries.features import BAND_ROLES, BANDS, bands
from tabreg.roles import Roles

PART_ROLES = Roles(["p_size", "p_partkey", "p_brand"], "p_retailprice", ["p_brand"], row_id=["p_partkey"])


def part(spark, sf):
    return load(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")


# --- neighbours -------------------------------------------------------------------------------------

PART_GAPS = """SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 4 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p_size,
 CASE WHEN p_size = 30 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part"""


@register("knn_impute_exact", f"""
WITH h AS ({PART_GAPS}),
 ps AS (SELECT a.p_partkey, b.p_size AS v, row_number() OVER (PARTITION BY a.p_partkey
   ORDER BY sqrt(2 * pow(a.p_retailprice - b.p_retailprice, 2)), b.p_partkey) AS k
  FROM h a JOIN h b ON a.p_size IS NULL AND b.p_size IS NOT NULL AND b.p_retailprice IS NOT NULL),
 pr AS (SELECT a.p_partkey, b.p_retailprice AS v, row_number() OVER (PARTITION BY a.p_partkey
   ORDER BY sqrt(2 * pow(a.p_size - b.p_size, 2)), b.p_partkey) AS k
  FROM h a JOIN h b ON a.p_retailprice IS NULL AND b.p_retailprice IS NOT NULL AND b.p_size IS NOT NULL),
 s AS (SELECT p_partkey, avg(v) AS v FROM ps WHERE k <= 5 GROUP BY 1),
 t AS (SELECT p_partkey, avg(v) AS v FROM pr WHERE k <= 5 GROUP BY 1)
SELECT h.p_partkey, {r('coalesce(h.p_size, s.v)', 5)} AS p_size,
 {r('coalesce(h.p_retailprice, t.v)', 5)} AS p_retailprice
FROM h LEFT JOIN s USING (p_partkey) LEFT JOIN t USING (p_partkey)""")
def knn_impute_exact(spark, sf):
    df = load(spark, sf, "part").select(
        "p_partkey", F.when(~F.col("p_size").between(1, 4), F.col("p_size").cast("double")).alias("p_size"),
        F.when(F.col("p_size") != 30, F.col("p_retailprice")).alias("p_retailprice"))
    return round_all(impute.impute(df, "knn", 5, ["p_partkey"], ["p_size", "p_retailprice"]), 5)


SCALED_BANDS = """
WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
 z AS (SELECT vec_id, i, (v - avg(v) OVER (PARTITION BY i)) / nullif(stddev_pop(v) OVER (PARTITION BY i), 0) AS z FROM l),
 e AS (SELECT vec_id, list(z ORDER BY i) AS e FROM z GROUP BY vec_id),
 d AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.e, b.e) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
 g AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM d)"""


KNN_GRAPH = SCALED_BANDS + f" SELECT src, dst, CAST(rank AS INTEGER) AS rank, {r('dist')} AS dist FROM g WHERE rank <= 15"


@register("knn_graph", KNN_GRAPH)
def knn_graph(spark, sf):
    return round_all(neighbors.knn_graph(bands(spark, sf), BANDS, "vec_id", 15))


@register("knn_graph_by_blocks", KNN_GRAPH)
def knn_graph_by_blocks(spark, sf):
    """The block join that larger tables take."""
    return round_all(neighbors.knn_graph(bands(spark, sf), BANDS, "vec_id", 15, small_donors=0))


@register("fuzzy_graph")
def fuzzy_graph(spark, sf):
    return reduce.fuzzy_graph(neighbors.knn_graph(bands(spark, sf), BANDS, "vec_id", 15))


@register("spectral_embedding")
def spectral_embedding(spark, sf):
    return reduce.spectral_embedding(fuzzy_graph(spark, sf), 2, rounds=12)


@register("umap_layout")
def umap_layout(spark, sf):
    return layout.umap(bands(spark, sf), BAND_ROLES, 2)[0]


@register("tsne_layout")
def tsne_layout(spark, sf):
    return layout.tsne(bands(spark, sf), BAND_ROLES, 2)[0]


# --- principal components ---------------------------------------------------------------------------

TWO = Roles(["l_quantity", "l_extendedprice"], "l_tax")


@register("pca_variance_two_columns", f"""
WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT CAST(1 AS INTEGER) AS component, {r('(1 + r) / 2')} AS ratio, {r('(1 + r) / 2')} AS cumulative FROM c
UNION ALL SELECT CAST(2 AS INTEGER), {r('(1 - r) / 2')}, {r('1.0')} FROM c""")
def pca_variance_two_columns(spark, sf):
    return round_all(reduce.explained_variance(load(spark, sf, "lineitem"), TWO))


@register("pca_two_columns", f"""
WITH z AS (SELECT l_tax, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a,
 (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b FROM lineitem),
 c AS (SELECT sign(avg(a * b)) AS s FROM z)
SELECT l_tax, {r('abs((a + s * b) / sqrt(2))', 5)} AS "PC_1", {r('abs((a - s * b) / sqrt(2))', 5)} AS "PC_2" FROM z, c""")
def pca_two_columns(spark, sf):
    out, _ = reduce.pca(load(spark, sf, "lineitem"), TWO, 100.0)
    return round_all(out.select("l_tax", F.abs("PC_1").alias("PC_1"), F.abs("PC_2").alias("PC_2")), 5)


@register("pca_bands")
def pca_bands(spark, sf):
    return reduce.pca(bands(spark, sf), BAND_ROLES, 98.0)[0]


# --- smoothing and wrappers -------------------------------------------------------------------------

_HOURLY_MEANS = """WITH a AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS y FROM events GROUP BY 1),
 g AS (SELECT unnest(generate_series((SELECT min(ts) FROM a), (SELECT max(ts) FROM a), INTERVAL 1 HOUR)) AS ts),
 p AS MATERIALIZED (SELECT ts, y, row_number() OVER (ORDER BY ts) - 1 AS i FROM a),"""


def lowess_sql(k, digits=5, by_event=False):
    """Four weighted local-line passes over the hourly series, or over all events; each later pass reads the residuals of the
    one before."""
    passes = []
    for t in range(4):
        weight = "n.w" if t == 0 else "n.w * b.bw"
        source = "near n" if t == 0 else f"near n JOIN b{t} b ON b.i = n.j"
        passes.append(f"""s{t} AS (SELECT n.i, sum({weight}) AS s0, sum({weight} * n.d) AS s1, sum({weight} * n.d * n.d) AS s2,
  sum({weight} * n.y) AS t0, sum({weight} * n.d * n.y) AS t1 FROM {source} GROUP BY n.i),
 f{t} AS MATERIALIZED (SELECT i, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS fit FROM s{t})""")
        if t < 3:
            passes.append(f"""e{t} AS (SELECT p.i, abs(p.y - f.fit) AS e FROM p JOIN f{t} f USING (i)),
 u{t} AS (SELECT i, e / (6 * (SELECT median(e) FROM e{t})) AS u FROM e{t}),
 b{t + 1} AS MATERIALIZED (SELECT i, CASE WHEN u > 0.999 THEN 0 WHEN u < 0.001 THEN 1 ELSE pow(1 - u * u, 2) END AS bw FROM u{t})""")
    if by_event:
        first = """WITH p AS MATERIALIZED (SELECT event_id, value AS y, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events),"""
        final = f"SELECT p.event_id, {r('f3.fit', digits)} AS value FROM p JOIN f3 USING (i)"
    else:
        first, final = _HOURLY_MEANS, f"""SELECT CAST(g.ts AS TIMESTAMP) AS ts, {r('f3.fit', digits)} AS value
FROM g LEFT JOIN p USING (ts) LEFT JOIN f3 ON f3.i = p.i"""
    return f"""{first}
 c AS (SELECT p.i, greatest(0, least(n - {k}, CAST(ceil(i - {k} / 2.0) AS BIGINT))) AS l FROM p, (SELECT count(*) AS n FROM p)),
 h AS (SELECT i, l, greatest(i - l, l + {k} - 1 - i) AS h FROM c),
 v AS (SELECT h.i, q.i AS j, q.y, (q.i - h.i) / CAST(h.h AS DOUBLE) AS d FROM h JOIN p q ON q.i BETWEEN h.l AND h.l + {k} - 1),
 near AS MATERIALIZED (SELECT *, CASE WHEN abs(d) > 0.999 THEN 0 WHEN abs(d) < 0.001 THEN 1
  ELSE pow(1 - pow(abs(d), 3), 3) END AS w FROM v), {', '.join(passes)}
{final}"""


@register("lowess_hourly_means", lowess_sql(72))
def lowess_hourly_means(spark, sf):
    series = timeops.resample(load(spark, sf, "events").select("ts", "value"), "ts", "H", "mean")
    return round_all(lowess.lowess(series, 72, ["ts"]), 5)


@register("lowess_all_events", lowess_sql(72, by_event=True))
def lowess_all_events(spark, sf):
    df = load(spark, sf, "events").select("event_id", "ts", "value")
    return round_all(lowess.lowess(df, 72, ["ts", "event_id"], ["value"]).drop("ts"), 5)


PLANTED_ROLES = Roles(["p_size", "p_partkey", "noise_a", "noise_b"], "y", row_id=["p_partkey"])


def planted(spark, sf):
    """part with a target that depends on two columns, and two columns of noise."""
    u = [F.pmod(F.xxhash64("p_partkey", F.lit(s)), F.lit(10_007)) / 10_007.0 for s in (1, 2, 3)]
    return part(spark, sf).select("p_partkey", "p_size", u[0].alias("noise_a"), u[1].alias("noise_b"),
                                  (F.col("p_size") * 5.0 + F.col("p_partkey") * 0.05 + u[2]).alias("y"))


@register("recursive_elimination")
def recursive_elimination(spark, sf):
    return wrappers.rfe(planted(spark, sf), PLANTED_ROLES, 2, num_trees=20, max_depth=5)[0]


@register("all_relevant_features")
def all_relevant_features(spark, sf):
    return wrappers.boruta(planted(spark, sf), PLANTED_ROLES, max_iter=12, num_trees=20)


# --- models -----------------------------------------------------------------------------------------

HASH = "md5('42|' || p_partkey)"
SPLIT_SQL = f"""s AS (SELECT *, row_number() OVER (ORDER BY {HASH}, p_partkey)
 <= CAST(ceil(count(*) OVER () * CAST(0.3 AS DECIMAL(4, 2))) AS BIGINT) AS test FROM part)"""
ONE = Roles(["p_partkey"], "p_retailprice", row_id=["p_partkey"])


@register("leaderboard_linear_score", f"""
WITH {SPLIT_SQL}, f AS (SELECT regr_slope(p_retailprice, p_partkey) AS b, regr_intercept(p_retailprice, p_partkey) AS a
 FROM s WHERE NOT test), e AS (SELECT p_retailprice AS y, a + b * p_partkey AS yhat FROM s, f WHERE test),
 m AS (SELECT 1 - avg((y - yhat) * (y - yhat)) / var_pop(y) AS r2, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
  avg(abs(y - yhat)) AS custom_metric, count(*) AS n FROM e)
SELECT 'LinearRegression' AS model, {r('1 - (1 - r2) * (n - 1) / (n - 2)', 5)} AS adjusted_r_squared,
 {r('r2', 5)} AS r_squared, {r('rmse', 5)} AS rmse, {r('custom_metric', 5)} AS custom_metric FROM m""")
def leaderboard_linear_score(spark, sf):
    train, test = train_test_split(part(spark, sf), ["p_partkey"])
    board = leaderboard(train, test, ONE, ["LinearRegression"], lambda y, yhat: F.avg(F.abs(y - yhat)))
    return round_all(board.scores.select("model", "adjusted_r_squared", "r_squared", "rmse", "custom_metric"), 5)


BOARD_MODELS = ["LinearRegression", "Ridge", "Lasso", "ElasticNet", "BayesianRidge", "LassoLarsIC", "DummyRegressor",
                "HuberRegressor", "DecisionTreeRegressor", "RandomForestRegressor", "KNeighborsRegressor"]
SMALL_FORESTS = {"RandomForestRegressor": {"n_estimators": 20, "max_depth": 5}}


def _board(spark, sf):
    train, test = train_test_split(part(spark, sf), ["p_partkey"])
    return leaderboard(train, test, PART_ROLES, BOARD_MODELS, handle_unknown="keep", settings=SMALL_FORESTS)


@register("leaderboard_scores")
def leaderboard_scores(spark, sf):
    return _board(spark, sf).scores.drop("time_taken")


@register("leaderboard_predictions")
def leaderboard_predictions(spark, sf):
    return _board(spark, sf).predictions(["p_partkey"])


LINE = Roles(["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@register("linear_fit_scores", f"""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
 e AS (SELECT l_extendedprice AS y, a + b * l_quantity AS yhat FROM lineitem, f)
SELECT {r('avg(abs(y - yhat))', 4)} AS mae, {r('sqrt(avg((y - yhat) * (y - yhat)))', 4)} AS rmse,
 {r('1 - avg((y - yhat) * (y - yhat)) / var_pop(y)', 4)} AS r2 FROM e""")
def linear_fit_scores(spark, sf):
    df = load(spark, sf, "lineitem")
    model = LinearRegression().fit(df, ["l_quantity"], "l_extendedprice")
    scored = regression_metrics(model.predict(df, "yhat"), "l_extendedprice", "yhat")
    return round_all(scored.select("mae", "rmse", "r2"), 4)


@register("dummy_median_prediction", f"""
WITH m AS (SELECT quantile_cont(l_extendedprice, 0.5) AS p FROM lineitem)
SELECT {r('p', 4)} AS prediction, count(*) AS row_count FROM lineitem, m GROUP BY p""")
def dummy_median_prediction(spark, sf):
    df = load(spark, sf, "lineitem")
    model = make("DummyRegressor", strategy="median").fit(df, ["l_quantity"], "l_extendedprice")
    return round_all(model.predict(df).groupBy("prediction").agg(F.count(F.lit(1)).alias("row_count")), 4)


def _coefficients(spark, model):
    rows = [("(intercept)", model.intercept), *zip(model.features, model.coef)]
    return round_all(spark.createDataFrame([(a, float(b)) for a, b in rows], "term string, coefficient double"), 4)


RIDGE_SQL = f"""
WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
 covar_pop(l_quantity, l_extendedprice) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx FROM lineitem),
 b AS (SELECT sxy / (sxx + 1000.0) AS b, mx, my FROM m)
SELECT 'l_quantity' AS term, {r('b', 4)} AS coefficient FROM b
UNION ALL SELECT '(intercept)', {r('my - b * mx', 4)} FROM b"""


@register("ridge_coefficients", RIDGE_SQL)
def ridge_coefficients(spark, sf):
    return _coefficients(spark, Ridge(alpha=1000.0).fit(load(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice"))


@register("lasso_coefficients", f"""
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
 covar_pop(l_quantity, l_extendedprice) AS sxy, var_pop(l_quantity) AS sxx FROM lineitem),
 b AS (SELECT sign(sxy) * greatest(abs(sxy) - 500.0, 0) / sxx AS b, mx, my FROM m)
SELECT 'l_quantity' AS term, {r('b', 4)} AS coefficient FROM b
UNION ALL SELECT '(intercept)', {r('my - b * mx', 4)} FROM b""")
def lasso_coefficients(spark, sf):
    return _coefficients(spark, make("Lasso", alpha=500.0).fit(load(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice"))


# One feature: every least-squares family has a closed form that SQL can state.
# The target mixes in the feature, so that cross-validation and the information criterion keep it.
ONE_SQL = """WITH s AS (SELECT l_quantity, l_extendedprice + 3000 * l_quantity AS y FROM lineitem),
 m AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(y) AS my,
 covar_pop(l_quantity, y) AS sxy, var_pop(l_quantity) AS sxx FROM s)"""


def mixed_target(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_quantity", (F.col("l_extendedprice") + 3000 * F.col("l_quantity")).alias("y"))


CLOSED = {  # model: (settings, slope from the moments)
    "LinearRegression": ({}, "sxy / sxx"), "Lars": ({}, "sxy / sxx"), "LarsCV": ({}, "sxy / sxx"),
    "LassoLarsCV": ({}, "sxy / sxx"), "LassoLarsIC": ({}, "sxy / sxx"), "OrthogonalMatchingPursuit": ({}, "sxy / sxx"),
    "OrthogonalMatchingPursuitCV": ({}, "sxy / sxx"),
    "ElasticNet": ({"alpha": 40.0, "l1_ratio": 0.5}, "(sxy - 20.0) / (sxx + 20.0)"),
    "LassoLars": ({"alpha": 700.0}, "(sxy - 700.0) / sxx"),
    "LassoCV": ({}, "sxy * 0.999 / sxx"), "ElasticNetCV": ({}, "sxy * 0.999 / (sxx + 0.001 * sxy)"),
    "TweedieRegressor": ({"alpha": 3.0}, "sxy / (sxx + 3.0)"),
    "TransformedTargetRegressor": ({}, "sxy / sxx"),
}
for _name, (_args, _slope) in CLOSED.items():
    def _closed(spark, sf, name=_name, args=_args):
        return _coefficients(spark, make(name, **args).fit(mixed_target(spark, sf), ["l_quantity"], "y"))

    register(f"coefficients_{_name}", f"""{ONE_SQL}, b AS (SELECT {_slope} AS b, mx, my FROM m)
SELECT 'l_quantity' AS term, {r('b', 4)} AS coefficient FROM b
UNION ALL SELECT '(intercept)', {r('my - b * mx', 4)} FROM b""")(_closed)


@register("coefficients_RidgeCV", f"""{ONE_SQL},
 a AS (SELECT unnest([100.0, 100000.0, 10000000.0]) AS alpha),
 b AS (SELECT alpha, sxy * n / (sxx * n + alpha) AS b, mx, my, n, sxx FROM a, m),
 e AS (SELECT alpha, b, mx, my, avg(pow((y - my - b * (l_quantity - mx))
   / (1 - 1.0 / n - pow(l_quantity - mx, 2) / (sxx * n + alpha)), 2)) AS loss FROM b, s GROUP BY alpha, b, mx, my),
 w AS (SELECT * FROM e ORDER BY loss LIMIT 1)
SELECT 'l_quantity' AS term, {r('b', 4)} AS coefficient FROM w
UNION ALL SELECT '(intercept)', {r('my - b * mx', 4)} FROM w""")
def coefficients_ridge_cv(spark, sf):
    model = make("RidgeCV", alphas=(1e2, 1e5, 1e7)).fit(mixed_target(spark, sf), ["l_quantity"], "y")
    return _coefficients(spark, model)


def _cov(a, b):
    return f"covar_pop({a}, {b})"


Q, D, T_, P = LINE.features[0], LINE.features[1], LINE.features[2], LINE.target


THREE_FEATURES_SQL = f"""
WITH m AS (SELECT {_cov(Q, Q)} AS a11, {_cov(Q, D)} AS a12, {_cov(Q, T_)} AS a13, {_cov(D, D)} AS a22, {_cov(D, T_)} AS a23,
 {_cov(T_, T_)} AS a33, {_cov(Q, P)} AS c1, {_cov(D, P)} AS c2, {_cov(T_, P)} AS c3,
 avg({Q}) AS m1, avg({D}) AS m2, avg({T_}) AS m3, avg({P}) AS my FROM lineitem),
 d AS (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det FROM m),
 b AS (SELECT *,
  (c1 * (a22 * a33 - a23 * a23) - a12 * (c2 * a33 - a23 * c3) + a13 * (c2 * a23 - a22 * c3)) / det AS b1,
  (a11 * (c2 * a33 - a23 * c3) - c1 * (a12 * a33 - a23 * a13) + a13 * (a12 * c3 - c2 * a13)) / det AS b2,
  (a11 * (a22 * c3 - c2 * a23) - a12 * (a12 * c3 - c2 * a13) + c1 * (a12 * a23 - a22 * a13)) / det AS b3 FROM d)
SELECT '{Q}' AS term, {r('b1', 2)} AS coefficient FROM b UNION ALL SELECT '{D}', {r('b2', 2)} FROM b
UNION ALL SELECT '{T_}', {r('b3', 2)} FROM b
UNION ALL SELECT '(intercept)', {r('my - b1 * m1 - b2 * m2 - b3 * m3', 2)} FROM b"""


@register("coefficients_three_features", THREE_FEATURES_SQL)
def coefficients_three_features(spark, sf):
    model = LinearRegression().fit(load(spark, sf, "lineitem"), LINE.features, LINE.target)
    return _coefficients(spark, model).withColumn("coefficient", F.round("coefficient", 2) + F.lit(0.0))


@register("three_features_full_lars_path", THREE_FEATURES_SQL)
def three_features_full_lars_path(spark, sf):
    """The whole path ends at least squares."""
    model = make("Lars").fit(load(spark, sf, "lineitem"), LINE.features, LINE.target)
    return _coefficients(spark, model).withColumn("coefficient", F.round("coefficient", 2) + F.lit(0.0))


@register("one_step_pursuit", f"""
WITH m AS (SELECT abs({_cov(Q, P)}) AS r1, abs({_cov(D, P)}) AS r2, abs({_cov(T_, P)}) AS r3,
 regr_slope({P}, {Q}) AS s1, regr_slope({P}, {D}) AS s2, regr_slope({P}, {T_}) AS s3, avg({P}) AS my,
 avg({Q}) AS m1, avg({D}) AS m2, avg({T_}) AS m3 FROM lineitem),
 b AS (SELECT my, m1, m2, m3, CASE WHEN r1 >= r2 AND r1 >= r3 THEN s1 ELSE 0 END AS b1,
  CASE WHEN r2 > r1 AND r2 >= r3 THEN s2 ELSE 0 END AS b2, CASE WHEN r3 > r1 AND r3 > r2 THEN s3 ELSE 0 END AS b3 FROM m)
SELECT '{Q}' AS term, {r('b1', 2)} AS coefficient FROM b UNION ALL SELECT '{D}', {r('b2', 2)} FROM b
UNION ALL SELECT '{T_}', {r('b3', 2)} FROM b
UNION ALL SELECT '(intercept)', {r('my - b1 * m1 - b2 * m2 - b3 * m3', 2)} FROM b""")
def one_step_pursuit(spark, sf):
    """One step of matching pursuit must take the feature with the largest covariance."""
    model = make("OrthogonalMatchingPursuit", n_nonzero_coefs=1).fit(load(spark, sf, "lineitem"), LINE.features, LINE.target)
    return _coefficients(spark, model).withColumn("coefficient", F.round("coefficient", 2) + F.lit(0.0))


for _name in ("ElasticNet", "LassoCV", "ElasticNetCV", "Lars", "LarsCV", "LassoLars", "LassoLarsCV", "LassoLarsIC",
              "OrthogonalMatchingPursuit", "OrthogonalMatchingPursuitCV", "BayesianRidge", "RidgeCV", "HuberRegressor",
              "RANSACRegressor", "SGDRegressor", "PassiveAggressiveRegressor", "LinearSVR", "QuantileRegressor", "TweedieRegressor"):
    def _fit(spark, sf, name=_name):
        return _coefficients(spark, make(name).fit(load(spark, sf, "lineitem"), LINE.features, LINE.target))

    register(f"fit_{_name}")(_fit)

SMALL = {"RandomForestRegressor": {"n_estimators": 20, "max_depth": 5}, "BaggingRegressor": {"max_depth": 5},
         "GradientBoostingRegressor": {"n_estimators": 10}, "HistGradientBoostingRegressor": {"max_iter": 10},
         "XGBRegressor": {"n_estimators": 10, "max_depth": 4}, "LGBMRegressor": {"n_estimators": 10},
         "AdaBoostRegressor": {"n_estimators": 10}, "DecisionTreeRegressor": {"max_depth": 8},
         "SVR": {"components": 50, "max_iter": 12}, "NuSVR": {"components": 50, "max_iter": 12, "C": 10.0},
         "ExtraTreeRegressor": {}, "ExtraTreesRegressor": {},
         "KernelRidge": {"kernel": "rbf"}, "GaussianProcessRegressor": {"alpha": 0.1}, "TransformedTargetRegressor": {"transformer": "yeo-johnson"},
         "PoissonRegressor": {"alpha": 0.01}, "GammaRegressor": {"alpha": 0.01}}
for _name, _args in SMALL.items():
    def _score(spark, sf, name=_name, args=_args):
        df = load(spark, sf, "lineitem").select(*LINE.features, LINE.target)
        model = make(name, **args).fit(df, LINE.features, LINE.target)
        return regression_metrics(model.predict(df, "yhat"), LINE.target, "yhat")

    register(f"fit_{_name}")(_score)


# A yes/no feature: one tree, one boosting step and the log-link families must all give the mean of either side.
BINARY = {"DecisionTreeRegressor": {}, "RandomForestRegressor": {"n_estimators": 1, "bootstrap": False},
          "BaggingRegressor": {"n_estimators": 1, "bootstrap": False}, "GradientBoostingRegressor": {"n_estimators": 1, "learning_rate": 1.0},
          "HistGradientBoostingRegressor": {"max_iter": 1, "learning_rate": 1.0},
          "XGBRegressor": {"n_estimators": 1, "learning_rate": 1.0, "reg_lambda": 0.0},  # the mean itself: no penalty
          "ExtraTreeRegressor": {}, "ExtraTreesRegressor": {"n_estimators": 3},
          "LGBMRegressor": {"n_estimators": 1, "learning_rate": 1.0}, "AdaBoostRegressor": {"n_estimators": 1},
          "PoissonRegressor": {"alpha": 0.0}, "GammaRegressor": {"alpha": 0.0}, "LinearRegression": {}}
for _name, _args in BINARY.items():
    def _binary(spark, sf, name=_name, args=_args):
        df = load(spark, sf, "lineitem").select((F.col("l_quantity") > 25).cast("double").alias("flag"), F.col("l_extendedprice").alias("y"))
        model = make(name, **args).fit(df, ["flag"], "y")
        return round_all(model.predict(df).groupBy("flag").agg(F.max("prediction").alias("highest"), F.min("prediction").alias("lowest"),
                                                               F.count(F.lit(1)).alias("row_count")), 2)

    register(f"binary_feature_{_name}", f"""
WITH s AS (SELECT CAST(l_quantity > 25 AS INTEGER)::DOUBLE AS flag, l_extendedprice AS y FROM lineitem)
SELECT flag, {r('avg(y)', 2)} AS highest, {r('avg(y)', 2)} AS lowest, count(*) AS row_count FROM s GROUP BY flag""")(_binary)

# Two yes/no features with effects of their own, and the rows of each of their four cells.
TWO_FLAGS = ("big", "dear")
TWO_FLAGS_SQL = """s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS INTEGER)::DOUBLE AS big, CAST(l_discount > 0.05 AS INTEGER)::DOUBLE AS dear,
  l_extendedprice + CASE WHEN l_quantity > 25 THEN 30000 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 9000 ELSE 0 END + CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN 4000 ELSE 0 END AS y
 FROM lineitem)"""


def two_flags(spark, sf):
    big, dear = F.col("l_quantity") > 25, F.col("l_discount") > 0.05
    y = F.col("l_extendedprice") + F.when(big, 30000.0).otherwise(0.0) + F.when(dear, 9000.0).otherwise(0.0) + F.when(big & dear, 4000.0).otherwise(0.0)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", big.cast("double").alias("big"), dear.cast("double").alias("dear"), y.alias("y"))


def _by_cell(df, model, *flags):
    return round_all(model.predict(df).groupBy(*flags).agg(F.max("prediction").alias("highest"), F.min("prediction").alias("lowest"),
                                                           F.count(F.lit(1)).alias("row_count")), 2)


@register("boosted_two_rounds", f"""
WITH {TWO_FLAGS_SQL}, m AS (SELECT avg(y) AS b FROM s), g AS (SELECT big, count(*) AS n, sum(y) AS t FROM s GROUP BY big),
 one AS (SELECT *, -sign(n * b - t) * greatest(abs(n * b - t) - 5000000, 0) / (n + 800) AS v FROM g, m),
 two AS (SELECT *, n * (b + 0.5 * v) - t AS g2 FROM one),
 done AS (SELECT *, b + 0.5 * v + 0.5 * -sign(g2) * greatest(abs(g2) - 5000000, 0) / (n + 800) AS p FROM two)
SELECT big, {r('p', 2)} AS highest, {r('p', 2)} AS lowest, n AS row_count FROM done""")
def boosted_two_rounds(spark, sf):
    """Two boosting rounds with penalties on one yes/no feature."""
    df = two_flags(spark, sf)
    model = make("XGBRegressor", n_estimators=2, learning_rate=0.5, max_depth=1, reg_lambda=800.0, reg_alpha=5e6).fit(df, ["big"], "y")
    return _by_cell(df, model, "big")


@register("boosted_four_leaves", f"""
WITH {TWO_FLAGS_SQL}, m AS (SELECT avg(y) AS b FROM s), g AS (SELECT big, dear, count(*) AS n, sum(y) AS t FROM s GROUP BY big, dear)
SELECT big, dear, {r('b - (n * b - t) / (n + 25)', 2)} AS highest, {r('b - (n * b - t) / (n + 25)', 2)} AS lowest, n AS row_count FROM g, m""")
def boosted_four_leaves(spark, sf):
    """One tree of depth 2 with penalised leaves, best leaf first."""
    df = two_flags(spark, sf)
    model = make("LGBMRegressor", n_estimators=1, learning_rate=1.0, num_leaves=4, reg_lambda=25.0).fit(df, list(TWO_FLAGS), "y")
    return _by_cell(df, model, *TWO_FLAGS)


@register("boosted_three_leaves", f"""
WITH {TWO_FLAGS_SQL}, c AS (SELECT big, dear, count(*) AS n, sum(y - (SELECT avg(y) FROM s)) AS t FROM s GROUP BY big, dear),
 side AS (SELECT big, sum(n) AS n, sum(t) AS t, sum(t * t / n) - sum(t) * sum(t) / sum(n) AS gain FROM c GROUP BY big),
 best AS (SELECT arg_max(big, gain) AS split FROM side)
SELECT c.big, c.dear, {r('(SELECT avg(y) FROM s) + CASE WHEN c.big = split THEN c.t / c.n ELSE side.t / side.n END', 2)} AS highest,
 {r('(SELECT avg(y) FROM s) + CASE WHEN c.big = split THEN c.t / c.n ELSE side.t / side.n END', 2)} AS lowest, c.n AS row_count
FROM c JOIN side ON side.big = c.big, best""")
def boosted_three_leaves(spark, sf):
    """Best leaf first: of the two leaves after the first split, the one with the larger gain is split, the other stays."""
    df = two_flags(spark, sf)
    model = make("LGBMRegressor", n_estimators=1, learning_rate=1.0, num_leaves=3).fit(df, list(TWO_FLAGS), "y")
    return _by_cell(df, model, *TWO_FLAGS)


@register("shap_values_tree", f"""
WITH {TWO_FLAGS_SQL}, cell AS (SELECT big, dear, avg(y) AS e FROM s GROUP BY big, dear), one AS (SELECT big, avg(y) AS e, count(*) AS n FROM s GROUP BY big),
 other AS (SELECT dear, sum(e * n) / sum(n) AS e FROM (SELECT cell.dear, cell.e, one.n FROM cell JOIN one USING (big)) GROUP BY dear), m AS (SELECT avg(y) AS e FROM s)
SELECT l_orderkey, l_linenumber, {r('((one.e - m.e) + (cell.e - other.e)) / 2', 2)} AS big, {r('((other.e - m.e) + (cell.e - one.e)) / 2', 2)} AS dear,
 {r('m.e', 2)} AS base_value
FROM s JOIN cell ON cell.big = s.big AND cell.dear = s.dear JOIN one ON one.big = s.big JOIN other ON other.dear = s.dear, m""")
def shap_values_tree(spark, sf):
    """Exact attributions of a tree of depth 2: the mean over both orders in which its features can become known."""
    df = two_flags(spark, sf)
    model = make("DecisionTreeRegressor", max_depth=2).fit(df, list(TWO_FLAGS), "y")
    return round_all(explain.shap_values(model, df, ["l_orderkey", "l_linenumber"]), 2)


@register("shap_values_boosted", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS INTEGER) AS big, l_extendedprice AS y FROM lineitem),
 m AS (SELECT avg(y) AS b FROM s), g AS (SELECT big, avg(y) AS e FROM s GROUP BY big)
SELECT l_orderkey, l_linenumber, {r('0.75 * (e - b)', 2)} AS big, {r('b', 2)} AS base_value FROM s JOIN g USING (big), m""")
def shap_values_boosted(spark, sf):
    """Two rounds at half the learning rate leave a quarter of each side's distance from the mean."""
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).cast("double").alias("big"), F.col("l_extendedprice").alias("y"))
    model = make("XGBRegressor", n_estimators=2, learning_rate=0.5, max_depth=1, reg_lambda=0.0).fit(df, ["big"], "y")
    return round_all(explain.shap_values(model, df, ["l_orderkey", "l_linenumber"]), 2)


TWO_VALUES_SQL = """s AS (SELECT CAST(l_quantity > 25 AS INTEGER)::DOUBLE AS big, l_extendedprice / 1000 AS y FROM lineitem),
 k AS (SELECT exp(-0.5 / var_pop(big)) AS k FROM s),
 g AS (SELECT sum(1 - big) AS n0, sum(big) AS n1, sum(y * (1 - big)) AS t0, sum(y * big) AS t1 FROM s)"""


def two_values(spark, sf):
    return load(spark, sf, "lineitem").select((F.col("l_quantity") > 25).cast("double").alias("big"), (F.col("l_extendedprice") / 1000).alias("y"))


@register("descent_r2", f"""
SELECT {r('regr_r2(l_extendedprice, l_quantity)', 3)} AS r2, CAST(count(*) AS BIGINT) AS row_count FROM lineitem""")
def descent_r2(spark, sf):
    """Stochastic descent explains what least squares explains."""
    df = load(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    model = make("SGDRegressor", alpha=0.0).fit(df, ["l_quantity"], "l_extendedprice")
    scored = regression_metrics(model.predict(df, "yhat"), "l_extendedprice", "yhat").select("r2")
    return round_all(scored.withColumn("row_count", F.lit(df.count())), 3)


@register("kernel_ridge_two_values", f"""
WITH {TWO_VALUES_SQL}, b AS (SELECT k, ((n1 + 20000) * t0 - n0 * k * t1) / d AS b0, ((n0 + 20000) * t1 - n1 * k * t0) / d AS b1
 FROM (SELECT *, (n0 + 20000) * (n1 + 20000) - n0 * n1 * k * k AS d FROM g, k))
SELECT 0.0::DOUBLE AS big, {r('b0 + k * b1', 3)} AS prediction FROM b UNION ALL SELECT 1.0, {r('k * b0 + b1', 3)} FROM b""")
def kernel_ridge_two_values(spark, sf):
    """The exact machine where all rows have one of two values: a system of two equations."""
    df = two_values(spark, sf)
    model = make("KernelRidge", kernel="rbf", gamma=0.5, alpha=20000.0).fit(df, ["big"], "y")
    return round_all(model.predict(df).groupBy("big").agg(F.max("prediction").alias("prediction")), 3)


@register("gaussian_process_two_values", f"""
WITH {TWO_VALUES_SQL}, a AS (SELECT k, 1 + 9000 / n0 AS a0, 1 + 9000 / n1 AS a1, t0 / n0 AS m0, t1 / n1 AS m1 FROM g, k),
 i AS (SELECT *, a0 * a1 - k * k AS d FROM a)
SELECT 0.0::DOUBLE AS big, {r('(a1 * m0 - k * m1 + k * (a0 * m1 - k * m0)) / d', 3)} AS prediction,
 {r('sqrt(1 - (a1 - 2 * k * k + k * k * a0) / d)', 3)} AS deviation FROM i
UNION ALL SELECT 1.0, {r('(k * (a1 * m0 - k * m1) + a0 * m1 - k * m0) / d', 3)}, {r('sqrt(1 - (k * k * a1 - 2 * k * k + a0) / d)', 3)} FROM i""")
def gaussian_process_two_values(spark, sf):
    """Mean and deviation of a process observed at two places, many times each."""
    df = two_values(spark, sf)
    model = make("GaussianProcessRegressor", alpha=9000.0, length_scale=1.0).fit(df, ["big"], "y")
    found = model.predict_spread(model.predict(df))
    return round_all(found.groupBy("big").agg(F.max("prediction").alias("prediction"), F.max("deviation").alias("deviation")), 3)


# A line that every row lies on, or all rows but each tenth order's, which are moved far away.
PLANTED_LINE = {"LinearSVR": (False, {}), "QuantileRegressor": (True, {}), "RANSACRegressor": (True, {}), "BayesianRidge": (False, {}),
                "RidgeCV": (False, {}), "HuberRegressor": (False, {}), "SGDRegressor": (False, {"alpha": 0.0, "max_iter": 60, "tol": 1e-9}),
                "PassiveAggressiveRegressor": (False, {"epsilon": 0.0, "tol": 1e-9, "max_iter": 80})}
for _name, (_moved, _args) in PLANTED_LINE.items():
    def _line(spark, sf, name=_name, args=_args, moved=_moved):
        far = F.when(F.lit(moved) & (F.col("l_orderkey") % 10 == 0), 5000.0 + 13 * F.col("l_quantity")).otherwise(0.0)
        df = load(spark, sf, "lineitem").select("l_quantity", (3 * F.col("l_quantity") + 7 + far).alias("y"))
        coefficients = _coefficients(spark, make(name, **args).fit(df, ["l_quantity"], "y"))
        return coefficients.withColumn("coefficient", F.round("coefficient", 1) + F.lit(0.0))

    register(f"planted_line_{_name}", f"""
WITH s AS (SELECT l_quantity, 3 * l_quantity + 7 AS y FROM lineitem {"WHERE l_orderkey % 10 <> 0" if _moved else ""})
SELECT 'l_quantity' AS term, {r('regr_slope(y, l_quantity)', 1)} AS coefficient FROM s
UNION ALL SELECT '(intercept)', {r('regr_intercept(y, l_quantity)', 1)} FROM s""")(_line)


@register("ransac_trials", f"""
WITH s AS (SELECT l_quantity, 3 * l_quantity + 7 AS y FROM lineitem WHERE l_orderkey % 10 <> 0)
SELECT CAST(100 AS BIGINT) AS trials, count(*) AS inliers FROM s""")
def ransac_trials(spark, sf):
    """All trials run whatever their size, and the best one counts every row of the line."""
    far = F.when(F.col("l_orderkey") % 10 == 0, 5000.0 + 13 * F.col("l_quantity")).otherwise(0.0)
    df = load(spark, sf, "lineitem").select("l_quantity", (3 * F.col("l_quantity") + 7 + far).alias("y"))
    info = make("RANSACRegressor", min_samples=2, residual_threshold=1.0, max_trials=100).fit(df, ["l_quantity"], "y").info
    return spark.createDataFrame([(info["trials"], info["inliers"])], "trials long, inliers long")


@register("neighbor_regression", f"""
WITH {SPLIT_SQL},
 d AS (SELECT a.p_partkey, b.p_retailprice AS y, row_number() OVER (PARTITION BY a.p_partkey ORDER BY
  sqrt(pow(a.p_size - b.p_size, 2) + pow(a.p_retailprice - b.p_retailprice, 2)), b.p_partkey) AS k
  FROM s a JOIN s b ON a.test AND NOT b.test)
SELECT p_partkey, {r('avg(y)', 5)} AS prediction FROM d WHERE k <= 5 GROUP BY p_partkey""")
def neighbor_regression(spark, sf):
    df = part(spark, sf).withColumn("y", F.col("p_retailprice"))
    train, test = train_test_split(df, ["p_partkey"])
    model = make("KNeighborsRegressor", row_id="p_partkey").fit(train, ["p_size", "p_retailprice"], "y")
    return round_all(model.predict(test).select("p_partkey", "prediction"), 5)


@register("random_search_ridge")
def random_search_ridge(spark, sf):
    found = tune("Ridge", load(spark, sf, "lineitem").select(*LINE.features, LINE.target), LINE.features, LINE.target)
    return spark.createDataFrame([(p["alpha"], p["fit_intercept"], s) for p, s in found.trials],
                                 "alpha double, fit_intercept boolean, score double")


@register("random_search_decision_tree")
def random_search_decision_tree(spark, sf):
    found = tune("DecisionTreeRegressor", part(spark, sf).select("p_size", "p_partkey", "p_retailprice"),
                 ["p_size", "p_partkey"], "p_retailprice", n_iter=4, folds=3, scoring="neg_root_mean_squared_error")
    return spark.createDataFrame([(str(p["max_depth"]), p["min_samples_leaf"], s) for p, s in found.trials],
                                 "max_depth string, min_samples_leaf int, score double")


# --- explanation ------------------------------------------------------------------------------------

FIT2 = """f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
 avg(l_quantity) AS m FROM lineitem)"""


def _line_model(spark, sf):
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return df, LinearRegression().fit(df, ["l_quantity"], "l_extendedprice")


@register("partial_dependence_linear", f"""
WITH {FIT2}, g AS (SELECT DISTINCT l_quantity AS value FROM lineitem)
SELECT {r('value')} AS value, {r('a + b * value', 4)} AS average FROM g, f""")
def partial_dependence_linear(spark, sf):
    df, model = _line_model(spark, sf)
    return round_all(explain.partial_dependence(model, df, "l_quantity"), 4)


@register("shap_values_linear", f"""
WITH {FIT2} SELECT l_orderkey, l_linenumber, {r('b * (l_quantity - m)', 4)} AS l_quantity,
 {r('a + b * m', 4)} AS base_value FROM lineitem, f""")
def shap_values_linear(spark, sf):
    df, model = _line_model(spark, sf)
    return round_all(explain.shap_values(model, df, ["l_orderkey", "l_linenumber"]), 4)


@register("shap_summary_linear", f"""
WITH {FIT2}, s AS (SELECT abs(b * (l_quantity - m)) AS v FROM lineitem, f)
SELECT 'l_quantity' AS feature, {r('max(v)', 4)} AS max_abs, {r('avg(v)', 4)} AS mean_abs FROM s""")
def shap_summary_linear(spark, sf):
    df, model = _line_model(spark, sf)
    values = explain.shap_values(model, df, ["l_orderkey", "l_linenumber"])
    return round_all(explain.shap_summary(values, ["l_quantity"]), 4)


def _forest(spark, sf):
    df = planted(spark, sf)
    return df, RandomForest(n_estimators=10, max_depth=5).fit(df, PLANTED_ROLES.features, "y")


@register("forest_importance")
def forest_importance(spark, sf):
    df, model = _forest(spark, sf)
    return explain.feature_importance(model, df, "y", ["p_partkey"])


@register("permutation_importance")
def permutation_importance(spark, sf):
    df = planted(spark, sf)
    model = LinearRegression().fit(df, PLANTED_ROLES.features, "y")
    return explain.feature_importance(model, df, "y", ["p_partkey"])


@register("partial_dependence_forest")
def partial_dependence_forest(spark, sf):
    df, model = _forest(spark, sf)
    return explain.partial_dependence(model, df, "p_size", 20)


@register("shap_values_forest")
def shap_values_forest(spark, sf):
    df, model = _forest(spark, sf)
    return explain.shap_values(model, df, ["p_partkey"], n_permutations=3)


# --- log and plan -----------------------------------------------------------------------------------

@register("model_run_log", f"""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
 e AS (SELECT l_extendedprice AS y, a + b * l_quantity AS yhat FROM lineitem, f)
SELECT 'LinearRegression' AS model_name, 'mean' AS missing_values_method, CAST(5 AS INTEGER) AS cv_folds,
 70.0::DOUBLE AS split_percentage, {r('avg(abs(y - yhat))', 4)} AS mae, {r('sqrt(avg((y - yhat) * (y - yhat)))', 4)} AS rmse,
 {r('1 - avg((y - yhat) * (y - yhat)) / var_pop(y)', 4)} AS r2 FROM e""")
def model_run_log(spark, sf):
    from tabreg.sources.runlog import ModelLog
    from tabreg.sources.storage import shared_path

    df, model = _line_model(spark, sf)
    scores = regression_metrics(model.predict(df, "yhat"), "l_extendedprice", "yhat").first().asDict()
    log = ModelLog(spark, shared_path(spark, "runlog"))
    log.log_iteration({"model_name": "LinearRegression", "split_percentage": 70.0, "cv_folds": 5,
                       "missing_values_method": "mean", "metrics": {k: scores[k] for k in ("mae", "mse", "rmse", "r2")}})
    return round_all(log.frame().select("model_name", "missing_values_method", "cv_folds", "split_percentage",
                                        "mae", "rmse", "r2"), 4)


@register("saved_model_predictions", f"""
WITH {FIT2} SELECT l_orderkey, l_linenumber, {r('a + b * l_quantity', 4)} AS prediction FROM lineitem, f""")
def saved_model_predictions(spark, sf):
    from tabreg.sources.artifacts import load_model, save_model
    from tabreg.sources.storage import shared_path

    df, model = _line_model(spark, sf)
    folder = shared_path(spark, "models")
    save_model(spark, model, folder, "line")
    again = load_model(spark, folder, "line")
    return round_all(again.predict(df).select("l_orderkey", "l_linenumber", "prediction"), 4)


@register("prepared_table", """
WITH k AS (SELECT *, CASE WHEN p_size = 7 THEN NULL ELSE p_size END AS s FROM part WHERE p_retailprice <= 1500),
 m AS (SELECT p_partkey, p_retailprice, coalesce(s, (SELECT avg(s) FROM k)) AS p_size FROM k)
SELECT p_partkey, p_retailprice, """ + r("(p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())") + """ AS p_size
FROM m""")
def prepared_table(spark, sf):
    roles = Roles(["p_size"], "p_retailprice", row_id=["p_partkey"])
    df = part(spark, sf).select("p_partkey", F.when(F.col("p_size") != 7, F.col("p_size").cast("double")).alias("p_size"), "p_retailprice")
    spec = (PipelineSpec().then("remove_by_threshold", col="p_retailprice", condition="greater than", threshold=1500.0)
            .then("impute_missing", method="mean").then("scale_features", kind="minmax"))
    return round_all(PipelineSpec.from_json(spec.to_json()).apply(df, roles)[0])


# --- text features with any number of values ---------------------------------------------------------------

@register("wide_ridge_customers", f"""
WITH g AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1),
 m AS (SELECT sum(t / (n + 1)) / sum(CAST(n AS DOUBLE) / (n + 1)) AS m FROM g)
SELECT o_orderkey, o_custkey, {r('m + (t - n * m) / (n + 1)', 3)} AS prediction FROM orders JOIN g USING (o_custkey), m""")
def wide_ridge_customers(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("C"), "o_custkey").alias("customer"), "o_totalprice")
    made = WideRidge(alpha=1.0).fit(df, ["customer"], "o_totalprice").predict(df)
    return round_all(made.select("o_orderkey", "o_custkey", "prediction"), 3)


@register("wide_ridge_optimality", """
SELECT DISTINCT 'supplier' AS feature, 'S' || l_suppkey AS value, 0.0::DOUBLE AS gap FROM lineitem
UNION ALL SELECT DISTINCT 'l_returnflag', l_returnflag, 0.0::DOUBLE FROM lineitem""")
def wide_ridge_optimality(spark, sf):
    """Gradient of the penalised squares at every value's coefficient, as a share of the target's sum: zero at the optimum."""
    df = load(spark, sf, "lineitem").select("l_quantity", "l_discount", F.concat(F.lit("S"), "l_suppkey").alias("supplier"),
                                            "l_returnflag", "l_extendedprice")
    model = WideRidge(alpha=1.0).fit(df, ["l_quantity", "l_discount", "supplier", "l_returnflag"], "l_extendedprice")
    made, out = model.predict(df), None
    for c, effects in model.tables.items():
        sums = made.groupBy(F.col(c).alias("value")).agg(F.sum(F.col("l_extendedprice") - F.col("prediction")).alias("e"),
                                                         F.sum("l_extendedprice").alias("y"))
        part = sums.join(effects.withColumnRenamed("code", "x"), "value").select(
            F.lit(c).alias("feature"), "value", ((F.col("e") - F.col("x")) / F.col("y")).alias("gap"))
        out = part if out is None else out.unionByName(part)
    return round_all(out, 6)
