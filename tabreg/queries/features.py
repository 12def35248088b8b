"""Queries: scaling, encoding, row statistics, band indices, selection, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabreg.operators import encode, evaluate, rowstats, select, sparse, spectral
from tabreg.queries.catalog import load, r, register, round_all
from tabreg.roles import Roles

SCALED = ["l_quantity", "l_discount", "l_tax"]
LINE_ROLES = Roles(["l_quantity", "l_discount", "l_tax", "l_returnflag"], "l_extendedprice", ["l_returnflag"])
BANDS = [str(400 + i) for i in range(64)]
BAND_ROLES = Roles(BANDS, "label", order_by=["vec_id"], row_id=["vec_id"])
BAND_SQL = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS \"{b}\"" for i, b in enumerate(BANDS))


def bands(spark, sf):
    """embeddings as a spectral table: 64 band columns named by wavelength."""
    return load(spark, sf, "embeddings").selectExpr(
        "vec_id", "label", *[f"CAST(embedding[{i}] AS DOUBLE) AS `{b}`" for i, b in enumerate(BANDS)])


def _line(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SCALED)


@register("scale_to_unit_range", f"""
SELECT l_orderkey, l_linenumber, {', '.join(
    f"{r(f'({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0)')} AS {c}" for c in SCALED)}
FROM lineitem""")
def scale_to_unit_range(spark, sf):
    return round_all(encode.scale(_line(spark, sf), SCALED, "minmax"))


@register("scale_to_unit_variance", f"""
SELECT l_orderkey, l_linenumber, {', '.join(
    f"{r(f'({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0)')} AS {c}" for c in SCALED)}
FROM lineitem""")
def scale_to_unit_variance(spark, sf):
    return round_all(encode.scale(_line(spark, sf), SCALED, "standard"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def dummies_sql(levels):
    return "SELECT o_orderkey, " + ", ".join(
        f"CASE WHEN o_orderpriority = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"o_orderpriority_{v}\"" for v in levels) + " FROM orders"


def _priority(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")


@register("one_hot_all_levels", dummies_sql(PRIORITIES))
def one_hot_all_levels(spark, sf):
    return encode.one_hot(_priority(spark, sf), ["o_orderpriority"])


@register("one_hot_drop_first", dummies_sql(PRIORITIES[1:]))
def one_hot_drop_first(spark, sf):
    return encode.one_hot(_priority(spark, sf), ["o_orderpriority"], drop_first=True)


@register("one_hot_wide_vectors", """
WITH n AS (SELECT count(DISTINCT o_orderkey) AS n, count(DISTINCT o_orderpriority) AS m FROM orders)
SELECT o_orderkey, CAST(n + m AS INTEGER) AS size, CAST(dense_rank() OVER (ORDER BY 'O' || o_orderkey) - 1 AS INTEGER) AS first_place,
 CAST(n + dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS second_place, 2.0::DOUBLE AS ones
FROM orders, n""")
def one_hot_wide_vectors(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("O"), "o_orderkey").alias("name"), "o_orderpriority")
    made = sparse.sparse_dummies(df, ["name", "o_orderpriority"]).select("o_orderkey", F.unwrap_udt("dummies").alias("v"))
    return made.select("o_orderkey", "v.size", F.col("v.indices")[0].alias("first_place"), F.col("v.indices")[1].alias("second_place"),
                       F.aggregate("v.values", F.lit(0.0), lambda a, b: a + b).alias("ones"))


@register("label_encode_priority", """
SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders""")
def label_encode_priority(spark, sf):
    return encode.label_encode(_priority(spark, sf), ["o_orderpriority"])


@register("ordinal_encode_part_names", """
SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS p_name,
 dense_rank() OVER (ORDER BY p_type) - 1 AS p_type FROM part""")
def ordinal_encode_part_names(spark, sf):
    df = load(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return encode.ordinal_encode(df, df, ["p_name", "p_type"])


def row_features_sql(digits=5):
    def rr(e):
        return f"(round({e}, {digits}) + 0.0)"

    med = "list_median(a)"
    weights = "[" + ", ".join(f"{float(b)}" for b in BANDS) + "]"
    return f"""
WITH b AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
 s AS (SELECT vec_id, label, a, list_avg(a) AS m, {med} AS md, list_stddev_samp(a) AS sd,
  list_aggregate(a, 'quantile_cont', 0.9) AS p90 FROM b)
SELECT vec_id, label, {rr('m')} AS "Mean", {rr('md')} AS "Median", {rr('sd')} AS "Std",
 {rr('len(list_filter(a, lambda x: abs(x - m) > sd)) / 64.0::DOUBLE')} AS "Percent_Beyond_Std",
 {rr('list_max(a) - list_min(a)')} AS "Amplitude", {rr('list_max(a)')} AS "Max", {rr('list_min(a)')} AS "Min",
 {rr('list_max(list_transform(range(2, 65), lambda i: abs(a[i] - a[i - 1])))')} AS "Max_Slope",
 {rr('list_median(list_transform(a, lambda x: abs(x - md)))')} AS "MAD",
 {rr('len(list_filter(a, lambda x: abs(x - md) < 0.5 * md)) * 100.0::DOUBLE / 64')} AS "Percent_Close_to_Median",
 {rr('coalesce(list_skewness(a), 0)')} AS "Skew", {rr('p90')} AS "Flux_Percentile",
 {rr(f"list_dot_product(a, CAST({weights} AS DOUBLE[])) / list_sum(CAST({weights} AS DOUBLE[]))")} AS "Weighted_Average",
 {rr('coalesce(p90 / nullif(lag(p90) OVER (ORDER BY vec_id), 0) - 1, 0)')} AS "Percent_Difference_Flux_Percentile"
FROM s"""


@register("row_statistics", row_features_sql())
def row_statistics(spark, sf):
    return round_all(rowstats.row_features(bands(spark, sf), BAND_ROLES), 5)


PAIR_ROLES = Roles(["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice")


def ndsi_sql(cols, target, source, digits=6):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            z = f'("{a}" - "{b}") / nullif("{a}" + "{b}", 0)'
            parts.append(f"""SELECT '{a},{b}' AS pair, '{a}' AS band1, '{b}' AS band2,
 {r(f'corr({z}, "{target}")', digits)} AS "Pearson_Corr" FROM {source}""")
    return " UNION ALL ".join(parts)


@register("ndsi_pair_correlations", ndsi_sql(PAIR_ROLES.features, "l_extendedprice", "lineitem"))
def ndsi_pair_correlations(spark, sf):
    out = spectral.ndsi_correlations(load(spark, sf, "lineitem"), PAIR_ROLES)
    return round_all(out.select("pair", "band1", "band2", "Pearson_Corr"))


@register("ndsi_pair_p_values")
def ndsi_pair_p_values(spark, sf):
    return spectral.ndsi_correlations(load(spark, sf, "lineitem"), PAIR_ROLES)


NDSI_LONG_SQL = """
WITH b AS (SELECT vec_id, CAST(label AS DOUBLE) AS y, generate_subscripts(embedding, 1) AS i,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
 z AS (SELECT p.i AS i, q.i AS j, (p.v - q.v) / nullif(p.v + q.v, 0) AS z, p.y
  FROM b p JOIN b q ON p.vec_id = q.vec_id AND p.i < q.i),
 c AS (SELECT i, j, corr(z, y) AS r FROM z WHERE z IS NOT NULL GROUP BY i, j)"""


@register("ndsi_band_correlations", NDSI_LONG_SQL + f"""
SELECT (399 + i) || ',' || (399 + j) AS pair, CAST(399 + i AS VARCHAR) AS band1, CAST(399 + j AS VARCHAR) AS band2,
 {r('r')} AS "Pearson_Corr" FROM c""")
def ndsi_band_correlations(spark, sf):
    out = spectral.ndsi_correlations(bands(spark, sf), BAND_ROLES)
    return round_all(out.select("pair", "band1", "band2", "Pearson_Corr"))


@register("ndsi_local_extrema", NDSI_LONG_SQL + f"""
SELECT CAST(399 + c.i AS VARCHAR) AS band1, CAST(399 + c.j AS VARCHAR) AS band2,
 {r('c.r')} AS "Pearson_Corr", CASE WHEN c.r < 0 THEN 'min' ELSE 'max' END AS kind
FROM c WHERE abs(c.r) > 0.05 AND NOT EXISTS (SELECT 1 FROM c d WHERE d.i - c.i BETWEEN -5 AND 4
 AND d.j - c.j BETWEEN -5 AND 4 AND (CASE WHEN c.r > 0 THEN d.r > c.r ELSE d.r < c.r END))""")
def ndsi_local_extrema(spark, sf):
    pairs = spectral.ndsi_correlations(bands(spark, sf), BAND_ROLES)
    return round_all(spectral.ndsi_extrema(pairs, 0.05, 10))


@register("ndsi_index_columns", f"""
SELECT l_orderkey, l_linenumber, {r('(l_quantity - l_tax) / nullif(l_quantity + l_tax, 0)')} AS "l_quantity-l_tax",
 {r('(l_discount - l_tax) / nullif(l_discount + l_tax, 0)')} AS "l_discount-l_tax" FROM lineitem""")
def ndsi_index_columns(spark, sf):
    out = spectral.ndsi_apply(load(spark, sf, "lineitem"), [("l_quantity", "l_tax"), ("l_discount", "l_tax")],
                              ["l_orderkey", "l_linenumber"])
    return round_all(out)


def f_sql(c):
    return f"regr_r2(l_extendedprice, {c}) / (1 - regr_r2(l_extendedprice, {c})) * (count(*) - 2)"


@register("feature_f_scores", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f_sql(c), 4)} AS f_score FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def feature_f_scores(spark, sf):
    return round_all(select.f_scores(load(spark, sf, "lineitem"), LINE_ROLES), 4)


@register("select_k_best_f", f"""
WITH s AS (SELECT {', '.join(f'{f_sql(c)} AS {c}' for c in ('l_quantity', 'l_discount', 'l_tax'))} FROM lineitem)
SELECT l_quantity, CASE WHEN (SELECT l_discount > l_tax FROM s) THEN l_discount ELSE l_tax END AS second_best,
 l_returnflag, l_extendedprice FROM lineitem""")
def select_k_best_f(spark, sf):
    out, roles = select.select_k_best(load(spark, sf, "lineitem"), LINE_ROLES, 2)
    second = [c for c in roles.numeric if c != "l_quantity"][0]
    return out.withColumnRenamed(second, "second_best")


LINE_FIT = """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b,
 regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
 p AS (SELECT l_extendedprice AS y, a + b * l_quantity AS yhat FROM lineitem, f)"""


def line_prediction(spark, sf):
    df = load(spark, sf, "lineitem")
    fit = df.agg(F.regr_slope("l_extendedprice", "l_quantity"), F.regr_intercept("l_extendedprice", "l_quantity")).first()
    return df.select(F.col("l_extendedprice").alias("y"), (F.lit(fit[1]) + F.lit(fit[0]) * F.col("l_quantity")).alias("yhat"))


@register("regression_metrics", LINE_FIT + f"""
SELECT {r('avg(abs(y - yhat))', 4)} AS mae, round(avg((y - yhat) * (y - yhat)), 1) + 0.0 AS mse,
 {r('sqrt(avg((y - yhat) * (y - yhat)))', 4)} AS rmse,
 {r('1 - avg((y - yhat) * (y - yhat)) / var_pop(y)', 4)} AS r2,
 {r('stddev_samp(y) / sqrt(avg((y - yhat) * (y - yhat)))', 4)} AS rpd FROM p""")
def regression_metrics(spark, sf):
    out = evaluate.regression_metrics(line_prediction(spark, sf), "y", "yhat")
    return round_all(out, 4).withColumn("mse", F.round("mse", 1))


@register("true_vs_predicted", LINE_FIT + f" SELECT {r('y', 4)} AS y, {r('yhat', 4)} AS yhat FROM p")
def true_vs_predicted(spark, sf):
    return round_all(evaluate.true_vs_predicted(line_prediction(spark, sf), "y", "yhat"), 4)


@register("identity_line_ends", LINE_FIT + f"""
SELECT {r('least(min(y), min(yhat))', 4)} AS low, {r('greatest(max(y), max(yhat))', 4)} AS high FROM p""")
def identity_line_ends(spark, sf):
    return round_all(evaluate.identity_line(line_prediction(spark, sf), "y", "yhat"), 4)
