"""Queries: sources, profiling, cleaning, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabreg.operators import clean, impute, profile
from tabreg.queries.catalog import load, r, register, round_all
from tabreg.roles import Roles, select_roles
from tabreg.sources.tables import preview

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HOLES_SQL = """SELECT CASE WHEN l_quantity BETWEEN 1 AND 3 THEN NULL ELSE l_quantity END AS l_quantity,
 l_extendedprice, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax,
 CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS l_returnflag FROM lineitem"""


def line_with_holes(spark, sf):
    """lineitem columns in which three columns have missing cells."""
    df = load(spark, sf, "lineitem")
    return df.select(
        F.when(~F.col("l_quantity").between(1, 3), F.col("l_quantity")).alias("l_quantity"), "l_extendedprice",
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("l_discount"), "l_tax",
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("l_returnflag"))


def totals(df, numbers, texts=()):
    """Order-free digest of a table: count, non-NULL counts and sums per column."""
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for c in numbers:
        aggs += [F.count(c).alias(f"{c}_present"), F.sum(F.col(c).cast("double")).alias(f"{c}_sum")]
    for c in texts:
        aggs.append(F.count(c).alias(f"{c}_present"))
    return round_all(df.agg(*aggs), 2)


def totals_sql(source, numbers, texts=()):
    parts = ["count(*) AS row_count"]
    for c in numbers:
        parts += [f"count({c}) AS {c}_present", f"{r(f'sum({c})', 2)} AS {c}_sum"]
    parts += [f"count({c}) AS {c}_present" for c in texts]
    return f"SELECT {', '.join(parts)} FROM ({source})"


@register("preview_first_events",
          "SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY ts, event_id LIMIT 5")
def preview_first_events(spark, sf):
    df = load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return preview(df, ["ts", "event_id"], 5)


@register("table_shape", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def table_shape(spark, sf):
    return profile.shape(load(spark, sf, "lineitem"))


@register("csv_round_trip", totals_sql("SELECT * FROM customer", ["c_custkey", "c_acctbal"], ["c_name"]))
def csv_round_trip(spark, sf):
    from tabreg.sources.storage import shared_path
    from tabreg.sources.tables import read_table

    path = shared_path(spark, "csv")
    load(spark, sf, "customer").write.option("header", True).mode("overwrite").csv(path)
    return totals(read_table(spark, path, "csv"), ["c_custkey", "c_acctbal"], ["c_name"])


@register("null_counts_with_total", f"""
WITH h AS ({HOLES_SQL}),
 a AS (SELECT count(*) - count(l_quantity) AS a, count(*) - count(l_extendedprice) AS b,
   count(*) - count(l_discount) AS c, count(*) - count(l_tax) AS d, count(*) - count(l_returnflag) AS e FROM h)
SELECT 'l_quantity' AS "column", a AS nulls FROM a UNION ALL SELECT 'l_extendedprice', b FROM a
UNION ALL SELECT 'l_discount', c FROM a UNION ALL SELECT 'l_tax', d FROM a
UNION ALL SELECT 'l_returnflag', e FROM a UNION ALL SELECT '__total__', a + b + c + d + e FROM a""")
def null_counts_with_total(spark, sf):
    return profile.null_counts(line_with_holes(spark, sf))


@register("cardinality_classes", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, "
    f"CASE WHEN count(DISTINCT {c}) > 11 THEN 'high' ELSE 'low' END AS cardinality FROM part"
    for c in ("p_name", "p_brand", "p_type", "p_size")))
def cardinality_classes(spark, sf):
    return profile.cardinality(load(spark, sf, "part"), ["p_name", "p_brand", "p_type", "p_size"])


@register("threshold_default_quantiles", f"""
SELECT 'l_extendedprice' AS "column", {r('quantile_cont(l_extendedprice, 0.5)')} AS median,
 {r('quantile_cont(l_extendedprice, 0.05)')} AS q05, {r('quantile_cont(l_extendedprice, 0.95)')} AS q95
FROM lineitem""")
def threshold_default_quantiles(spark, sf):
    return round_all(profile.threshold_defaults(load(spark, sf, "lineitem"), "l_extendedprice"))


@register("basic_column_statistics", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std,
 {r(f'min({c})')} AS min, {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS q50,
 {r(f'quantile_cont({c}, 0.75)')} AS q75, {r(f'max({c})')} AS max FROM lineitem""" for c in LINE_NUMBERS))
def basic_column_statistics(spark, sf):
    return round_all(profile.basic_statistics(load(spark, sf, "lineitem"), LINE_NUMBERS))


@register("drop_first_hundred_rows", """
SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 101 AS idx FROM events
QUALIFY row_number() OVER (ORDER BY ts, event_id) > 100""")
def drop_first_hundred_rows(spark, sf):
    df = clean.drop_first_rows(load(spark, sf, "events"), 100, ["ts", "event_id"])
    return df.select("event_id", "value", F.col("__idx").alias("idx"))


@register("select_feature_roles", """
SELECT l_quantity, l_discount, l_tax, l_returnflag, l_extendedprice FROM lineitem""")
def select_feature_roles(spark, sf):
    roles = Roles(["l_quantity", "l_discount", "l_tax", "l_returnflag"], "l_extendedprice", ["l_returnflag"])
    return select_roles(load(spark, sf, "lineitem"), roles)


@register("replace_sentinel_value", """
SELECT count(*) AS row_count, count(NULLIF(l_quantity, 7)) AS quantity_present,
 count(NULLIF(l_linenumber, 7)) AS linenumber_present, count(NULLIF(l_suppkey, 7)) AS suppkey_present,
 count(l_returnflag) AS flag_present FROM lineitem""")
def replace_sentinel_value(spark, sf):
    df = clean.replace_with_null(load(spark, sf, "lineitem"), "7")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count("l_quantity").alias("quantity_present"),
                  F.count("l_linenumber").alias("linenumber_present"), F.count("l_suppkey").alias("suppkey_present"),
                  F.count("l_returnflag").alias("flag_present"))


@register("replace_many_sentinels", """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F') THEN NULL ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS o_orderpriority,
 CASE WHEN o_custkey IN (5, 17) THEN NULL ELSE o_custkey END AS o_custkey FROM (
 SELECT CASE WHEN o_orderkey IN (5, 17) THEN NULL ELSE o_orderkey END AS o_orderkey, o_orderstatus,
 o_orderpriority, o_custkey FROM orders)""")
def replace_many_sentinels(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    return clean.replace_with_null(df, "F, 1-URGENT, 5, 17.0")


@register("replace_value_range", """
SELECT CASE WHEN c_custkey BETWEEN 0 AND 1000 THEN NULL ELSE c_custkey END AS c_custkey, c_name,
 CASE WHEN c_nationkey BETWEEN 0 AND 1000 THEN NULL ELSE c_nationkey END AS c_nationkey,
 CASE WHEN c_acctbal BETWEEN 0 AND 1000 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer""")
def replace_value_range(spark, sf):
    df = clean.replace_range_with_null(load(spark, sf, "customer"), 0.0, 1000.0)
    return df.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@register("replace_value_range_report", """
SELECT 'c_acctbal' AS "column", count(*) FILTER (c_acctbal BETWEEN 0 AND 1000) AS replaced, true AS checked
FROM customer UNION ALL SELECT 'c_name', CAST(0 AS BIGINT), false""")
def replace_value_range_report(spark, sf):
    return clean.range_report(load(spark, sf, "customer").select("c_acctbal", "c_name"), 0.0, 1000.0)


def iqr_sql(cols, multiplier):
    steps, source = [], "lineitem"
    for i, c in enumerate(cols):
        steps.append(f"""q{i} AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {source}),
 t{i} AS (SELECT {source}.* FROM {source}, q{i} WHERE {c} >= a - {multiplier}*(b-a) AND {c} <= b + {multiplier}*(b-a))""")
        source = f"t{i}"
    return f"WITH {', '.join(steps)} SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax FROM {source}"


SKEWED_SQL = """lineitem_ AS (SELECT l_orderkey, l_linenumber, l_tax,
 l_quantity * l_quantity * l_quantity AS l_quantity, l_extendedprice * l_extendedprice / 1000 AS l_extendedprice
 FROM lineitem)"""


@register("iqr_filter_sequential", iqr_sql(["l_quantity", "l_extendedprice", "l_tax"], 1.0)
          .replace("FROM lineitem", "FROM lineitem_").replace("lineitem.*", "lineitem_.*")
          .replace("lineitem, q0", "lineitem_, q0").replace("lineitem__", "lineitem_")
          .replace("WITH ", f"WITH {SKEWED_SQL}, ", 1))
def iqr_filter_sequential(spark, sf):
    df = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_tax",
        (F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity")).alias("l_quantity"),
        (F.col("l_extendedprice") * F.col("l_extendedprice") / 1000).alias("l_extendedprice"))
    kept = clean.remove_outliers_iqr(df, ["l_quantity", "l_extendedprice", "l_tax"], 1.0)
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")


KEPT = "l_orderkey, l_linenumber, l_quantity"


def _line(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@register("threshold_greater_than", f"SELECT {KEPT} FROM lineitem WHERE l_quantity <= 40")
def threshold_greater_than(spark, sf):
    return clean.remove_by_threshold(_line(spark, sf), "l_quantity", "greater than", 40.0)


@register("threshold_less_than", f"SELECT {KEPT} FROM lineitem WHERE l_quantity >= 10")
def threshold_less_than(spark, sf):
    return clean.remove_by_threshold(_line(spark, sf), "l_quantity", "less than", 10.0)


@register("threshold_outside_range", f"SELECT {KEPT} FROM lineitem WHERE l_quantity BETWEEN 10 AND 40")
def threshold_outside_range(spark, sf):
    return clean.remove_by_threshold(_line(spark, sf), "l_quantity", "outside range", low=10.0, high=40.0)


@register("removal_report", f"""
SELECT count(*) AS rows_before, count(*) FILTER (l_quantity <= 40) AS rows_after,
 count(*) - count(*) FILTER (l_quantity <= 40) AS removed,
 {r('(count(*) - count(*) FILTER (l_quantity <= 40)) * 100.0 / count(*)')} AS removed_percent FROM lineitem""")
def removal_report(spark, sf):
    df = _line(spark, sf)
    return round_all(clean.removal_report(df, clean.remove_by_threshold(df, "l_quantity", "greater than", 40.0)))


@register("drop_incomplete_rows", f"SELECT * FROM ({HOLES_SQL}) WHERE l_quantity IS NOT NULL "
          "AND l_discount IS NOT NULL AND l_returnflag IS NOT NULL")
def drop_incomplete_rows(spark, sf):
    return clean.drop_null_rows(line_with_holes(spark, sf))


@register("drop_incomplete_columns", "SELECT l_extendedprice, l_tax FROM lineitem")
def drop_incomplete_columns(spark, sf):
    return clean.drop_null_columns(line_with_holes(spark, sf))


def filled_sql(quantity, discount, flag="l_returnflag"):
    return f"""WITH h AS ({HOLES_SQL})
SELECT {r(f'coalesce(l_quantity, {quantity})')} AS l_quantity, {r('l_extendedprice')} AS l_extendedprice,
 {r(f'coalesce(l_discount, {discount})')} AS l_discount, {r('l_tax')} AS l_tax, {flag} AS l_returnflag FROM h"""


@register("impute_mean", filled_sql("(SELECT avg(l_quantity) FROM h)", "(SELECT avg(l_discount) FROM h)"))
def impute_mean(spark, sf):
    return round_all(impute.impute(line_with_holes(spark, sf), "mean"))


@register("impute_median", filled_sql("(SELECT quantile_cont(l_quantity, 0.5) FROM h)",
                                      "(SELECT quantile_cont(l_discount, 0.5) FROM h)"))
def impute_median(spark, sf):
    return round_all(impute.impute(line_with_holes(spark, sf), "median"))


def mode_sql(c):
    return f"(SELECT {c} FROM h WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@register("impute_mode", filled_sql(mode_sql("l_quantity"), mode_sql("l_discount"),
                                    f"coalesce(l_returnflag, {mode_sql('l_returnflag')})"))
def impute_mode(spark, sf):
    return round_all(impute.impute(line_with_holes(spark, sf), "mode"))


@register("impute_zero", filled_sql("0", "0"))
def impute_zero(spark, sf):
    return round_all(impute.impute(line_with_holes(spark, sf), "zero"))
