"""Queries: date parsing, resampling, smoothing, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabreg.operators import smooth, split, timeops
from tabreg.queries.catalog import load, r, register, round_all

EVENTS_SQL = "SELECT ts, value FROM events"


def _events(spark, sf):
    return load(spark, sf, "events").select("ts", "value")


BIN = {"30T": "time_bucket(INTERVAL '30 minutes', ts)", "H": "date_trunc('hour', ts)", "D": "date_trunc('day', ts)",
       "W": "date_trunc('week', ts)", "M": "date_trunc('month', ts)", "Q": "date_trunc('quarter', ts)",
       "Y": "date_trunc('year', ts)"}
STEP = {"30T": "30 minutes", "H": "1 hour", "D": "1 day", "W": "7 days", "M": "1 month", "Q": "3 months", "Y": "1 year"}
LABEL = {"W": "b + INTERVAL '6 days'", "M": "b + INTERVAL '1 month' - INTERVAL '1 day'",
         "Q": "b + INTERVAL '3 months' - INTERVAL '1 day'", "Y": "b + INTERVAL '1 year' - INTERVAL '1 day'"}
AGG = {"mean": "avg(value)", "sum": "sum(value)", "median": "quantile_cont(value, 0.5)", "min": "min(value)",
       "max": "max(value)", "std": "stddev_samp(value)", "count": "count(value)"}


DIGITS = 7  # a six-digit cut would fall on exact halves of cent averages


def resample_sql(source, freq, agg):
    start = BIN[freq]
    value = "a.v"
    if agg in ("sum", "count"):
        value = "coalesce(a.v, 0)"
    value = f"{value}" if agg == "count" else r(value, DIGITS)
    return f"""WITH s AS ({source}),
 a AS (SELECT CAST({start} AS TIMESTAMP) AS b, {AGG[agg]} AS v FROM s GROUP BY 1),
 g AS (SELECT unnest(generate_series((SELECT min(b) FROM a), (SELECT max(b) FROM a), INTERVAL '{STEP[freq]}')) AS b)
SELECT CAST({LABEL.get(freq, 'b')} AS TIMESTAMP) AS ts, {value} AS value
FROM g LEFT JOIN a USING (b)"""


def _resample_query(source_fn, freq, agg):
    def run(spark, sf):
        return round_all(timeops.resample(source_fn(spark, sf), "ts", freq, agg), DIGITS)

    return run


def _orders(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))


ORDERS_SQL = "SELECT o_orderdate AS ts, o_totalprice AS value FROM orders"
FREQ_WORDS = {"30T": "half_hour", "H": "hour", "D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}

for _f, _word in FREQ_WORDS.items():
    _short = _f in ("30T", "H", "D")
    register(f"resample_{_word}_mean", resample_sql(EVENTS_SQL if _short else ORDERS_SQL, _f, "mean"))(
        _resample_query(_events if _short else _orders, _f, "mean"))
for _a in ("sum", "median", "min", "max", "std", "count"):
    register(f"resample_day_{_a}", resample_sql(EVENTS_SQL, "D", _a))(_resample_query(_events, "D", _a))
register("resample_month_median", resample_sql(ORDERS_SQL, "M", "median"))(_resample_query(_orders, "M", "median"))
register("resample_week_count", resample_sql(ORDERS_SQL, "W", "count"))(_resample_query(_orders, "W", "count"))


@register("parse_day_first_dates", """
SELECT event_id, strptime(strftime(ts, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M') AS ts FROM events""")
def parse_day_first_dates(spark, sf):
    text = load(spark, sf, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm").alias("ts"))
    return timeops.parse_datetime(text, "ts")


@register("parse_month_first_dates", """
SELECT o_orderkey, strptime(strftime(o_orderdate, '%m-%d-%Y'), '%m-%d-%Y') AS o_orderdate FROM orders""")
def parse_month_first_dates(spark, sf):
    text = load(spark, sf, "orders").select("o_orderkey",
                                            F.date_format("o_orderdate", "MM-dd-yyyy").alias("o_orderdate"))
    return timeops.parse_datetime(text, "o_orderdate")


def _dates_query(name, pattern, written, offset=""):
    """Event times written in one layout and read again; ``pattern`` for Spark, ``written`` for the comparison."""
    cut = "second" if "ss" in pattern else "minute" if "mm" in pattern else "day"

    def run(spark, sf):
        text = F.concat(F.date_format("ts", pattern), F.lit(offset))
        return timeops.parse_datetime(load(spark, sf, "events").select("event_id", text.alias("ts")), "ts")

    shift = f" - INTERVAL '{int(offset[1:3]) * 60 + int(offset[4:])} minutes'" if offset else ""
    register(name, f"SELECT event_id, CAST(date_trunc('{cut}', strptime(strftime(ts, '{written}'), '{written}')) AS TIMESTAMP){shift} AS ts "
                   "FROM events")(run)


_dates_query("parse_year_first_dates", "yyyy/MM/dd HH:mm", "%Y/%m/%d %H:%M")
_dates_query("parse_named_month_dates", "dd MMM yyyy", "%d %b %Y")
_dates_query("parse_named_month_first_dates", "MMMM d, yyyy HH:mm:ss", "%B %-d, %Y %H:%M:%S")
_dates_query("parse_compact_dates", "yyyyMMdd", "%Y%m%d")
_dates_query("parse_twelve_hour_dates", "MM/dd/yyyy hh:mm a", "%m/%d/%Y %I:%M %p")
_dates_query("parse_short_year_dates", "MM/dd/yy", "%m/%d/%y")
_dates_query("parse_offset_dates", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "+02:30")


@register("moving_average_5", f"""
SELECT event_id, CASE WHEN count(value) OVER w = 5 THEN {r('avg(value) OVER w')} END AS value FROM (
 SELECT event_id, ts, CASE WHEN value < 2 THEN NULL ELSE value END AS value FROM events)
WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def moving_average_5(spark, sf):
    return round_all(smooth.smooth(_signal(spark, sf), "moving_average", ["ts", "event_id"], 5).drop("ts"))


def _signal(spark, sf):
    """events by time with small values missing."""
    return load(spark, sf, "events").select("event_id", "ts",
                                            F.when(F.col("value") >= 2, F.col("value")).alias("value"))


@register("exponential_smoothing", f"""
WITH s AS (SELECT event_id, ts, CASE WHEN value < 2 THEN NULL ELSE value END AS value FROM events),
 n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS i, value FROM s),
 p AS (SELECT a.event_id, sum(b.value * pow(0.7, a.i - b.i)) / sum(pow(0.7, a.i - b.i)) AS value
  FROM n a JOIN (SELECT * FROM n WHERE value IS NOT NULL) b ON b.i <= a.i AND b.i > a.i - 300 GROUP BY a.event_id)
SELECT n.event_id, {r('p.value')} AS value FROM n LEFT JOIN p USING (event_id)""")
def exponential_smoothing(spark, sf):
    return round_all(smooth.smooth(_signal(spark, sf), "exponential", ["ts", "event_id"], alpha=0.3).drop("ts"))


def savgol_sql(w):
    centre, hat = smooth.savgol_weights(w)
    half = w // 2

    def blend(weights, shift):
        out = []
        for j, weight in enumerate(weights):
            d = j - shift
            fn = f"lag(value, {-d}) OVER o" if d < 0 else (f"lead(value, {d}) OVER o" if d else "value")
            out.append(f"({float(weight)!r}) * {fn}")
        return " + ".join(out)

    cases = "".join(f" WHEN i = {p} THEN {blend(hat[p], p)} WHEN i = n - 1 - {p} THEN {blend(hat[w - 1 - p], w - 1 - p)}"
                    for p in range(half))
    return f"""SELECT event_id, round(value, 5) + 0.0 AS value FROM (SELECT event_id,
 CASE{cases} ELSE {blend(centre, half)} END AS value FROM (
 SELECT event_id, ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
 WINDOW o AS (ORDER BY ts, event_id))"""


@register("savitzky_golay_5", savgol_sql(5))
def savitzky_golay_5(spark, sf):
    df = load(spark, sf, "events").select("event_id", "ts", "value")
    return round_all(smooth.smooth(df, "savgol", ["ts", "event_id"], 5).drop("ts"), 5)


HASH = "md5('42|' || event_id)"
PARTS = f"""SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {HASH}, event_id)
 <= CAST(ceil(count(*) OVER () * CAST(0.3 AS DECIMAL(4, 2))) AS BIGINT) THEN 'test' ELSE 'train' END AS part FROM events"""


@register("train_test_split_rows", PARTS)
def train_test_split_rows(spark, sf):
    train, test = split.train_test_split(load(spark, sf, "events"), ["event_id"], 0.7)
    return (train.select("event_id", F.lit("train").alias("part"))
            .unionByName(test.select("event_id", F.lit("test").alias("part"))))


@register("train_test_split_sizes", f"SELECT part, count(*) AS row_count FROM ({PARTS}) GROUP BY part")
def train_test_split_sizes(spark, sf):
    return train_test_split_rows(spark, sf).groupBy("part").agg(F.count(F.lit(1)).alias("row_count"))


@register("shuffled_positions", f"""
SELECT event_id, row_number() OVER (ORDER BY {HASH}, event_id) - 1 AS idx FROM events""")
def shuffled_positions(spark, sf):
    return split.shuffle(load(spark, sf, "events").select("event_id"), ["event_id"]).withColumnRenamed("__idx", "idx")
