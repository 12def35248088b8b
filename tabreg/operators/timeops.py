"""Date parsing and time-bin resampling."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabreg.functions.columns import clean_double, is_numeric, q
from tabreg.operators.quantiles import group_quantiles

# Accepted date layouts, in the order in which they are tried.
ISO_SHAPE = r"^(\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?)(?:Z|([+-])(\d{2}):?(\d{2}))?$"
YEAR_FIRST = ("yyyy/M/d H:mm", "yyyy/M/d H:mm:ss", "yyyy/M/d", "yyyy.M.d H:mm", "yyyy.M.d H:mm:ss", "yyyy.M.d")
MONTH_FIRST = ("M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M-d-yyyy H:mm", "M-d-yyyy H:mm:ss",
               "M.d.yyyy H:mm", "M.d.yyyy H:mm:ss", "M/d/yyyy", "M-d-yyyy", "M.d.yyyy",
               "M/d/yyyy h:mm a", "M/d/yyyy h:mm:ss a")
DAY_FIRST = ("d/M/yyyy H:mm", "d/M/yyyy H:mm:ss", "d-M-yyyy H:mm", "d-M-yyyy H:mm:ss",
             "d.M.yyyy H:mm", "d.M.yyyy H:mm:ss", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy",
             "d/M/yyyy h:mm a", "d/M/yyyy h:mm:ss a")
NAMED_MONTH = ("d MMM yyyy", "d MMM yyyy H:mm", "d MMM yyyy H:mm:ss", "d-MMM-yyyy", "MMM d, yyyy", "MMM d, yyyy H:mm",
               "MMM d, yyyy H:mm:ss", "MMM d, yyyy h:mm a", "MMM d yyyy")
COMPACT = ("yyyyMMdd", "yyyyMMddHHmm", "yyyyMMddHHmmss")
SHORT_YEAR = ("M/d/yy", "M/d/yy H:mm", "M-d-yy", "d/M/yy", "d/M/yy H:mm", "d-M-yy", "d.M.yy")
LAYOUTS = (*YEAR_FIRST, *MONTH_FIRST, *DAY_FIRST, *NAMED_MONTH, *COMPACT, *SHORT_YEAR)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

FREQUENCIES = ("30T", "H", "D", "W", "M", "Q", "Y")
AGGREGATES = ("mean", "sum", "median", "min", "max", "std", "count")
_TUMBLING = {"30T": "30 minutes", "H": "1 hour", "D": "1 day"}
_CALENDAR = {"W": "week", "M": "month", "Q": "quarter", "Y": "year"}
_STEP = {"30T": "INTERVAL 30 MINUTES", "H": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS",
         "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTHS", "Y": "INTERVAL 1 YEAR"}


_PARTS = {"yyyy": r"(\d{4})", "yy": r"(\d{2})", "MMM": "((?i)" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + ")", "MM": r"(\d{2})",
          "M": r"(\d{1,2})", "dd": r"(\d{2})", "d": r"(\d{1,2})", "HH": r"(\d{2})", "H": r"(\d{1,2})", "h": r"(1[0-2]|0?[1-9])",
          "mm": r"(\d{2})", "ss": r"(\d{2})", "a": "((?i)[ap]m)"}
_TOKENS = re.compile("|".join([*sorted(_PARTS, key=len, reverse=True), "[^A-Za-z]"]))


def layout_shape(layout: str) -> str:
    """Text shape of a layout, one group per part."""
    return "^" + "".join(_PARTS.get(t) or re.escape(t) for t in _TOKENS.findall(layout)) + "$"


def _read_layout(text: Column, layout: str) -> Column:
    """Clock time by the layout's own parts: no session time zone takes part, and what is no date is NULL."""
    shape = layout_shape(layout)
    found = {t: F.regexp_extract(text, shape, i) for i, t in enumerate((t for t in _TOKENS.findall(layout) if t in _PARTS), 1)}

    def part(*names: str) -> Column:
        return next((found[n] for n in names if n in found), F.lit("00"))

    year = found.get("yyyy")
    if year is None:  # 69 to 99 belong to the last century
        year = F.concat(F.when(found["yy"] >= "69", "19").otherwise("20"), found["yy"])
    month = part("MM", "M")
    if "MMM" in found:
        names = F.lit("".join(m[:3] for m in MONTHS))
        month = ((F.position(F.lower(F.substring(found["MMM"], 1, 3)), names) + 2) / 3).cast("int").cast("string")
    hour = part("HH", "H")
    if "h" in found:
        hour = (found["h"].try_cast("int") % 12 + F.when(F.lower(found["a"]) == "pm", 12).otherwise(0)).cast("string")
    iso = F.concat(year, F.lit("-"), month, F.lit("-"), part("dd", "d"), F.lit(" "), hour, F.lit(":"), part("mm"), F.lit(":"), part("ss"))
    return F.when(text.rlike(shape), iso).try_cast("timestamp_ntz")


def _read_iso(text: Column) -> Column:
    """ISO clock time; an offset is applied, so that the result is UTC."""
    sign, hours, minutes = (F.regexp_extract(text, ISO_SHAPE, k) for k in (2, 3, 4))
    away = (hours.try_cast("int") * 60 + minutes.try_cast("int")) * F.when(sign == "-", -1).otherwise(1)
    clock = F.when(text.rlike(ISO_SHAPE), F.regexp_extract(text, ISO_SHAPE, 1)).try_cast("timestamp_ntz")
    return F.when(sign == "", clock).otherwise(clock - F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(away, F.lit(0))))


def date_candidates(text: Column, layouts: Sequence[str]) -> list[tuple[str, Column]]:
    """(layout name, parsed column) in trial order; an unreadable cell parses to NULL."""
    trimmed = F.trim(text)
    return [(name, _read_iso(trimmed) if name == "ISO" else _read_layout(trimmed, name)) for name in ("ISO", *LAYOUTS) if name in layouts]


def _seen_layouts(df: DataFrame, col: str) -> list[str]:
    """Layouts whose shape occurs in the column; only these are worth parsing."""
    trimmed = F.trim(q(col))
    shapes = {"ISO": ISO_SHAPE, **{name: layout_shape(name) for name in LAYOUTS}}
    by_shape = {shape: f"s{i}" for i, shape in enumerate(dict.fromkeys(shapes.values()))}  # day first and month first look alike
    found = df.agg(*[F.max(trimmed.rlike(shape)).alias(c) for shape, c in by_shape.items()]).first()
    return [name for name, shape in shapes.items() if found[by_shape[shape]]]


def _choose_layout(df: DataFrame, col: str) -> tuple[str, dict[str, Column]]:
    parsed = date_candidates(q(col), _seen_layouts(df, col))
    present = q(col).isNotNull()
    any_layout = F.coalesce(*[p for _, p in parsed], F.lit(None).cast("timestamp_ntz"))
    fails = [F.sum((present & p.isNull()).cast("long")).alias(f"f{i}") for i, (_, p) in enumerate(parsed)]
    row = df.agg(*fails, F.sum((present & any_layout.isNull()).cast("long")).alias("mixed")).first()
    for i, (name, _) in enumerate(parsed):
        if not row[f"f{i}"]:
            return name, dict(parsed)
    if not row["mixed"]:
        return ("mixed" if parsed else "ISO"), dict(parsed) or dict(date_candidates(q(col), ["ISO"]))
    sample = [r[0] for r in df.where(present & any_layout.isNull()).select(q(col)).limit(10).collect()]
    raise ValueError(f"no date layout reads column {col!r}; unreadable values: {sample}")


def detect_date_layout(df: DataFrame, col: str) -> str:
    """First layout that reads the whole column, or 'mixed' when only a per-cell choice does."""
    return _choose_layout(df, col)[0]


def parse_datetime(df: DataFrame, col: str) -> DataFrame:
    """Replace a text column by timestamps, with one layout for the whole column."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return df.withColumn(col, q(col).cast("timestamp_ntz"))
    layout, parsed = _choose_layout(df, col)
    value = F.coalesce(*parsed.values()) if layout == "mixed" else parsed[layout]
    return df.withColumn(col, value)


def bin_start(ts: Column, freq: str) -> Column:
    if freq in _TUMBLING:
        return F.window(ts, _TUMBLING[freq]).getField("start").cast("timestamp_ntz")
    return F.trunc(ts.cast("date"), _CALENDAR[freq]).cast("timestamp_ntz")


def bin_label(start: Column, freq: str) -> Column:
    """Bin start below a week; closing day of the period from a week up."""
    if freq in _TUMBLING:
        return start
    day = start.cast("date")
    last = {"W": F.date_add(day, 6), "M": F.last_day(day), "Q": F.last_day(F.add_months(day, 2)),
            "Y": F.last_day(F.add_months(day, 11))}[freq]
    return last.cast("timestamp_ntz")


def _aggregate(name: str, col: str, dtype: T.DataType) -> Column:
    x = clean_double(col) if is_numeric(dtype) else q(col)
    if name == "count":
        return F.count(x)
    if name in ("min", "max"):
        return (F.min if name == "min" else F.max)(x)
    return {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp}[name](x)


def resample(df: DataFrame, ts: str, freq: str, agg: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Aggregate every other column over calendar bins; empty bins appear with NULL (sum and count: 0).

    Rows are combined map-side per bin, so one crowded bin is no hot task.
    """
    if freq not in FREQUENCIES or agg not in AGGREGATES:
        raise ValueError(f"freq must be one of {FREQUENCIES}, agg one of {AGGREGATES}")
    cols = [c for c in (cols or df.columns) if c != ts]
    text = [c for c in cols if not is_numeric(df.schema[c].dataType)]
    if text and agg not in ("count", "min", "max"):
        raise ValueError(f"{agg} needs numeric columns; leave out {text}")
    start = F.col("__start")
    rows = df.where(q(ts).isNotNull()).select(bin_start(q(ts), freq).alias("__start"), *[q(c) for c in cols])
    if agg == "median":
        binned = group_quantiles(rows, ["__start"], cols, 0.5)
    else:
        binned = rows.groupBy("__start").agg(*[_aggregate(agg, c, df.schema[c].dataType).alias(c) for c in cols])
    span = (df.agg(F.min(q(ts)).alias("a"), F.max(q(ts)).alias("b")).where(F.col("a").isNotNull())
            .select(bin_start(F.col("a"), freq).alias("a"), F.col("b")))
    last = span.select("a", bin_start(F.col("b"), freq).alias("b"))
    bins = last.select(F.explode(F.sequence("a", "b", F.expr(_STEP[freq]))).alias("__start"))
    zero = agg in ("sum", "count")
    cells = [(F.coalesce(q(c), F.lit(0)) if zero else q(c)).alias(c) for c in cols]
    return bins.join(binned, "__start", "left").select(bin_label(start, freq).alias(ts), *cells)
