import itertools

import numpy as np
import pandas as pd
import pytest

from tabreg.operators import timeops

PANDAS = {"30T": "30min", "H": "h", "D": "D", "W": "W", "M": "ME", "Q": "QE", "Y": "YE"}


def frame():
    ts = pd.to_datetime(["2023-12-31 23:59", "2024-01-01 00:00", "2024-02-29 12:00", "2024-02-29 12:10", "2024-03-03 10:00",
                         "2024-03-31 23:59:59", "2024-07-01 00:00", "2024-07-01 00:29", "2025-01-05 01:00"], format="mixed")
    return pd.DataFrame({"ts": ts, "x": [1.0, 2.5, np.nan, 4.0, 8.0, 3.0, 7.0, 1.0, 2.0], "n": range(9)})


@pytest.mark.parametrize("freq,agg", list(itertools.product(timeops.FREQUENCIES, timeops.AGGREGATES)))
def test_every_combination_matches_pandas(spark, freq, agg):
    pdf = frame()
    rows = [(t.to_pydatetime(), None if x != x else x, n) for t, x, n in pdf.itertuples(index=False)] + [(None, 5.0, 1)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, x double, n long").repartition(3)
    got = timeops.resample(df, "ts", freq, agg).toPandas().sort_values("ts").reset_index(drop=True)
    want = pdf.set_index("ts").resample(PANDAS[freq]).agg(agg).reset_index()
    assert got["ts"].tolist() == want["ts"].tolist()
    for c in ("x", "n"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-12)


def test_text_columns(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-03 00:00:00", "b")], "ts string, s string")
    df = timeops.parse_datetime(df, "ts")
    assert [r["s"] for r in timeops.resample(df, "ts", "D", "count").orderBy("ts").collect()] == [1, 0, 1]
    with pytest.raises(ValueError):
        timeops.resample(df, "ts", "D", "mean")
    with pytest.raises(ValueError):
        timeops.resample(df, "ts", "fortnight", "count")


@pytest.mark.parametrize("cells,layout,first", [
    (["01/02/2024", "03/04/2024"], "M/d/yyyy", "2024-01-02"),
    (["01/02/2024", "13/02/2024"], "d/M/yyyy", "2024-02-01"),
    (["2024-02-01T10:00:00", "2024-03-01"], "ISO", "2024-02-01 10:00"),
    (["13.02.2024 07:05", "01.02.2024 00:00"], "d.M.yyyy H:mm", "2024-02-13 07:05"),
    (["01-31-2024 07:05:09", None], "M-d-yyyy H:mm:ss", "2024-01-31 07:05:09"),
    (["2024-05-06", "13/02/2024"], "mixed", "2024-05-06"),
])
def test_layout_detection(spark, cells, layout, first):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, d string")
    assert timeops.detect_date_layout(df, "d") == layout
    assert timeops.parse_datetime(df, "d").orderBy("i").first()["d"] == pd.Timestamp(first).to_pydatetime()


def test_unreadable_dates_are_listed(spark):
    with pytest.raises(ValueError, match="soon"):
        timeops.parse_datetime(spark.createDataFrame([("2024-01-01",), ("soon",)], "d string"), "d")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_layouts_in_any_session_zone(spark, zone):
    given = [("2024/01/31", "2024-01-31"), ("31 Jan 2024", "2024-01-31"), ("Jan 31, 2024", "2024-01-31"), ("20240131", "2024-01-31"),
             ("01/31/24", "2024-01-31"), ("01/31/2024 02:30 PM", "2024-01-31 14:30"), ("2024-01-31T10:00+02:00", "2024-01-31 08:00"),
             ("2024-03-10 02:30", "2024-03-10 02:30"), ("03/10/2024 02:30", "2024-03-10 02:30"), ("12/31/1999 12:05 am", "1999-12-31 00:05"),
             ("1 september 1999", "1999-09-01"), ("01/31/70", "1970-01-31")]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for text, want in given:
            df = timeops.parse_datetime(spark.createDataFrame([(text,), (None,)], "t string"), "t")
            got = [r["t"] for r in df.selectExpr("cast(t as string) t").collect()]
            assert sorted(got, key=str) == sorted([str(pd.Timestamp(want)), None], key=str), text
        for text in ("32 Jan 2024", "2024/13/01", "13/13/2024", "31 Jax 2024", "20240132"):
            with pytest.raises(ValueError):
                timeops.parse_datetime(spark.createDataFrame([(text,)], "t string"), "t")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
