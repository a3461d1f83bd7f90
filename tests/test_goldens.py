"""Goldens from the reference's own tests and docstring examples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitwise.functions import dates as D
from pitwise.operators import clean as C
from pitwise.operators import encode as EN
from pitwise.operators import events as EV
from pitwise.operators import rolling as RO

DAYS = [dt.date(2017, 2, d) for d in range(3, 8)]


def _series(spark, flags):
    return spark.createDataFrame([(d, i + 1, f) for i, (d, f) in enumerate(zip(DAYS, flags))],
                                 "Date date, indicator int, holiday_flg int")


def test_elapsed_golden(spark):
    out = EV.add_elapsed(_series(spark, [0, 1, 0, 0, 1]), "holiday_flg", "Date").orderBy("Date").collect()
    assert [r.indicator for r in out] == [1, 2, 3, 4, 5]  # row order kept
    assert [r.af_holiday_flg for r in out] == [-1, 0, 1, 2, 0]
    assert [r.be_holiday_flg for r in out] == [-1, 0, -2, -1, 0]


def test_duration_golden(spark):
    out = EV.add_duration(_series(spark, [0, 1, 1, 0, 1]), "holiday_flg", "Date").orderBy("Date").collect()
    assert [r.dur_time_holiday_flg for r in out] == [0, 1, 2, 0, 1]
    assert [r.dur_holiday_flg for r in out] == [0, 2, 2, 0, 1]
    assert [r.dur_prog_holiday_flg for r in out] == [0.0, 0.5, 1.0, 0.0, 1.0]


def test_elapsed_partitioned_matches_per_key(spark):
    a = _series(spark, [0, 1, 0, 0, 1]).withColumn("k", F.lit(1))
    b = _series(spark, [1, 0, 0, 1, 0]).withColumn("k", F.lit(2))
    out = EV.add_elapsed(a.unionByName(b), "holiday_flg", "Date", ["k"]).where("k = 2").orderBy("Date").collect()
    assert [r.af_holiday_flg for r in out] == [0, 1, 2, 0, 1]
    assert [r.be_holiday_flg for r in out] == [0, -2, -1, 0, 1]


def test_unique_guard_refuses_repeated_dates(spark):
    ts = 1506787200000
    raw = spark.createDataFrame([(ts, i) for i in range(1, 6)], "Date long, indicator int")
    parts = raw.withColumns(D.epoch_ms_parts("Date")).orderBy("indicator").collect()
    assert [r.indicator for r in parts] == [1, 2, 3, 4, 5]
    assert {(r.Date_year, r.Date_month, r.Date_day, r.Date_hour) for r in parts} == {(2017, 9, 30, 16)}
    with pytest.raises(ValueError):
        EV.assert_unique(raw.withColumn("Date", F.timestamp_millis("Date")), [], "Date")


def test_add_datepart_docstring(spark):
    df = spark.createDataFrame([(dt.date(2000, 3, d),) for d in (11, 12, 13)], "A date")
    out = D.add_datepart(df, "A").orderBy("ADay").collect()
    assert [r.AYear for r in out] == [2000] * 3
    assert [r.AMonth for r in out] == [3] * 3
    assert [r.AWeek for r in out] == [10, 10, 11]
    assert [r.ADay for r in out] == [11, 12, 13]
    assert [r.ADayofweek for r in out] == [5, 6, 0]
    assert [r.ADayofyear for r in out] == [71, 72, 73]
    assert not any(r.AIs_month_end or r.AIs_month_start or r.AIs_quarter_end or r.AIs_quarter_start
                   or r.AIs_year_end or r.AIs_year_start for r in out)
    assert [r.AElapsed for r in out] == [952732800, 952819200, 952905600]


def test_median_fill_docstring(spark):
    df = spark.createDataFrame([(1, 5), (None, 2), (3, 2)], "col1 int, col2 int") \
        .withColumn("i", F.monotonically_increasing_id())
    med = C.fit_medians(df, ["col1"])
    out = C.apply_median_fill(df, med, ["col1"]).orderBy("i").collect()
    assert [r.col1 for r in out] == [1.0, 2.0, 3.0]
    assert [r.col1_na for r in out] == [False, True, False]
    forced = spark.createDataFrame([(500.0,)], "col1 double")
    out2 = C.apply_median_fill(df, forced, ["col1"]).orderBy("i").collect()
    assert [r.col1 for r in out2] == [1.0, 500.0, 3.0]


def test_category_codes_docstring(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "col1 int, col2 string")
    d = EN.fit_dictionary(df, "col2")
    out = EN.apply_category_codes(df, d, "col2").orderBy("col1").collect()
    assert [r.col2 for r in out] == [1, 2, 1]
    unseen = spark.createDataFrame([(4, "z"), (5, None)], "col1 int, col2 string")
    assert [r.col2 for r in EN.apply_category_codes(unseen, d, "col2").orderBy("col1").collect()] == [0, 0]


def test_label_encoding_unseen_raises(spark):
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    d = EN.fit_dictionary(df, "c")
    with pytest.raises(Exception):
        EN.apply_label_encoding(spark.createDataFrame([("q",)], "c string"), d, "c").collect()


def test_rolling_then_shift_on_gaps(spark):
    base = dt.date(2020, 1, 1)
    rows = [(1, base + dt.timedelta(days=d), float(v)) for d, v in zip([0, 1, 5, 6], [1, 2, 4, 9])]
    df = spark.createDataFrame(rows, "store_id int, visit_date date, visitors double")
    out = RO.rolling_stats(df, ["store_id"], "5d").orderBy("visit_date").collect()
    assert [r.rolling_store_id_5d_median for r in out] == [None, 1.0, 1.5, 3.0]
    assert [r.rolling_store_id_5d_cnt for r in out] == [None, 1.0, 2.0, 2.0]
