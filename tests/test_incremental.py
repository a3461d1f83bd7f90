"""Incremental window builds equal the full build and leave the folders of untouched pivots alone."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from pitwise.plans import incremental, pit

CAL = "explode(sequence(date'2020-01-01', date'2020-12-31')) AS visit_date"


def calendar(spark):
    return spark.sql(f"SELECT {CAL}").select("visit_date", (F.weekday("visit_date") >= 5).cast("int").alias("holiday_flg"),
                                             F.lit(0).alias("holiday_flg2"))


def visits(spark, last):
    """Twelve stores on most days up to `last`."""
    d = spark.sql(f"SELECT {CAL}").where(F.col("visit_date") <= F.lit(last)).join(spark.range(12).withColumnRenamed("id", "store_id"), how="cross")
    h = F.pmod(F.xxhash64("visit_date", "store_id"), F.lit(97))
    d = d.where(h > 20).select("store_id", "visit_date", h.alias("visitors"))
    stores = spark.range(12).select(F.col("id").alias("store_id"), F.concat(F.lit("g"), F.col("id") % 3).alias("air_genre_name"), F.lit("a").alias("air_area_name"))
    return pit.pit_data(d, stores, calendar(spark))


def context(spark, data, pivot, end):
    return pit.make_context(data, pivot, end, 7, 14, 37, calendar=calendar(spark))


def rows(df):
    """Sorted rows; sums over series that begin earlier or later differ in their last digits."""
    return sorted(tuple(round(x, 8) + 0.0 if isinstance(x, float) else str(x) for x in r) for r in df.select("end_date", "store_id", "visit_date", *sorted(
        set(df.columns) - {"end_date", "store_id", "visit_date"})).collect())


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/end_date=*/*.parquet")}


def pivots(df):
    return {r[0] for r in df.collect()}


def test_new_weeks_build_only_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "set")
    first = context(spark, visits(spark, "2020-05-01"), "2020-04-10", "2020-05-02")
    assert pivots(incremental.update(first, path)) == set(first.pivots)
    assert rows(incremental.read(spark, path)) == rows(pit.training_set(first))
    old = files(path)

    later = context(spark, visits(spark, "2020-05-15"), "2020-04-24", "2020-05-16")
    done = pivots(incremental.update(later, path))
    assert rows(incremental.read(spark, path)) == rows(pit.training_set(later))
    kept = set(later.pivots) - done
    # the weekly grid reaches 10 April only now; 17 April had all its label days already; 24 April is no pivot any more
    assert done == {dt.date(2020, 4, 10), dt.date(2020, 5, 1), dt.date(2020, 5, 8), dt.date(2020, 5, 15)}
    new = files(path)
    assert all(new.get(f) == t for f, t in old.items() if any(str(p) in f for p in kept))

    before = files(path)
    assert pivots(incremental.update(later, path)) == set() and files(path) == before

    # a correction of one day: all pivots whose label window reaches it, none before
    day = dt.date(2020, 4, 1)
    changed = later.data.withColumn("visitors", F.when(F.col("visit_date") == F.lit(day), 9.0).otherwise(F.col("visitors")))
    again = context(spark, changed, "2020-04-24", "2020-05-16")
    done = pivots(incremental.update(again, path, since=day))
    assert done == {r[0] for r in again.windows.where(F.date_add("end_date", F.col("days_in_label")) > F.lit(day)).select("end_date").collect()}
    assert rows(incremental.read(spark, path)) == rows(pit.training_set(again))

    # label rows that go away, and no data at all
    gone = context(spark, later.data.where(~F.col("visit_date").between("2020-04-20", "2020-05-20")), "2020-04-24", "2020-05-16")
    incremental.update(gone, path, since=day)
    assert rows(incremental.read(spark, path)) == rows(pit.training_set(gone))


def test_empty_data(spark, tmp_path):
    path = str(tmp_path / "none")
    none = context(spark, visits(spark, "2019-01-01"), "2020-04-10", "2020-05-02")
    incremental.update(none, path)
    assert incremental.read(spark, path).count() == 0 and "store_mean56" in incremental.read(spark, path).columns
