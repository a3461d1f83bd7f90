"""Date expression factories: O91-O98."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The outputs of add_datepart, in order.
DATEPART_FIELDS = ("Year", "Month", "Week", "Day", "Dayofweek", "Dayofyear", "Is_month_end",
                   "Is_month_start", "Is_quarter_end", "Is_quarter_start", "Is_year_end",
                   "Is_year_start", "Elapsed")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def datepart_columns(col: str, prefix: str | None = None) -> dict[str, Column]:
    """13 calendar attributes; prefix = name without a trailing 'date'/'Date'."""
    pre = re.sub("[Dd]ate$", "", col) if prefix is None else prefix
    ts = F.col(col).cast("timestamp")
    d = F.to_date(ts)
    q_start = F.make_date(F.year(d), (F.quarter(d) - 1) * 3 + 1, F.lit(1))
    q_end = F.last_day(F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1)))
    out = {
        "Year": F.year(d), "Month": F.month(d), "Week": F.weekofyear(d), "Day": F.dayofmonth(d),
        "Dayofweek": F.weekday(d), "Dayofyear": F.dayofyear(d),
        "Is_month_end": d == F.last_day(d), "Is_month_start": F.dayofmonth(d) == 1,
        "Is_quarter_end": d == q_end, "Is_quarter_start": d == q_start,
        "Is_year_end": (F.month(d) == 12) & (F.dayofmonth(d) == 31),
        "Is_year_start": F.dayofyear(d) == 1,
        "Elapsed": F.unix_seconds(ts),
    }
    return {pre + k: out[k] for k in DATEPART_FIELDS}


def add_datepart(df: DataFrame, col: str, drop: bool = True) -> DataFrame:
    out = df.withColumns(datepart_columns(col))
    return out.drop(col) if drop else out


def epoch_ms_parts(col: str) -> dict[str, Column]:
    """Epoch milliseconds -> timestamp and its year, month, week, day, hour."""
    ts = F.timestamp_millis(F.col(col))
    return {col: ts, f"{col}_year": F.year(ts), f"{col}_month": F.month(ts),
            f"{col}_week": F.weekofyear(ts), f"{col}_day": F.dayofmonth(ts), f"{col}_hour": F.hour(ts)}


def date_info_columns(col: str, with_day: bool = False) -> dict[str, Column]:
    """Week, day of week (Mon=0), year, month (+ day of month)."""
    d = F.col(col)
    out = {f"{col}_week": F.weekofyear(d), f"{col}_dayofweek": F.weekday(d),
           f"{col}_year": F.year(d), f"{col}_month": F.month(d)}
    if with_day:
        out[f"{col}_day"] = F.dayofmonth(d)
    return out


def date_add_days(d, days) -> Column:
    """O94 date_add_days on dates or 'YYYY-MM-DD...' strings."""
    return F.date_add(F.to_date(F.substring(_c(d).cast("string"), 1, 10)), days)


def diff_of_days(d1, d2) -> Column:
    """O94 diff_of_days(day1, day2) = day1 - day2 in days."""
    return F.datediff(F.to_date(F.substring(_c(d1).cast("string"), 1, 10)),
                      F.to_date(F.substring(_c(d2).cast("string"), 1, 10)))


def compose_timestamp(year, month=None, day=None, hour=None, minute=None, second=None) -> Column:
    """Parts -> timestamp (missing parts default to 1 / 0)."""
    one, zero = F.lit(1), F.lit(0)
    return F.make_timestamp(_c(year), _c(month) if month is not None else one,
                            _c(day) if day is not None else one,
                            _c(hour) if hour is not None else zero,
                            _c(minute) if minute is not None else zero,
                            _c(second) if second is not None else zero)


def weekend_or_holiday(d, flag) -> Column:
    """O96 holiday_flg2: Saturday/Sunday or flagged."""
    return ((F.weekday(_c(d)) > 4) | (_c(flag) == 1)).cast("int")


def demote_weekend_holiday(d, flag) -> Column:
    """A holiday falling on Saturday/Sunday is not counted as one."""
    return F.when(F.weekday(_c(d)) > 4, F.lit(0)).otherwise(_c(flag))


def date_int(d) -> Column:
    """yyyyMMdd as int."""
    return F.date_format(_c(d), "yyyyMMdd").cast("int")


def calendar(spark, start: str, end: str, col: str = "visit_date") -> DataFrame:
    """One row per day of [start, end] (a calendar: bounded by its span)."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(col))
