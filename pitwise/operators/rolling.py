"""Rolling statistics on irregular daily series: O67-O69, O77, O78.

A period of N days is the time frame (t - N days, t] over the per-day mean,
followed by a one-*row* shift.  Series run in parallel; a task takes whole
series from its sorted rows and finds each frame's ends by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from .sliding import nullable, present, whole_series

# The reference's rolling periods and statistic names (in order).
PERIODS = ("30d", "45d", "50d", "60d", "90d", "120d", "180d", "360d", "720d")
ROLL_STATS = ("max", "min", "median", "std", "cnt", "mean", "skew")


ROWS = 2_000  #: of the wide result per Arrow batch
_SPAN = 1 << 40  # days of a series lie well within; places of a lot are ordered by series * _SPAN + day


def day_number(d) -> Column:
    return F.datediff(F.col(d) if isinstance(d, str) else d, F.lit("1970-01-01").cast("date"))


def rolling_name(keys: list[str], period: str, stat: str) -> str:
    return f"rolling_{'_'.join(keys)}_{period}_{stat}"


def _frames(keys: list[str], date_col: str, days: list[int], stats, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, series in whole_series(batches, keys):
            if not len(series):
                continue
            # a row without a date sorts first and is a frame of its own
            day = t["__day"].combine_chunks().cast(pa.int64()).fill_null(-_SPAN // 4).to_numpy()
            place = series.astype(np.int64) * _SPAN + day
            ranges, before = present(t, "__v", series)
            first = np.append(True, series[1:] != series[:-1])
            columns = [t[c].combine_chunks() for c in (*keys, date_col)]
            for n in days:
                lo, hi = np.searchsorted(place, place - (n - 1)), np.arange(1, len(place) + 1)
                found = ranges.summary(before[lo], before[hi])
                for s in stats:
                    x = found["count" if s == "cnt" else s].astype(float)
                    x = np.append(np.nan, x[:-1])  # the row before; a series' first row has none
                    x[first] = np.nan
                    columns.append(nullable(x))
            whole = pa.Table.from_arrays(columns, names=names)
            yield from whole.to_batches(max_chunksize=ROWS)
    return run


def rolling_stats(df: DataFrame, keys: list[str], periods=PERIODS, value: str = "visitors",
                  date_col: str = "visit_date", stats=ROLL_STATS) -> DataFrame:
    """Per (keys, date): rolling statistics of the daily mean of `value` over every period, shifted by one row.

    The daily means are shuffled and sorted once by series; every frame is a range of a series' rows, whose statistics cost
    the logarithm of its length (operators.sliding), so long periods are as cheap as short ones.  A null key is a series of its own;
    null values count nowhere, and a frame of nulls alone has count 0 and no other statistic."""
    periods = (periods,) if isinstance(periods, str) else tuple(periods)
    daily = df.groupBy(*keys, date_col).agg(F.avg(F.col(value).cast("double")).alias("__v"))
    daily = daily.withColumn("__day", day_number(date_col)).repartition(*keys).sortWithinPartitions(*keys, "__day")
    names = [rolling_name(keys, p, s) for p in periods for s in stats]
    schema = StructType([*(daily.schema[c] for c in (*keys, date_col)), *(StructField(n, DoubleType()) for n in names)])
    return daily.mapInArrow(_frames(keys, date_col, [int(p.rstrip("d")) for p in periods], tuple(stats), schema.names), schema)


def rolling_assembly(dataset: DataFrame, key_sets: list[list[str]], periods=PERIODS, value: str = "visitors",
                     date_col: str = "visit_date") -> DataFrame:
    """The rolling tables of all key sets joined back to every row of the dataset (left joins on keys + date)."""
    out = dataset
    for keys in key_sets:
        out = out.join(rolling_stats(dataset, keys, periods, value, date_col), [*keys, date_col], "left")
    return out


def add_lag_diff(df: DataFrame, keys: list[str], date_col: str, value: str) -> DataFrame:
    """Previous value and difference to it."""
    w = Window.partitionBy(*keys).orderBy(date_col)
    prev = F.lag(value, 1).over(w)
    return df.withColumns({f"{value}_prev": prev, f"{value}_diff": F.col(value) - prev})


def calendar_position_weight(cal: DataFrame, date_col: str, power: int = 5) -> DataFrame:
    """O77 (+O58 weight): ((row index + 1) / n) ** power over a calendar (calendar-sized window)."""
    w = Window.orderBy(date_col)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return cal.withColumn("weight", F.pow(F.row_number().over(w) / n, power))


def max_minus(df: DataFrame, cols: list[str], prefix: str = "var_max_") -> DataFrame:
    """Global maximum minus the value (scalar aggregate broadcast to every row)."""
    return df.withColumns({f"{prefix}{c}": df.agg(F.max(c)).scalar() - F.col(c) for c in cols})
