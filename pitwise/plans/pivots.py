"""Features of (pivot, series) pairs over sorted series: O39-O41, O44-O46, O48-O50.

The daily rows are shuffled once, by store.  A task takes whole series (a store, a store's weekday, ...) from its sorted
stream and forms the windows of all pivots as ranges of places, so a visit is never copied once per pivot that sees it:
rows grow with the (pivot, series) pairs of the result alone.  Statistics of the ranges come from operators.sliding; decayed sums
from one running sum per series, S(i) = S(i-1) * rate^gap + x(i), whose values at a window's two ends give the sum between.

Features are plain tuples: ("summary", prefix, horizons), ("decay", horizon, ((mean, weights, mean2, rate, rate2), ...)) with
names or None, ("first_last", horizon), ("diff", horizons), ("profile", horizon) for a store's weekdays side by side."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import stats as S
from ..operators.sliding import WINDOWS, Ranges, nullable, present, series_codes, whole_series

_EPOCH = np.datetime64("1970-01-01")
LABELS = 1 << 13  #: label rows, with all their features, that leave a task at a time
_SERIES, _SHIFT = 1 << 32, 1 << 31  # places of a lot are ordered by series * _SERIES + day + _SHIFT


def feature_columns(features) -> list[tuple[str, type]]:
    """Names and types of the features, in order."""
    out = []
    for kind, *spec in features:
        if kind == "summary":
            prefix, horizons = spec
            out += [(f"{prefix}_{s}{n}", LongType if s == "count" else DoubleType) for n in horizons for s in S.SUMMARY7]
        elif kind == "decay":
            out += [(name, DoubleType) for *names, _, _ in spec[1] for name in names if name]
        elif kind == "first_last":
            out += [("first_time", IntegerType), ("last_time", IntegerType)]
        elif kind == "profile":
            out += [c for i in range(7) for c in (*((f"{i}store_dow_{s}{spec[0]}", DoubleType) for s in ("mean", "median", "sum")),
                                                  (f"{i}store_dow_count{spec[0]}", LongType), (f"{i}dow", IntegerType))]
        else:
            out += [(f"store_diff_{s}{n}", DoubleType) for n in spec[0] for s in ("mean", "std", "max", "min")]
    return out


def longest(features) -> int:
    """The longest horizon: a pair exists if a row lies within it."""
    return max(max(spec[1]) if kind == "summary" else max(spec[0]) if kind == "diff" else spec[0] for kind, *spec in features)


class Lot:
    """Whole series with what their features need."""

    def __init__(self, t: pa.Table, series: np.ndarray):
        self.t, self.series = t, series
        self.days = t["visit_date"].combine_chunks().cast(pa.int32()).to_numpy().astype(np.int64)
        self.place = series.astype(np.int64) * _SERIES + self.days + _SHIFT
        self.first = np.searchsorted(series, np.arange(series[-1] + 1))
        self.visitors, self.before = present(t, "visitors", series)
        self._running: dict[tuple, np.ndarray] = {}  # goes with the lot

    def below(self, series: np.ndarray, day: np.ndarray) -> np.ndarray:
        """The first place of a series at or after a day."""
        return np.searchsorted(self.place, series * _SERIES + day + _SHIFT)

    def running(self, column: str | None, rate: float) -> np.ndarray:
        """For each row the sum of the column (None: 1 where there are visitors) over its series so far, each weighed by
        rate ** days since; steps run over places in the series, each for all series at once."""
        if (column, rate) in self._running:
            return self._running[column, rate]
        v = self.t["visitors"].combine_chunks().cast(pa.float64())
        out = (v.fill_null(0.0).to_numpy() if column else v.is_valid().to_numpy(zero_copy_only=False)).astype(float)
        size = np.diff(np.append(self.first, len(out)))
        for step in range(1, int(size.max())):
            at = self.first[size > step] + step
            out[at] += out[at - 1] * rate ** (self.days[at] - self.days[at - 1])
        self._running[column, rate] = out
        return out

    @cached_property
    def weekdays(self) -> tuple[np.ndarray, Ranges, np.ndarray]:
        """The rows with a weekday, by series, weekday and day: their places, the ranges over their visitors, and the number of
        visitors before each place.  Series s has its weekday i as series 7 * s + i."""
        dow = self.t["dow"].combine_chunks().cast(pa.int64()).fill_null(-1).to_numpy()
        known = np.flatnonzero((dow >= 0) & (dow < 7))
        week = self.series[known] * 7 + dow[known]
        order = np.argsort(week, kind="stable")
        places = (week * _SERIES + self.days[known] + _SHIFT)[order]
        return places, *present(self.t.select(["visitors"]).take(pa.array(known[order])), "visitors", week[order])

    @cached_property
    def diffs(self) -> tuple[Ranges, Ranges, np.ndarray]:
        """Ranges over the differences and over their sizes, and the number of differences before each place."""
        diffs, before = present(self.t, "diff", self.series)
        return diffs, Ranges(np.abs(diffs.values), self.series[np.flatnonzero(np.diff(before))]), before


def _summary(lot: Lot, s, pivot, hi, prefix, horizons):
    for n in horizons:
        found = lot.visitors.summary(lot.before[lot.below(s, pivot - n + 1)], lot.before[hi])
        yield from (found[name] for name in S.SUMMARY7)


def _decay(lot: Lot, s, pivot, hi, horizon, rates):
    lo = lot.below(s, pivot - horizon + 1)
    some = np.flatnonzero(lot.before[hi] > lot.before[lo])
    last, before = hi[some] - 1, lo[some] - 1
    age = pivot[some] - lot.days[last]
    cut = np.flatnonzero(lo[some] > lot.first[s[some]])  # windows that begin behind their series' first row
    cut_age = pivot[some][cut] - lot.days[before[cut]]
    ages = np.arange(max(int(age.max(initial=0)), int(cut_age.max(initial=0))) + 1)

    def total(column, rate):
        """Sums over the windows: the running sum at the last row less that before the first, both aged to the pivot."""
        run, weight = lot.running(column, rate), rate ** ages
        out = run[last] * weight[age]
        out[cut] -= run[before[cut]] * weight[cut_age]
        return out

    for mean, weights, mean2, rate, rate2 in rates:
        w = total(None, rate)
        for name, value in ((mean, lambda: total("visitors", rate) / w), (weights, lambda: w), (mean2, lambda: total("visitors", rate2) / w)):
            if name:
                out = np.full(len(hi), np.nan)
                out[some] = value()
                yield out


def _first_last(lot: Lot, s, pivot, hi, horizon):
    lo = lot.below(s, pivot - horizon + 1)
    for at in (lo, hi - 1):
        ages = pivot - lot.days[np.minimum(at, len(lot.days) - 1)]
        yield pa.array(ages.astype(np.int32), mask=lo == hi)


def _diff(lot: Lot, s, pivot, hi, horizons):
    diffs, sizes, before = lot.diffs
    for n in horizons:
        lo = np.minimum(lot.below(s, pivot - n + 1) + 1, hi)  # the first row's predecessor lies outside the window
        a, b = before[lo], before[hi]
        found = diffs.summary(a, b)
        mean = np.full(len(a), np.nan)
        some = np.flatnonzero(b > a)
        mean[some] = sizes.moments(a[some], b[some])[0]
        yield from (mean, found["std"], found["max"], found["min"])


def _profile(lot: Lot, s, pivot, hi, horizon):
    places, visitors, before = lot.weekdays
    for i in range(7):
        at = (s * 7 + i) * _SERIES + _SHIFT
        lo, end = (before[np.searchsorted(places, at + day)] for day in (pivot - horizon + 1, pivot))
        found = visitors.summary(lo, end)
        yield from (found["mean"], found["median"], found["max"], found["count"])
        yield pa.array(np.full(len(s), i, np.int32), mask=end == lo)


_KINDS = {"summary": _summary, "profile": _profile, "decay": _decay, "first_last": _first_last, "diff": _diff}


def _windows(keys: list[str], features, pivots: np.ndarray, names: list[str], label_days: np.ndarray | None):
    reach = longest(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, series in whole_series(batches, keys):
            if not len(series) or not len(pivots):
                continue
            lot = Lot(t, series)
            step = max(1, WINDOWS // len(pivots))
            for a in range(0, len(lot.first), step):
                s = np.repeat(np.arange(a, min(a + step, len(lot.first))), len(pivots))
                pivot = np.resize(pivots, len(s))
                hi = lot.below(s, pivot)
                there = lot.below(s, pivot - reach + 1) < hi
                if label_days is not None:
                    there &= hi < lot.below(s, pivot + np.resize(label_days, len(s)))
                seen = np.flatnonzero(there)
                s, pivot, hi = s[seen], pivot[seen], hi[seen]
                if len(s):
                    columns = [pa.array(_EPOCH + pivot), *(t[k].combine_chunks().take(pa.array(lot.first[s])) for k in keys)]
                    for kind, *spec in features:
                        columns += [c if isinstance(c, pa.Array) else nullable(c) for c in _KINDS[kind](lot, s, pivot, hi, *spec)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def in_series(data: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with a date, whole series in a task and sorted.  A window asks for that, so that Spark adds an exchange where `data`
    isn't partitioned by the first key, and none where it is."""
    place = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys[1:], "visit_date"))
    return data.where(F.col("visit_date").isNotNull()).withColumn("__place", place)


def _label_rows(columns: list[str], families, ends: np.ndarray, days: np.ndarray, names: list[str]):
    need = {c for _, features in families for kind, *_ in features for c in ("diff",) * (kind == "diff") + ("dow",) * (kind == "profile")}

    def lot_by(t: pa.Table, series: np.ndarray, keys: list[str]):
        """The lot by its series of these keys, the series of each row and whether its keys are known."""
        known = np.logical_and.reduce([t[k].combine_chunks().is_valid().to_numpy(zero_copy_only=False) for k in keys])
        part = t.select(["visit_date", "visitors", *sorted(need)])
        if keys[1:]:
            code = series.astype(np.int64)
            for c in series_codes(t, keys[1:]):
                code = code * (int(c.max()) + 2) + c + 1
            order = np.argsort(code, kind="stable")
            part, found = part.take(pa.array(order)), np.unique(code, return_inverse=True)[1]
            return Lot(part, found[order]), found, known
        return Lot(part, series), series, known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, series in whole_series(batches, ["store_id"]):
            if not len(series) or not len(ends):
                continue
            day = t["visit_date"].combine_chunks().cast(pa.int32()).to_numpy().astype(np.int64)
            rows, lots = [t[c].combine_chunks() for c in columns], None
            step = max(1, (1 << 22) // len(ends))
            for a in range(0, len(day), step):
                d = day[a:a + step, None]
                at, window = np.nonzero((ends <= d) & (d < ends + days))
                lots = lots or [lot_by(t, series, keys) for keys, _ in families]
                for b in range(0, len(at), LABELS):
                    r, pivot = at[b:b + LABELS] + a, ends[window[b:b + LABELS]]
                    out = [*(c.take(pa.array(r)) for c in rows), pa.array(_EPOCH + pivot)]
                    for (lot, series_of, known), (_, features) in zip(lots, families):
                        s, there = series_of[r], known[r]
                        hi = lot.below(s, pivot)
                        for kind, *spec in features:
                            found = (c if isinstance(c, pa.Array) else nullable(c) for c in _KINDS[kind](lot, s, pivot, hi, *spec))
                            out += found if there.all() else (pc.if_else(pa.array(there), c, pa.scalar(None, c.type)) for c in found)
                    yield pa.RecordBatch.from_arrays(out, names=names)
    return run


def label_features(data: DataFrame, windows: list[tuple], families: list[tuple], drop: tuple = ()) -> DataFrame:
    """The rows of `data` (without the columns `drop`), each once per window (end_date, days) whose label days hold its date, with end_date and
    the features of every (keys, features) in `families` at that pivot; null without history or with an unknown key.

    All families are formed where a store's sorted rows lie, so neither label rows nor features are shuffled, sorted or joined."""
    ends = np.array([(np.datetime64(p) - _EPOCH).astype(int) for p, _ in windows], np.int64)
    days = np.array([n for _, n in windows], np.int64)
    kept = [f for f in data.schema if f.name not in drop]
    made = [StructField(n, kind()) for _, features in families for n, kind in feature_columns(features)]
    schema = StructType([*kept, StructField("end_date", DateType()), *made])
    return in_series(data, ["store_id"]).mapInArrow(_label_rows([f.name for f in kept], families, ends, days, schema.names), schema)


def pivot_features(data: DataFrame, pivots: list, keys: list[str], features, label_days: list | None = None) -> DataFrame:
    """end_date, keys and features of every (pivot, series) pair with a row in the longest horizon.

    With `label_days` (the length of each pivot's label window) only of the pairs whose series has a day in that window: those
    that label rows can meet, a fraction of all.
    Where `data` is partitioned by the first key there is no exchange here; rows without a date are left out, a null key
    is a series of its own.  `pivots` are the distinct pivot dates."""
    numbers = np.array([(np.datetime64(p) - _EPOCH).astype(int) for p in pivots], np.int64)
    order = np.argsort(numbers)
    numbers, days = numbers[order], None if label_days is None else np.array(label_days, np.int64)[order]
    columns = feature_columns(features)
    schema = StructType([StructField("end_date", DateType()), *(data.schema[k] for k in keys), *(StructField(n, kind()) for n, kind in columns)])
    kinds = {f[0] for f in features}
    read = [*keys, "visit_date", "visitors", *(["diff"] if "diff" in kinds else []), *(["dow"] if "profile" in kinds else [])]
    return in_series(data.select(*read), keys).mapInArrow(_windows(keys, features, numbers, schema.names, days), schema)
