"""Exact statistics of many windows over sorted series, without copying a row once per window.

Spark partitions the rows by the series' first key and sorts them; a task then takes whole series from its sorted
stream.  A window is a range of places in its series, found by binary search.  Its statistics come from structures built
once per lot of rows: count, mean, deviation and skew from prefix sums of powers (centred per series, extended precision;
a window whose spread is tiny next to its series' is summed directly), minimum and maximum from a table of doubling
ranges, and the median from a wavelet matrix over the values' ranks.  A lot costs n log n for its rows and log n per
window, whatever the windows' lengths; memory holds the lot and a bounded number of windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.stats import SUMMARY7

WINDOWS = 1 << 17  #: windows worked on at a time
_TINY = 1e-6  #: variance, next to the largest squared deviation of the lot, below which moments are summed directly


class Ranges:
    """Statistics of ranges [lo, hi) over one array of finite numbers."""

    def __init__(self, values: np.ndarray, series: np.ndarray):
        """`series` numbers, from 0 and ascending, the series of each value."""
        self.values = values
        n = len(values)
        sizes = np.maximum(np.bincount(series, minlength=1), 1)
        centre = (np.bincount(series, values, len(sizes)) / sizes)[series] if n else values
        self.centre = centre
        x = (values - centre).astype(np.longdouble)
        self.powers = [np.concatenate([np.zeros(1, np.longdouble), np.cumsum(x ** k)]) for k in (1, 2, 3)]
        self.widest = float(np.max(x * x, initial=0))
        self.lows, self.highs, width = [values], [values], 1
        while 2 * width <= int(sizes.max()):
            for table, pick in ((self.lows, np.minimum), (self.highs, np.maximum)):
                t = table[-1]
                table.append(np.concatenate([pick(t[:n - width], t[width:]), t[n - width:]]))
            width *= 2
        self.distinct, rank = np.unique(values, return_inverse=True)
        self.levels = []
        for bit in reversed(range(max(len(self.distinct) - 1, 0).bit_length())):
            one = (rank >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((bit, zeros))
            rank = np.concatenate([rank[~one], rank[one]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, of each range."""
        rank = np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            left = k < b - a
            rank |= np.where(left, 0, 1 << bit)
            k = np.where(left, k, k - (b - a))
            lo, hi = np.where(left, a, zeros[-1] + lo - a), np.where(left, b, zeros[-1] + hi - b)
        return self.distinct[rank]

    def extreme(self, tables: list[np.ndarray], pick, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo).astype(float))[1] - 1  # the largest power of two that fits
        out = np.empty(len(lo))
        for v in np.unique(level):
            at = level == v
            out[at] = pick(tables[v][lo[at]], tables[v][hi[at] - (1 << int(v))])
        return out

    def moments(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean, second and third central moment of non-empty ranges."""
        n = (hi - lo).astype(np.longdouble)
        s1, s2, s3 = ((p[hi] - p[lo]) / n for p in self.powers)
        m2, m3 = s2 - s1 * s1, s3 - 3 * s1 * s2 + 2 * s1 ** 3
        mean = np.asarray(self.centre[lo] + s1, float)
        m2, m3 = np.asarray(np.maximum(m2, 0), float), np.asarray(m3, float)
        close = np.flatnonzero((m2 < _TINY * self.widest) & (hi - lo > 1))
        size = (hi - lo)[close]
        for part in np.split(np.arange(len(close)), np.flatnonzero(np.diff(np.cumsum(size) // (8 * WINDOWS))) + 1):
            if len(part):
                at, k = close[part], size[part]
                first = np.cumsum(k) - k
                x = self.values[np.repeat(lo[at] - first, k) + np.arange(k.sum())]
                mean[at] = x[first] + np.add.reduceat(x - np.repeat(x[first], k), first) / k
                d = x - np.repeat(mean[at], k)
                m2[at], m3[at] = np.add.reduceat(d * d, first) / k, np.add.reduceat(d ** 3, first) / k
        return mean, m2, m3

    def summary(self, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
        """The seven statistics (stats.SUMMARY7) of every range; NaN where one isn't defined."""
        n = hi - lo
        out = {s: np.full(len(n), np.nan) for s in SUMMARY7} | {"count": n}
        some = np.flatnonzero(n)
        lo, hi, k = lo[some], hi[some], n[some]
        low, high = self.extreme(self.lows, np.minimum, lo, hi), self.extreme(self.highs, np.maximum, lo, hi)
        mean, m2, m3 = self.moments(lo, hi)
        middle = (low + high) / 2
        many = np.flatnonzero(k > 2)
        middle[many] = (self.kth(lo[many], hi[many], (k[many] - 1) // 2) + self.kth(lo[many], hi[many], k[many] // 2)) / 2
        flat = low == high
        with np.errstate(divide="ignore", invalid="ignore"):
            std = np.where(k > 1, np.where(flat, 0.0, np.sqrt(m2 * k / (k - 1))), np.nan)
            skew = np.where(k > 2, np.where(flat, 0.0, np.sqrt(k * (k - 1.0)) / (k - 2) * m3 / m2 ** 1.5), np.nan)
        for s, x in (("min", low), ("max", high), ("mean", mean), ("median", middle), ("std", std), ("skew", skew)):
            out[s][some] = x
        return out


def series_codes(t: pa.Table, keys: list[str]) -> list[np.ndarray]:
    """Numbers that tell a column's values apart, null one of them."""
    return [pc.fill_null(t[k].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for k in keys]


def whole_series(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Lots of whole series of a partition sorted by `keys`, with each row's series number; the series that a batch
    cuts waits for its rest."""
    waiting: list[pa.RecordBatch] = []

    def lot(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        new = reduce(np.logical_or, (np.append(False, c[1:] != c[:-1]) for c in series_codes(t, keys)))
        return t, np.cumsum(new)

    for b in batches:
        if not b.num_rows:
            continue
        waiting.append(b)
        ends = pa.Table.from_batches([waiting[0].slice(0, 1), b.slice(b.num_rows - 1)]).select(keys)
        if all(c[0] == c[1] for c in series_codes(ends, keys)):
            continue  # still within one series
        t, series = lot(pa.Table.from_batches(waiting))
        cut = int(np.searchsorted(series, series[-1]))
        yield t.slice(0, cut), series[:cut]
        waiting = t.slice(cut).combine_chunks().to_batches()
    if waiting:
        yield lot(pa.Table.from_batches(waiting))


def present(t: pa.Table, value: str, series: np.ndarray) -> tuple[Ranges, np.ndarray]:
    """Ranges over the values that aren't null, and for each place in the table (and its end) the number before it."""
    v = t[value].combine_chunks().cast(pa.float64())
    there = v.is_valid().to_numpy(zero_copy_only=False)
    return Ranges(v.drop_null().to_numpy(), series[there]), np.concatenate([[0], np.cumsum(there)])


def nullable(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=np.isnan(x)) if x.dtype.kind == "f" else pa.array(x)
