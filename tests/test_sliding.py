"""Statistics of ranges against direct ones; pivot features of odd series against plain loops."""

import datetime as dt

import numpy as np
import pytest

from pitwise.operators import sliding
from pitwise.plans import pit


def direct(x):
    n, out = len(x), {"count": len(x)}
    if n:
        d = x - x.mean()
        out |= {"min": x.min(), "max": x.max(), "mean": x.mean(), "median": np.median(x)}
        flat = x.min() == x.max()
        if n > 1:
            out["std"] = 0.0 if flat else np.sqrt((d * d).sum() / (n - 1))
        if n > 2:
            out["skew"] = 0.0 if flat else np.sqrt(n * (n - 1)) / (n - 2) * (d ** 3).mean() / (d * d).mean() ** 1.5
    return out


@pytest.mark.parametrize("seed", range(12))
def test_ranges_match_direct_statistics(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    series = np.unique(np.sort(rng.integers(0, 6, n)), return_inverse=True)[1]
    values = np.log1p(rng.integers(0, rng.integers(1, 60), n)).astype(float)
    if seed % 4 == 0:  # spread that is tiny next to the values, and next to one far value
        values = 5 + 1e-5 * values
        values[rng.integers(n)] = 900.0
    ranges, lo, hi = sliding.Ranges(values, series), [], []
    for s in range(series.max() + 1):
        at = np.flatnonzero(series == s)
        for _ in range(60):
            a = int(rng.integers(at[0], at[-1] + 2))
            lo.append(a)
            hi.append(int(rng.integers(a, at[-1] + 2)))
    got = ranges.summary(np.array(lo), np.array(hi))
    for i, (a, b) in enumerate(zip(lo, hi)):
        want = direct(values[a:b])
        for s in sliding.SUMMARY7:
            assert got[s][i] == pytest.approx(want[s], rel=1e-7, abs=1e-7) if s in want else np.isnan(got[s][i])


@pytest.fixture(scope="module")
def odd(spark):
    """Null values, a null store, gaps, one-row series, a null flag and a date that is missing."""
    rng, d0 = np.random.default_rng(5), dt.date(2001, 1, 1)
    rows = [(s, d0 + dt.timedelta(days=int(d)), None if rng.random() < .2 else float(rng.integers(0, 9)), int(d) % 7, [0, 1, None][int(d) % 3])
            for s, k in (("a", 300), ("b", 40), (None, 25), ("c", 1), ("d", 3)) for d in sorted(rng.choice(400, k, replace=False))]
    rows += [("e", None, 3.0, 1, 0), ("f", d0 + dt.timedelta(days=380), None, 3, None)]
    schema = "store_id string, visit_date date, visitors double, dow int, holiday_flg int"
    windows = spark.createDataFrame([(d0 + dt.timedelta(days=d), 7) for d in range(0, 460, 23)], "end_date date, days_in_label int")
    return rows, pit.PitContext(spark.createDataFrame(rows, schema).repartition(3, "store_id"), windows, 20)


@pytest.mark.parametrize("keys", [["store_id"], ["store_id", "dow"], ["store_id", "holiday_flg"]])
def test_pivot_features_match_loops(odd, keys, monkeypatch):
    rows, ctx = odd
    monkeypatch.setattr("pitwise.plans.pivots.WINDOWS", 64)
    rates = (("m", "w", "m2", .9, .8), ("n", None, None, .999, .999))
    got = ctx.family(keys, ("summary", "s", (60, 14)), ("decay", 60, rates), ("first_last", 60)).collect()
    names = ("store_id", "visit_date", "visitors", "dow", "holiday_flg")
    want = {}
    for pivot in ctx.pivots:
        for row in rows:
            r = dict(zip(names, row))
            if r["visit_date"] and 1 <= (pivot - r["visit_date"]).days < 60:
                want.setdefault((pivot, *(r[k] for k in keys)), []).append(((pivot - r["visit_date"]).days, r["visitors"]))
    assert {(r["end_date"], *(r[k] for k in keys)) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        seen = want[r["end_date"], *(r[k] for k in keys)]
        for n in (60, 14):
            x = direct(np.array([v for a, v in seen if a < n and v is not None], float))
            for s in sliding.SUMMARY7:
                assert r[f"s_{s}{n}"] == pytest.approx(x.get(s), rel=1e-9, abs=1e-9) if s in x else r[f"s_{s}{n}"] is None
        assert (r["first_time"], r["last_time"]) == (max(a for a, _ in seen), min(a for a, _ in seen))
        there = [(a, v) for a, v in seen if v is not None]
        for mean, weights, mean2, rate, rate2 in rates:
            w = sum(rate ** a for a, _ in there)
            for name, value in ((mean, sum(v * rate ** a for a, v in there)), (mean2, sum(v * rate2 ** a for a, v in there))):
                if name:
                    assert r[name] == pytest.approx(value / w, rel=1e-9) if there else r[name] is None
            if weights:
                assert r[weights] == pytest.approx(w, rel=1e-9) if there else r[weights] is None


def test_no_pivots_and_no_rows(spark, odd):
    _, ctx = odd
    none = pit.PitContext(ctx.data, ctx.windows.limit(0), 0)
    assert none.family(["store_id"], ("summary", "s", (14,))).count() == 0
    assert pit.PitContext(ctx.data.limit(0).repartition(3, "store_id"), ctx.windows, 20).family(["store_id"], ("first_last", 14)).count() == 0


@pytest.mark.parametrize("keys", [["store_id"], ["store_id", "dow"]])
def test_rolling_matches_loops(spark, odd, keys):
    from pitwise.operators import rolling
    rows, ctx = odd
    got = rolling.rolling_stats(ctx.data, keys, ("30d", "90d")).collect()
    names = ("store_id", "visit_date", "visitors", "dow", "holiday_flg")
    series = {}
    for row in rows:
        r = dict(zip(names, row))
        series.setdefault(tuple(r[k] for k in keys), []).append((r["visit_date"], r["visitors"]))
    assert len(got) == len(rows)
    for r in got:
        mine = sorted(series[tuple(r[k] for k in keys)], key=lambda x: (x[0] is not None, x[0] or dt.date.min))
        i = [d for d, _ in mine].index(r["visit_date"])
        for n in (30, 90):
            x = {}
            if i:
                at = mine[i - 1][0]
                x = direct(np.array([v for d, v in mine[:i] if v is not None and (d == at or None not in (d, at) and 0 <= (at - d).days < n)], float))
                x["cnt"] = x["count"]
            for s in rolling.ROLL_STATS:
                name = rolling.rolling_name(keys, f"{n}d", s)
                assert r[name] == pytest.approx(x[s], rel=1e-9, abs=1e-9) if s in x else r[name] is None
