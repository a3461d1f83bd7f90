"""A user's aggregate with states per task against plain grouping: null keys, null values, one hot key, no rows."""

import pytest

from pitwise.operators import plugins

SPREAD = plugins.Aggregate(lambda: None, lambda s, x: s if x is None else (min(s[0], x), max(s[1], x)) if s else (x, x),
                           lambda a, b: (min(a[0], b[0]), max(a[1], b[1])) if a and b else a or b, lambda s: s[1] - s[0] if s else None)


@pytest.fixture(scope="module")
def rows():
    keys = ["hot"] * 3000 + [f"k{i}" for i in range(200)] * 3 + [None] * 40
    return [(k, i % 3, None if i % 11 == 0 else float(i * 7919 % 1000), i % 5) for i, k in enumerate(keys)] + [("none", 0, None, 1)]


@pytest.mark.parametrize("states", [3, 50_000])
@pytest.mark.parametrize("keys", [["k"], ["k", "part"], []])
def test_states_of_tasks_merge(spark, rows, keys, states, monkeypatch):
    monkeypatch.setattr(plugins, "STATES", states)
    df = spark.createDataFrame(rows, "k string, part int, x double, w long").repartition(6)
    want_spread, want_mean = {}, {}
    for k, part, x, w in rows:
        key = tuple({"k": k, "part": part}[c] for c in keys)
        want_spread.setdefault(key, []).extend([] if x is None else [x])
        s = want_mean.setdefault(key, [0.0, 0])
        if x is not None:
            s[0], s[1] = s[0] + w * x, s[1] + w
    got = {tuple(r[:-1]): r[-1] for r in plugins.mergeable_aggregate(df, keys, ["x"], SPREAD, "spread").collect()}
    assert got == {k: max(v) - min(v) if v else None for k, v in want_spread.items()}
    got = {tuple(r[:-1]): r[-1] for r in plugins.mergeable_aggregate(df, keys, ["w", "x"], plugins.WEIGHTED_MEAN, "mean").collect()}
    assert got == {k: pytest.approx(a / b) if b else None for k, (a, b) in want_mean.items()}


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert plugins.mergeable_aggregate(df, ["k"], ["x"], SPREAD, "spread").count() == 0
    assert plugins.mergeable_aggregate(df, [], ["x"], SPREAD, "spread", "double").count() == 0


def test_states_are_shuffled_not_rows(spark, rows):
    df = spark.createDataFrame(rows, "k string, part int, x double, w long")
    plan = plugins.mergeable_aggregate(df, ["k"], ["x"], SPREAD, "spread")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Exchange") == 1
    assert plan.index("MapInArrow") < plan.index("Exchange") < plan.rindex("MapInArrow")
