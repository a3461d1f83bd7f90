"""Keyless event scans against the same series under one key; average linkage against its definition."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.operators import events, metrics


@pytest.mark.parametrize("kind", ["mixed", "all", "none", "rare", "nulls", "empty"])
def test_segments_match_one_partition(spark, kind):
    rng = np.random.default_rng(len(kind))
    flags = {"mixed": rng.random(200) < .6, "all": np.ones(90), "none": np.zeros(40), "rare": rng.random(300) < .01,
             "nulls": rng.random(150) < .7, "empty": []}[kind]
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=2 * i), None if kind == "nulls" and rng.random() < .2 else int(f), i % 3) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "date date, flag int, other int").repartition(5)

    def both(x, keys):
        x = events.add_duration(events.add_elapsed(x, "flag", "date", keys), "flag", "date", keys)
        return sorted(map(tuple, x.select("date", "flag", "other", "af_flag", "be_flag", "dur_time_flag", "dur_flag", "dur_prog_flag").collect()))

    assert both(df, None) == both(df.withColumn("one", F.lit(1)), ["one"])


def test_segments_need_no_single_partition(spark):
    df = spark.range(1000).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") % 7 == 0).cast("int").alias("flag"))
    out = events.add_duration(events.add_elapsed(df, "flag", "date"), "flag", "date")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage_by_definition(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 12))
    d = np.round(rng.random((n, n)), 1 if seed % 2 else 6)
    d = np.triu(d, 1) + np.triu(d, 1).T
    names = [f"c{i:02d}" for i in range(n)]
    groups = [[i] for i in range(n)]
    for left, right, distance in metrics.average_linkage(names, d):
        pairs = {(i, j): np.mean([d[a, b] for a in groups[i] for b in groups[j]]) for i in range(len(groups)) for j in range(i)}
        mine = [next(k for k, g in enumerate(groups) if sorted(names[x] for x in g) == side) for side in (left, right)]
        assert distance == pytest.approx(min(pairs.values())) == pytest.approx(pairs[max(mine), min(mine)])
        merged = groups[mine[0]] + groups[mine[1]]
        groups = [g for k, g in enumerate(groups) if k not in mine] + [merged]
    assert len(groups) == 1


def test_feature_groups_of_known_columns(spark):
    df = spark.range(500).select(F.col("id").alias("a"), (F.col("id") ** 3).alias("b"), (-F.col("id")).alias("c"), F.lit(7).alias("flat"),
                                 F.lit(None).cast("double").alias("empty"), (F.xxhash64("id") % 1000).alias("noise"))
    got = metrics.feature_groups(df, ["a", "b", "c", "flat", "empty", "noise"]).orderBy("step").collect()
    near = [r for r in got if r["redundant"]]
    assert [r["step"] for r in got] == [1, 2, 3, 4, 5] and {x for r in near for x in r["left"] + r["right"]} == {"a", "b", "c"}
    assert near[-1]["size"] == 3 and near[-1]["distance"] == 0
    signed = metrics.feature_groups(df, ["a", "b", "c"], absolute=False).orderBy("step").collect()
    assert [r["redundant"] for r in signed] == [True, False] and signed[-1]["distance"] == 2
    assert metrics.feature_groups(df.limit(0), ["a", "b"]).collect()[0]["distance"] == 1
