"""Memory of Python workers in the training-data operators, and the ratings of the factor model made once."""

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import functions as F

from pitwise.catalog import model_queries
from pitwise.llm import substrings, toxicity
from pitwise.operators import models as MD
from pitwise.session import staged


def test_windows_leave_a_task_in_lots(spark, monkeypatch):
    texts = [" ".join(f"w{(i * 7 + j * j) % 501}" for j in range(900)).encode() for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array([1] * 30, pa.int64()), pa.array(texts, pa.binary())],
                                       names=["rk", "copy", "text"])
    for lengths in ([5, 10, 20], [20]):
        whole = pa.Table.from_batches(substrings._emit(0, lengths, 20)([batch]))
        with monkeypatch.context() as m:
            m.setattr(substrings, "LOT", 500)
            lots = list(substrings._emit(0, lengths, 20)([batch]))
        assert max(b.num_rows for b in lots) <= 500 < whole.num_rows
        assert pa.Table.from_batches(lots).combine_chunks().equals(whole.combine_chunks())


def test_passages_are_read_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(64 << 20))
    try:
        substrings.drop_repeated_passages(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
        assert int(spark.conf.get(key)) == 8 << 20
    finally:
        spark.conf.set(key, old)


def test_word_forms_leave_a_task_in_lots(monkeypatch):
    monkeypatch.setattr(toxicity, "FORMS", 300)
    texts = [" ".join("".join(chr(97 + (i * j + d) % 26) for d in range(3)) for j in range(60)) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 for i in range(40)], pa.int32()), pa.array([1.0] * 40)], names=["text", "toxic", "w"])
    lots = list(toxicity._count([batch]))
    assert max(b.num_rows for b in lots) <= 300 + 60
    want = {}
    for i, t in enumerate(texts):
        for f in toxicity._forms(t):
            want.setdefault(f, [0, 0])[1 - i % 2] += 1
    got = pa.Table.from_batches(lots).group_by("form").aggregate([("pos", "sum"), ("neg", "sum")]).to_pylist()
    assert {r["form"]: [r["pos_sum"], r["neg_sum"]] for r in got} == want


def test_sample_of_toxicity_is_held_by_few_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} " + ("idiot" if i % 2 else "fine")) for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    plans = []

    def keep(df):
        out = staged(df)
        plans.append((df._jdf.queryExecution().executedPlan().toString(), len(out.inputFiles())))
        return out
    monkeypatch.setattr(toxicity, "staged", keep)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("70", "false", "-1")):
            spark.conf.set(k, v)
        grammar = toxicity.fit(docs, labels)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "idiot " in grammar.patterns
    assert all(files <= toxicity.FIT_TASKS for _, files in plans)
    assert not any("SortMergeJoin" in plan for plan, _ in plans)


def _ratings(spark):
    rng = np.random.default_rng(2)
    rows = [(u, i, float(rng.integers(1, 50))) for u in range(40) for i in range(12) if rng.random() < .6]
    return spark.createDataFrame(rows, "uid int, item int, rating double").repartition(3, "uid")


def test_factor_predictions_are_the_models(spark):
    ratings = _ratings(spark)
    scored = ratings.limit(30).unionByName(spark.createDataFrame([(99, 3, 2.0), (1, 99, 2.0), (None, None, None)], ratings.schema)).withColumn("more", F.lit(1))
    model, got = MD.als_fit_predict(ratings, "uid", "item", "rating", rank=4, max_iter=3, scored=scored)
    assert got.columns == ["item", "uid", "rating", "more", "uid_bias", "item_bias", "prediction"]
    assert isinstance(model, ALSModel)
    mean, lo, hi = ratings.agg(F.avg("rating"), F.min("rating"), F.max("rating")).first()
    product = {(r["uid"], r["item"]): r["prediction"] for r in model.transform(ratings.select("uid", "item")).collect()}
    rows = got.collect()
    assert len(rows) == 33
    for r in rows:
        total = mean + (r["uid_bias"] or 0.0) + (r["item_bias"] or 0.0) + product.get((r["uid"], r["item"]), 0.0)
        assert abs(r["prediction"] - min(max(total, lo), hi)) < 1e-9


def test_ratings_are_made_once(spark, monkeypatch):
    """The tables behind the ratings are read for the dictionary and the coded ratings only, and rows to predict are shuffled without factors."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    ratings = _ratings(spark).withColumnRenamed("uid", "user").mapInArrow(count, "user int, item int, rating double")
    monkeypatch.setattr(model_queries.A, "ratings", lambda *_: ratings)
    got = model_queries.q_als(spark, None)
    got.write.format("noop").mode("overwrite").save()
    assert made.value == got.count() == _ratings(spark).count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "features" not in plan
