"""Grouped quantiles from counts, character look-ups, text folders with many documents a file, drawn vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.operators import clean as CL
from pitwise.operators import joins as J
from pitwise.operators import text as TX
from pitwise.session import scratch_path
from pitwise.sources import readers as RD


def test_group_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)])) for _ in range(500)]
    rows += [("hot", 7)] * 2_000 + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r["k"]: r for r in CL.group_quantiles(df, ["k"], "v", {"q": 0.3, "median": 0.5}).collect()}
    assert set(got) == {"a", "b", None, "hot"}
    for k, r in got.items():
        held = [v for key, v in rows if key == k and v is not None]
        assert r["count"] == len(held)
        assert (r["q"], r["median"]) == pytest.approx((np.quantile(held, 0.3), np.median(held)))


def test_attribute_statistics_keep_no_buffer_of_a_group(spark):
    df = spark.createDataFrame([(1, "x", 2), (2, "x", 5), (3, "x", 9), (4, "y", None), (5, None, 1)], "id int, k string, v int")
    out = J.attr_static(df.select("id", "k"), df, "k", "v", "n")
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: (r["min_n_in_k"], r["median_n_in_k"]) for r in out.collect()}
    assert got == {1: (2, 5), 2: (2, 5), 3: (2, 5), 4: (None, None), 5: (None, None)}
    assert J.attr_static(df.select("id", "k"), df.limit(0), "k", "v", "n").count() == 5


def test_characters(spark):
    texts = spark.createDataFrame([(1, "abca𝒳é"), (2, ""), (3, None), (4, "a?b")], "id int, text string")
    vocab = TX.char_vocabulary(texts.where("id = 1"))
    ids = {r["ch"]: r["id"] for r in vocab.collect()}
    got = {r["id"]: r["x"] for r in texts.select("id", TX.char_ids(vocab)("text").alias("x")).collect()}
    assert got == {1: [ids[c] for c in "abca𝒳é"], 2: [], 3: None, 4: [ids["a"], ids["b"]]}
    none = texts.select(TX.char_ids(vocab.limit(0))("text").alias("x")).collect()
    assert [r["x"] for r in none] == [[], [], None, []]
    windows = TX.char_windows(texts, vocab, "id", maxlen=3)
    assert [(r["id"], r["i"], len(r["x"]), len(r["y"])) for r in windows.orderBy("i").collect()] == [(1, 0, 3, 3), (1, 1, 3, 3)]
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_text_folders_of_many_documents_a_file(spark):
    rows = [("x", "one\ntwo"), ("x", ""), ("y", "three\n"), ("y", "\x1e alone"), ("y", "three\n")]
    path = scratch_path(spark, "records")
    spark.createDataFrame(rows, "k string, text string").coalesce(1).write.option("lineSep", "\x1e\n").partitionBy("k").text(path)
    df = RD.read_text_folders(spark, path, separator="\x1e\n")
    got = sorted((r["label"], r["class_idx"], r["text"]) for r in df.collect())
    assert got == sorted((f"k={k}", "xy".index(k), t) for k, t in rows)
    assert df.select("path").distinct().count() == 2


def test_drawn_vectors_are_normal_and_repeat(spark):
    vocab = spark.range(500).select("id", F.concat(F.lit("t"), "id").alias("token"))
    words = spark.createDataFrame([("t3", 0)], "word string, idx int")
    vectors = spark.createDataFrame([(0, [3.0, 6.0])], "idx int, vector array<double>")
    first, again = (sorted(map(tuple, TX.vocab_vectors(vocab, words, vectors, dim=2).collect())) for _ in range(2))
    assert first == again and first[3] == (3, [1.0, 2.0])
    drawn = np.array([v for i, v in first if i != 3]) * 3
    assert abs(drawn.mean()) < 0.06 and abs(drawn.std() - 0.6) < 0.05
