"""Rows with null groups, null values, empty documents and repeated rows keep their place."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitwise.operators import clean as CL
from pitwise.operators import metrics as M
from pitwise.operators import models as MD
from pitwise.operators import split as SP
from pitwise.operators import text as TX
from pitwise.operators.ordering import global_prefix_sum, global_row_number
from pitwise.sources import readers as R


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None), (5, "b")], "id long, g string")
    rn = {r["id"]: r["rn"] for r in global_row_number(df, ["id"], ["g"]).collect()}
    assert rn == {1: 1, 3: 2, 2: 1, 4: 2, 5: 1}
    before = {r["id"]: r["offset"] for r in global_prefix_sum(df, ["id"], "id", ["g"]).collect()}
    assert before == {1: 0, 3: 1, 2: 0, 4: 2, 5: 0}
    assert SP.stratified_split(df, "g", "id", 1, 1).count() == 5
    assert SP.ordered_group_split(df, ["g"], ["id"]).count() == 5


def test_spearman_uses_pairwise_complete_rows(spark):
    rng = np.random.default_rng(1)
    x = pd.DataFrame(rng.integers(0, 9, (60, 3)).astype(float), columns=list("abc"))
    x.loc[::7, "c"] = None
    df = spark.createDataFrame([tuple(None if math.isnan(v) else v for v in r) for r in x.itertuples(index=False)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["rho"] for r in M.spearman_pairs(df, list("abc")).collect()}
    for a, b in got:
        both = x[[a, b]].dropna().rank()
        assert got[a, b] == pytest.approx(both[a].corr(both[b]))
    assert len(got) == 3


def test_documents_without_tokens_stay(spark):
    docs = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, None)], "doc_id long, tokens array<string>")
    vocab = TX.vocabulary(docs, min_freq=1)
    ids = {r["doc_id"]: r["ids"] for r in TX.numericalize(docs, vocab).collect()}
    assert sorted(ids) == [1, 2, 3] and ids[2] == ids[3] == [] and len(ids[1]) == 2


def test_rows_without_labels_stay(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", ""), ("c", None)], "name string, labels string")
    _, enc = R.multi_label(df, "name", "labels")
    got = {r["name"]: (r["labels_idx"], r["nhot"], r["label_idx"]) for r in enc.collect()}
    assert got == {"a": ([0, 1], [1.0, 1.0], None), "b": ([], [0.0, 0.0], None), "c": ([], [0.0, 0.0], None)}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, 101).astype(float)
    df = spark.createDataFrame([(float(v), None if i % 3 else float(v) * 2, None) for i, v in enumerate(x)], "a double, b double, c double")
    got = {r["column"]: r for r in CL.quantiles(df, ["a", "b", "c"], {"q": 0.25, "m": 0.5}).collect()}
    assert got["a"]["q"] == pytest.approx(np.quantile(x, 0.25)) and got["b"]["m"] == pytest.approx(np.quantile(x[::3] * 2, 0.5))
    assert got["c"]["count"] == 0 and got["c"]["m"] is None


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, None, "a", 1.0), (1, None, "b", 1.0)], "k int, n string, v string, f double")
    assert CL.constant_columns(df) == ["k", "n", "f"]


def test_knn_in_blocks_is_exact(spark):
    rng = np.random.default_rng(3)
    q, t = rng.standard_normal((30, 4)), rng.standard_normal((90, 4))
    y = rng.standard_normal(90)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, v array<double>")
    train = spark.createDataFrame([(1000 + i, v.tolist(), float(y[i])) for i, v in enumerate(t)], "id long, v array<double>, y double")
    got = {r["id"]: r["knn_pred"] for r in MD.knn_regress(queries, train, "id", "v", "y", 3, block=16).collect()}
    d = ((q[:, None] - t[None]) ** 2).sum(-1)
    for i in range(30):
        assert got[i] == pytest.approx(y[np.argsort(d[i], kind="stable")[:3]].mean())


def test_markers(spark):
    rows = ["cooool", "so so so so so good", "VERY Loud AB x/y #tag", None, "", "aaa bbb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").select("i", TX.mark_text("t").alias("t"))
    got = {r["i"]: r["t"] for r in df.collect()}
    assert got[0] == "c tk_rep 4 o l" and got[1] == " tk_wrep 5 so good" and got[3] is None
    assert got[2] == " t_up very loud ab x / y # tag" and got[5] == "aaa bbb"
