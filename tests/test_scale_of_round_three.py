"""The steps that grew faster than the input, or held what they no longer need."""

import datetime as dt
import gc
import weakref

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitwise.catalog.common import rounded
from pitwise.operators import metrics as MT
from pitwise.operators import models as MD
from pitwise.operators import plugins as PL
from pitwise.operators import text as TX
from pitwise.plans import pit, pivots

D0 = dt.date(2020, 1, 1)


def _context(spark, stores=6):
    rng = np.random.default_rng(5)
    rows = [(s, D0 + dt.timedelta(days=int(d)), None if d % 11 == 0 else float(rng.integers(1, 5)), (D0 + dt.timedelta(days=int(d))).weekday(), "ab"[s % 2])
            for s in range(stores) for d in np.sort(rng.choice(300, 25, replace=False))]
    schema = "store_id long, visit_date date, visitors double, dow int, air_genre_name string"
    windows = spark.createDataFrame([(D0 + dt.timedelta(days=d), 9) for d in range(20, 300, 14)], "end_date date, days_in_label int")
    return pit.PitContext(spark.createDataFrame(rows, schema).repartition(3, "store_id"), windows, 20, max_label_days=9)


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(0, 1, 3000), *(rng.integers(-10**9, 10**9, 3000) * 5e-7), *rng.normal(0, 1e8, 500), *(10.0 ** rng.integers(-12, 20, 200)),
              0.0, -0.0, -1e-9, 1 / 128, -1 / 128, 0.4999995, 1.0000005, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, x double")
    both = rounded(df).withColumnRenamed("x", "y").join(df.select("i", F.round("x", 6).alias("x")), "i")
    bits = lambda c: F.hex(F.encode(F.col(c).cast("string"), "utf-8"))  # noqa: E731  tells -0.0 from 0.0
    assert both.where(~bits("x").eqNullSafe(bits("y"))).count() == 0
    assert "round(x" in rounded(df)._jdf.queryExecution().toString() and "rint" in rounded(df)._jdf.queryExecution().toString().lower()


def test_a_lot_goes_when_its_windows_are_done():
    t = pa.table({"visit_date": pa.array([D0, D0 + dt.timedelta(days=3)]), "visitors": [1.0, 2.0]})
    lot = pivots.Lot(t, np.zeros(2, np.int64))
    assert lot.running("visitors", .5) is lot.running("visitors", .5)
    gone = weakref.ref(lot)
    del lot
    gc.collect()
    assert gone() is None


def test_families_at_labels_are_those_that_label_rows_meet(spark):
    ctx = _context(spark)
    lab = pit.labels(ctx)
    for keys in (["store_id"], ["store_id", "dow"]):
        features = (("summary", "s", (60,)), ("first_last", 60))
        every = {(r["end_date"], *(r[k] for k in keys)): r for r in ctx.family(keys, *features).collect()}
        few = {(r["end_date"], *(r[k] for k in keys)): r for r in ctx.at_labels().family(keys, *features).collect()}
        met = {tuple(r) for r in lab.select("end_date", *keys).distinct().collect()}
        assert set(few) == set(every) & met and len(few) < len(every)
        assert all(few[k] == every[k] for k in few)


def test_families_are_merged_not_broadcast(spark):
    ctx = _context(spark)
    fams = [PL.FeatureFamily(pit.store_week_feat, ["store_id", "dow"], labelled=True), PL.FeatureFamily(pit.store_exp_feat, ["store_id"])]
    out = PL.build_with_families(ctx, fams)
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("SortMergeJoin") == 2
    whole = [PL.FeatureFamily(f.fn, f.keys) for f in fams]
    key = lambda r: (r["end_date"], r["store_id"], r["visit_date"])
    assert sorted(rows, key=key) == sorted(PL.build_with_families(ctx, whole).collect(), key=key)


def test_weekday_profile_is_the_weekday_family_laid_out(spark):
    ctx = _context(spark)
    want = {}
    for r in ctx.family(["store_id", "dow"], ("summary", "d", (60,))).collect():
        want[r["end_date"], r["store_id"], r["dow"]] = (r["d_mean60"], r["d_median60"], r["d_max60"], r["d_count60"], r["dow"] if r["d_count60"] else None)
    got = pit.store_all_week_feat(ctx, 60).collect()
    assert {(r["end_date"], r["store_id"]) for r in got} == {k[:2] for k in want}
    for r in got:
        for i in range(7):
            here = tuple(r[f"{i}store_dow_{s}60"] for s in ("mean", "median", "sum", "count")) + (r[f"{i}dow"],)
            assert here == pytest.approx(want.get((r["end_date"], r["store_id"], i), (None, None, None, 0, None)))


def test_genre_days_meet_pivots_once_a_value(spark):
    few, many = (pit._genre_days(_context(spark, n), ["air_genre_name"]).count() for n in (6, 120))
    assert many <= 300 * 2 * 5 and many < 20 * few
    hist = pit.genre_exp_feat(_context(spark, 40), 60)
    assert hist.count() and hist.where("genre_exp_weight_sum60 is null and genre_exp_mean60 is not null").count() == 0


def test_queries_that_see_all_cells_leave_in_pieces():
    rng = np.random.default_rng(2)
    cells = MD.Cells(rng.normal(size=(300, 64)))
    cells.count[:], cells.radius[:] = 5, 100.0
    vec = pa.array(list(rng.normal(size=(400, 64))), pa.list_(pa.float64()))
    b = pa.RecordBatch.from_arrays([pa.array(range(400)), vec, pa.array(np.zeros(400, np.int32)), pa.nulls(400, pa.float64())], names=["id", "vec", "cell", "kth"])
    out = list(MD._other(cells, 4)([b]))
    assert sum(x.num_rows for x in out) == 400 * 299
    assert max(x.num_rows for x in out) <= 8192


def test_arrays_of_ids_are_made_inside_documents(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "zz", None]), (2, []), (3, None), (None, ["a", "yy"]), (4, ["b"]), (4, ["zz", "a"])],
                                 "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 2), ("b", 3), ("zz", 4)], "token string, id long")
    for head in (1, 2, 50):
        df = TX.numericalize(docs, vocab, head=head)
        assert {r["doc_id"]: r["ids"] for r in df.collect()} == {1: [2, 3, 2, 4, 0], 2: [], 3: [], None: [2, 0], 4: [3, 4, 2]}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("hashpartitioning(word") <= 3  # counts of words, and the rare ones' look-up


@pytest.mark.parametrize("backwards", [False, True])
def test_batches_from_documents_are_those_from_tokens(spark, backwards):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, [int(x) for x in rng.integers(0, 90, n)]) for i, n in enumerate([5, 0, 40, 1, 300, 2, 2, 77, 3])],
                                 "doc_id long, tokens array<long>")
    for bs, bptt in ((3, 7), (4, 10), (1, 5), (60, 4), (500, 3)):
        tokens = TX.lm_batches(TX.token_stream(docs, eos=None).withColumnRenamed("token", "id"), bs, bptt, backwards=backwards)
        pieces = TX.lm_batches(TX.token_stream(docs, eos=None, pieces=True), bs, bptt, id_col="tokens", backwards=backwards)
        assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, tokens.collect()))


def test_bags_are_counted_inside_documents(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", None]), (2, []), (3, None), (None, ["a"]), (None, ["a", "c"]), (4, ["b"]), (4, ["b", "a"])],
                                 "doc_id long, tokens array<string>")
    got = sorted(map(tuple, TX.bag_of_words(docs).collect()), key=str)
    assert got == sorted([(1, "a", 2, 1), (1, "b", 1, 1), (1, None, 1, 1), (None, "a", 2, 1), (None, "c", 1, 1), (4, "b", 2, 1), (4, "a", 1, 1)], key=str)
    plan = TX.bag_of_words(docs.where("doc_id < 4"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("head", [1, 3, 100])
def test_scores_do_not_depend_on_the_head(spark, head):
    bow = TX.bag_of_words(spark.createDataFrame([(1, ["a", "b", "q"]), (2, ["a"]), (3, ["c", "a"])], "doc_id long, tokens array<string>"))
    ratios = spark.createDataFrame([("a", 0, .5), ("a", 1, -.5), ("b", 0, 1.), ("c", 1, 2.)], "term string, class int, r double")
    got = {(r["doc_id"], r["class"]): r["score"] for r in TX.nb_scores(bow, ratios, head=head).collect()}
    assert got == {(1, 0): 1.5, (1, 1): -.5, (2, 0): .5, (2, 1): -.5, (3, 0): .5, (3, 1): 1.5}


def test_ranks_are_looked_up_once_a_column(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = pd.DataFrame(rng.integers(0, 9, (80, 4)).astype(float), columns=list("abcd"))
    x.loc[::7, "c"], x.loc[::5, "d"] = None, None
    df = spark.createDataFrame([tuple(None if np.isnan(v) else v for v in r) for r in x.itertuples(index=False)], "a double, b double, c double, d double")
    want = {}
    for i, a in enumerate("abcd"):
        for b in "abcd"[i + 1:]:
            both = x[[a, b]].dropna().rank()
            want[a, b] = both[a].corr(both[b])
    for ranks in (0, 10**6):
        monkeypatch.setattr(MT, "RANKS", ranks)
        assert {(r["a"], r["b"]): r["rho"] for r in MT.spearman_pairs(df, list("abcd")).collect()} == pytest.approx(want)
    assert MT.spearman_pairs(df, ["a", "b"])._jdf.queryExecution().logical().toString().count("Generate") <= 1  # pairs, not rows, are exploded


def test_many_text_files_are_moved_by_their_tasks():
    import inspect
    from pitwise.catalog import io_queries
    assert "algorithm.version" in inspect.getsource(io_queries.q_textdirs)
