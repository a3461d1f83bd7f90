"""Property tests: leakage, split coverage, join cardinality, driver-free numbering."""

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitwise.catalog import pit_queries as PQ
from pitwise.operators import split as SP
from pitwise.operators.ordering import global_prefix_sum, global_row_number
from pitwise.plans import pit
from pitwise.sources import adapters as A


def test_history_never_reaches_the_pivot(spark, small_dir):
    ctx = PQ.context(spark, small_dir)
    h = ctx.history(1000)
    bad = h.where((F.col("visit_date") >= F.col("end_date")) | (F.col("age") < 1) | (F.col("age") > 999)).count()
    assert bad == 0


def test_label_join_keeps_every_label_row(spark, small_dir):
    ctx = PQ.context(spark, small_dir)
    lab = pit.labels(ctx)
    n = lab.count()
    assert pit.attach(lab, pit.store_visitor_feat(ctx), ["store_id"]).count() == n
    assert pit.attach(lab, pit.store_week_feat(ctx), ["store_id", "dow"]).count() == n


def test_windows_follow_the_grid(spark, small_dir):
    w = PQ.context(spark, small_dir).windows.toPandas()
    before = w[w.days_in_label == PQ.LABEL_DAYS].end_date.sort_values()
    assert (before.diff().dropna().map(lambda x: x.days) == PQ.STEP).all()
    after = w[w.end_date > pd.Timestamp(PQ.PIVOT_DATE).date()]
    assert list(after.sort_values("end_date").days_in_label) == [35, 28, 21, 14, 7, 0]


def test_ordered_split_disjoint_and_covering(spark, small_dir):
    v = A.visits_nation(spark, small_dir).select("store_id", "visit_date")
    s = SP.ordered_group_split(v, ["store_id"], ["visit_date"]).toPandas()
    assert len(s) == v.count()
    for _, g in s.groupby("store_id"):
        g = g.sort_values("visit_date")
        k = int(len(g) * 0.9)
        assert list(g.type) == [0] * k + [1] * (len(g) - k)


def test_kfold_folds_partition_the_rows(spark, small_dir):
    from pitwise.sources.tables import table
    d = table(spark, small_dir, "documents").select("doc_id")
    n = d.count()
    seen = []
    for k in range(5):
        f = SP.kfold(d, "doc_id", k, 0.2).where("is_valid").toPandas()
        seen += list(f.doc_id)
    assert len(seen) == len(set(seen)) and len(seen) == 5 * (n // 5)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50)), min_size=1, max_size=60))
def test_global_row_number_matches_pandas(spark, rows):
    pdf = pd.DataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], columns=["g", "v", "i"])
    df = spark.createDataFrame(pdf)
    got = global_row_number(df, ["v", "i"], ["g"], num_partitions=3).toPandas().sort_values("i")
    exp = pdf.sort_values(["g", "v", "i"]).assign(rn=lambda x: x.groupby("g").cumcount() + 1).sort_values("i")
    assert list(got.rn) == list(exp.rn)
    ps = global_prefix_sum(df, ["v", "i"], "v", ["g"], num_partitions=3).toPandas().sort_values("i")
    e2 = pdf.sort_values(["g", "v", "i"])
    e2 = e2.assign(offset=e2.groupby("g").v.cumsum() - e2.v).sort_values("i")
    assert list(ps.offset) == list(e2.offset)
