"""The fused full training set agrees with the separately oracle-checked families."""

from pyspark.sql import functions as F

from pitwise.catalog import pit_queries as PQ
from pitwise.plans import pit
from pitwise.sources import adapters as A


def test_full_set_rows_and_fused_values(spark, small_dir):
    ctx = PQ.context(spark, small_dir)
    full = pit.full_training_set(ctx, A.reservations(spark, small_dir)).cache()
    labels = pit.labels(ctx)
    assert full.count() == labels.count()
    assert len(full.columns) == len(set(full.columns))
    keys = ["end_date", "store_id", "visit_date"]
    sep = pit.attach(labels.select(*keys, "dow"), pit.store_week_diff_feat(ctx), ["store_id"])
    sep = pit.attach(sep, pit.store_week_exp_feat(ctx), ["store_id", "dow"])
    sep = pit.attach(sep, pit.store_all_week_feat(ctx), ["store_id"])
    cols = ["store_diff_mean58", "store_diff_std1000", "store_dow_exp_mean21000_0p9", "3store_dow_median1000",
            "5store_dow_count1000", "2dow", "6store_dow_sum1000"]
    j = full.select(*keys, *[F.col(f"`{c}`").alias("f_" + c) for c in cols]).join(
        sep.select(*keys, *[F.col(f"`{c}`") for c in cols]), keys)
    bad = j.where(" OR ".join(f"abs(`f_{c}` - `{c}`) > 1e-9" for c in cols)).count()
    assert j.count() == full.count() and bad == 0
