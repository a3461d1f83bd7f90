"""Plan tests: shuffles per family, pushdown and pruning, no Python in the hot path."""

from pitwise.catalog import pit_queries as PQ
from pitwise.plans import pit
from pitwise.sources import adapters as A


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_family_shuffles_only_the_daily_rows(spark, small_dir):
    """Windows are formed after the exchange by store; no exchange follows it, and no row is copied once per pivot."""
    ctx = PQ.context(spark, small_dir)
    for df in (pit.store_visitor_feat(ctx), pit.store_week_feat(ctx), pit.store_week_exp_feat(ctx), *pit.store_holiday_feat(ctx)):
        p = _plan(df)
        assert "Exchange hashpartitioning(end_date" not in p and "percentile" not in p
        assert p.count("REPARTITION_BY_NUM") == 1 and p.index("REPARTITION_BY_NUM") > p.index("MapInArrow")
        assert p.index("REPARTITION_BY_NUM") > p.index("Sort") and "explode" not in p[:p.index("REPARTITION_BY_NUM")].lower()
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_prunes_columns_and_pushes_filters(spark, small_dir):
    from pyspark.sql import functions as F
    from pitwise.sources.tables import table
    o = table(spark, small_dir, "orders").where(F.col("o_orderdate") >= "1998-01-01").select("o_orderkey")
    p = _plan(o)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_visits_adapter_aggregates_partially(spark, small_dir):
    p = _plan(A.visits_nation(spark, small_dir))
    assert p.count("HashAggregate") >= 2  # partial + final around one exchange


def test_no_cross_or_nested_loop_joins(spark, small_dir):
    import __spark_entry__ as E
    names = ["joins_hierarchical_fallback", "eval_submission", "sets_outer_union", "clean_median_fill",
             "encode_standard_scale", "rolling_max_minus", "text_nb_ratio", "models_forecast",
             "strings_id_split", "clean_row_backfill", "eval_tta_mean"]
    qs = E.queries()
    for n in names:
        p = _plan(qs[n](spark, small_dir))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, n


def test_no_python_in_text_and_ordering_plans(spark, small_dir):
    import __spark_entry__ as E
    for n in ("text_marked_tokens", "text_token_stream", "eval_spearman"):
        p = _plan(E.queries()[n](spark, small_dir))
        assert "Python" not in p and "Arrow" not in p and "Pandas" not in p, n


def test_profile_needs_no_expand(spark, small_dir):
    import __spark_entry__ as E
    assert "Expand" not in _plan(E.queries()["clean_profile"](spark, small_dir))


def test_label_table_is_never_shuffled_again(spark, small_dir):
    """Store families are brought to the label rows, which stay partitioned by store; genre families are looked up."""
    from pitwise.plans import pit
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ctx = PQ.context(spark, small_dir)
        fams = [(pit.store_visitor_feat(ctx), ["store_id"]), (pit.store_week_feat(ctx), ["store_id", "dow"]),
                (pit.store_holiday_feat(ctx)[0], ["store_id", "holiday_flg"]), (pit.genre_visitor_feat(ctx), ["air_genre_name"])]
        p = _plan(pit.training_set(ctx, fams))
        base = _plan(pit.labels(ctx))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    assert p.count("SortMergeJoin [end_date") == 3 and "Exchange hashpartitioning(end_date" not in p
    left = p[:p.index("MapInArrow")]  # the label side of the plan comes first
    assert left.count("Exchange hashpartitioning") <= base.count("Exchange hashpartitioning") + 1  # + that of the first family
