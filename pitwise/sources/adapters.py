"""Canonical inputs built from the driver tables (FIXTURES.md part 2).

Each function is a lazy Spark plan over the Parquet tables; nothing passes
through the driver.  The DuckDB twins live in `pitwise.catalog.canonical_sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

# Fixed values of the canonical inputs (must match the oracle SQL twins).
HOLIDAY_DAYS_OF_MONTH = (1, 2, 15)
SUBMISSION_DAYS = 39
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def visits_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per (nation, day): store_id int, visit_date date, visitors bigint, sales double."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .groupBy(F.col("c_nationkey").alias("store_id"),
                     F.to_date("o_orderdate").alias("visit_date"))
            .agg(F.count(F.lit(1)).alias("visitors"),
                 F.sum("o_totalprice").alias("sales")))


def visits_customer(spark: SparkSession, sf_dir: str, rows_per_task: int | None = None) -> DataFrame:
    """Orders per (customer, day): the high-cardinality store set that grows with the data.

    With `rows_per_task` they come partitioned by customer, in tasks of about so many orders (at least the session's number of
    shuffle partitions), by the only exchange that they need."""
    o = table(spark, sf_dir, "orders")
    if rows_per_task:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), o.count() // rows_per_task)
        o = o.select("o_custkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice").repartition(parts, "o_custkey")
    return (o.groupBy(F.col("o_custkey").alias("store_id"),
                      F.to_date("o_orderdate").alias("visit_date"))
            .agg(F.count(F.lit(1)).alias("visitors"),
                 F.sum("o_totalprice").alias("sales")))


def visits_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per (user, day)."""
    e = table(spark, sf_dir, "events")
    return (e.groupBy(F.col("user_id").alias("store_id"), F.to_date("ts").alias("visit_date"))
            .agg(F.count(F.lit(1)).alias("visitors"), F.sum("value").alias("value_sum")))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as stores: genre = most common market segment (ties by name)."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    seg = (table(spark, sf_dir, "customer")
           .groupBy("c_nationkey", "c_mktsegment").count())
    # min over (-count, name) picks the most common segment, ties by name.
    genre = (seg.groupBy("c_nationkey")
             .agg(F.min(F.struct((-F.col("count")).alias("k"), F.col("c_mktsegment").alias("g")))
                  .getField("g").alias("air_genre_name")))
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .join(genre, n.n_nationkey == genre.c_nationkey, "left")
            .select(F.col("n_nationkey").alias("store_id"), "air_genre_name",
                    F.concat_ws(" ", "r_name", "n_name").alias("air_area_name"),
                    F.col("r_regionkey").cast("double").alias("latitude"),
                    F.col("n_nationkey").cast("double").alias("longitude")))


def customers_as_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("store_id"), F.col("c_mktsegment").alias("genre"),
                    F.col("c_nationkey").alias("area"))


def date_info(visits: DataFrame) -> DataFrame:
    """Calendar over the visit span: visit_date, day_of_week, holiday_flg (+ holiday_flg2, O96)."""
    span = visits.agg(F.min("visit_date").alias("d0"), F.max("visit_date").alias("d1"))
    cal = span.select(F.explode(F.sequence("d0", "d1")).alias("visit_date"))
    return cal.select(
        "visit_date",
        F.date_format("visit_date", "EEEE").alias("day_of_week"),
        F.dayofmonth("visit_date").isin(*HOLIDAY_DAYS_OF_MONTH).cast("int").alias("holiday_flg"),
        ((F.weekday("visit_date") > 4) | F.dayofmonth("visit_date").isin(*HOLIDAY_DAYS_OF_MONTH))
        .cast("int").alias("holiday_flg2"))


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders x their lines shipped on/after the order date, tagged by system."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .where(F.col("l_shipdate") >= F.col("o_orderdate"))
         .join(c, F.col("o_custkey") == F.col("c_custkey")))
    return j.select(F.col("c_nationkey").alias("store_id"),
                    F.col("o_orderdate").alias("reserve_datetime"),
                    F.col("l_shipdate").alias("visit_datetime"),
                    F.col("l_quantity").cast("int").alias("reserve_visitors"),
                    F.when(F.col("l_returnflag") == "A", "air").otherwise("hpg").alias("system"))


def id_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return (c.where(F.col("c_custkey") % 2 == 0)
            .select(F.col("c_custkey").alias("hpg_store_id"), F.col("c_nationkey").alias("air_store_id")))


def submission(spark: SparkSession, sf_dir: str, visits: DataFrame | None = None) -> DataFrame:
    """Every store x the 39 days after the last visit; id = store_date, visitors 0."""
    visits = visits if visits is not None else visits_nation(spark, sf_dir)
    last = visits.agg(F.max("visit_date")).scalar()
    st = stores(spark, sf_dir).select("store_id")
    # a 39-day generator per store row (no join)
    return (st.select("store_id", F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, SUBMISSION_DAYS)))
                      .alias("visit_date"))
            .select(F.concat_ws("_", F.col("store_id").cast("string"),
                                F.date_format("visit_date", "yyyy-MM-dd")).alias("id"),
                    F.lit(0).alias("visitors")))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar x stores with arithmetic measures; null where day number mod 7 = 3."""
    v = visits_nation(spark, sf_dir)
    span = v.agg(F.min("visit_date"), F.max("visit_date"))
    st = stores(spark, sf_dir).select("store_id")
    dn = F.datediff("visit_date", F.lit("1970-01-01").cast("date"))
    hole = (dn % 7) == 3
    # calendar generator per store row: the same grid as calendar x stores, without a join
    g = st.select("store_id", F.explode(F.sequence(span.select(span.columns[0]).scalar(),
                                                   span.select(span.columns[1]).scalar())).alias("visit_date"))
    return g.select(
        "visit_date", "store_id",
        F.when(hole, None).otherwise((dn % 30).cast("double") + F.col("store_id") * 0.5).alias("avg_temperature"),
        F.when(hole, None).otherwise(((dn + F.col("store_id")) % 12).cast("double")).alias("hours_sunlight"),
        ((dn % 17).cast("double") * 1.5).alias("solar_radiation"),
        F.when(hole, None).otherwise(((dn % 5) * F.col("store_id")).cast("double")).alias("total_snowfall"),
        (((dn * 7 + F.col("store_id")) % 100).cast("double")).alias("avg_humidity"))


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide mixed-type record table built from orders (the clinical ETL input)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("_id"),
        F.col("o_orderpriority").alias("BE_PRIORITY"),
        F.col("o_orderstatus").alias("BE_STATUS"),
        F.col("o_custkey").alias("BE_CUSTKEY"),
        (F.col("o_custkey") % 7 == 0).alias("BE_FLAG"),
        F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.col("o_totalprice")).alias("TRANS_RBC"),
        (F.col("o_totalprice") / 1000.0).alias("AF_PRICE_K"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("dt_data"),
        F.lit("CONST").alias("DEPT_CODE"),
        F.lit(None).cast("double").alias("RBC_LOSS"),
        F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderkey") % 13).alias("OP_CODE"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars",
                                                 "quality", "toxic")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id"), F.col("embedding"), F.col("label"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order a file with an array of boxes (height=qty, width=line number)."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_orderkey")
            # sorted: a file's boxes are a bounded group, and sorting makes the order reproducible
            .agg(F.array_sort(F.collect_list(F.struct(F.col("l_quantity").alias("height"),
                                                      F.col("l_linenumber").cast("double").alias("width"),
                                                      (F.col("l_discount") * 100).alias("x"),
                                                      (F.col("l_tax") * 100).alias("y")))).alias("annotations"))
            .select(F.concat(F.lit("img/"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("filename"),
                    "annotations"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as image shapes: type 1 circle, 2 rectangle, 4 polygon, 3 unknown."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    st = F.when(k % 4 == 0, 1).when(k % 4 == 1, 2).when(k % 4 == 2, 4).otherwise(3)
    a = (k % 97).cast("string")
    b = (k % 53).cast("string")
    s = F.col("p_size").cast("string")
    desc = (F.when(st.isin(1, 2), F.concat_ws(" ", a, b, s, (F.col("p_size") + 3).cast("string")))
            .when(st == 4, F.concat_ws(" ", F.concat_ws(",", a, b), F.concat_ws(",", b, s),
                                        F.concat_ws(",", s, a)))
            .otherwise(F.lit("?")))
    return p.select(k.alias("image_id"), st.alias("shape_type"), desc.alias("shape_desc"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .groupBy(F.col("o_custkey").alias("user"), (F.col("l_partkey") % 200).alias("item"))
            .agg(F.avg("l_quantity").alias("rating")))


def class_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: share of each event type (sorted type order) and the most common type index."""
    e = table(spark, sf_dir, "events")
    counts = e.groupBy("user_id").agg(
        *[F.count(F.when(F.col("event_type") == t, 1)).alias(f"n{i}") for i, t in enumerate(EVENT_TYPES)],
        F.count(F.lit(1)).alias("n"))
    p = F.array(*[(F.col(f"n{i}") / F.col("n")).alias(f"p{i}") for i in range(len(EVENT_TYPES))])
    # argmax with ties to the first (name order): max over (count, -index)
    best = F.greatest(*[F.struct(F.col(f"n{i}").alias("c"), F.lit(-i).alias("ni")) for i in range(len(EVENT_TYPES))])
    return counts.select("user_id", p.alias("p"), (-best.getField("ni")).alias("actual"))


def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """visits_nation with weekday-mean (pred_a) and store-mean (pred_b) predictions of log1p visitors."""
    v = visits_nation(spark, sf_dir)
    y = F.log1p("visitors")
    w_dow = Window.partitionBy("store_id", F.weekday("visit_date"))
    w_st = Window.partitionBy("store_id")
    return v.select(
        F.concat_ws("_", F.col("store_id").cast("string"), F.date_format("visit_date", "yyyy-MM-dd")).alias("id"),
        "store_id", "visit_date",
        y.alias("actual"), F.avg(y).over(w_dow).alias("pred_a"), F.avg(y).over(w_st).alias("pred_b"))
