"""Registered join / set / cleaning queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import clean as C
from ..operators import joins as J
from ..sources import adapters as A
from ..sources.tables import table
from .canonical_sql import with_ctes
from .common import r, rounded

Q: dict = {}
SQL: dict = {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _visits(spark, sf):
    return A.visits_nation(spark, sf).select("store_id", "visit_date", "visitors")


# ------------------------------------------------------------------ joins
@reg("joins_natural_left", with_ctes("""
SELECT v.store_id, v.visit_date, v.visitors, c.day_of_week, c.holiday_flg, c.holiday_flg2
FROM visits_nation v LEFT JOIN date_info c ON v.visit_date = c.visit_date""", "visits_nation", "date_info"))
def q_natural(spark, sf):
    return J.natural_left_join(_visits(spark, sf), A.date_info(A.visits_nation(spark, sf)))


@reg("joins_left_right_chain", """
SELECT a.o_orderkey, b.custkey, n.nationkey, n.nation_name
FROM (SELECT o_orderkey, o_custkey AS custkey FROM orders) a
LEFT JOIN (SELECT c_custkey AS custkey, c_nationkey AS nationkey FROM customer) b ON a.custkey = b.custkey
RIGHT JOIN (SELECT n_nationkey AS nationkey, n_name AS nation_name FROM nation) n ON b.nationkey = n.nationkey""")
def q_chain(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"))
    c = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    return J.left_then_right(a, b, c, ["custkey"], ["nationkey"], {"n_name": "nation_name"}).select(
        "o_orderkey", "custkey", "nationkey", "nation_name")


@reg("joins_inner_id_map", with_ctes("""
SELECT o.o_orderkey, o.o_custkey, m.air_store_id FROM orders o JOIN id_relation m ON o.o_custkey = m.hpg_store_id""",
                                      "id_relation"))
def q_inner_map(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return J.map_inner(o, A.id_relation(spark, sf), "o_custkey", "hpg_store_id")


@reg("joins_lookup_fallback", with_ctes("""
SELECT o.o_orderkey, coalesce(CAST(m.air_store_id AS BIGINT), o.o_custkey) AS o_custkey
FROM orders o LEFT JOIN id_relation m ON o.o_custkey = m.hpg_store_id""", "id_relation"))
def q_fallback(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return J.map_with_fallback(o, A.id_relation(spark, sf), "o_custkey", "hpg_store_id", "air_store_id")


@reg("joins_semi", with_ctes("""
SELECT * FROM visits_customer v WHERE v.store_id IN (SELECT hpg_store_id FROM id_relation)""",
                             "visits_customer", "id_relation"))
def q_semi(spark, sf):
    ids = A.id_relation(spark, sf).select(F.col("hpg_store_id").alias("store_id"))
    return J.semi(A.visits_customer(spark, sf), ids, "store_id")


@reg("joins_anti", with_ctes("""
SELECT * FROM visits_customer v WHERE v.store_id NOT IN (SELECT hpg_store_id FROM id_relation)""",
                             "visits_customer", "id_relation"))
def q_anti(spark, sf):
    ids = A.id_relation(spark, sf).select(F.col("hpg_store_id").alias("store_id"))
    return J.anti(A.visits_customer(spark, sf), ids, "store_id")


TW_CTE = {
    "cw": """SELECT visit_date, day_of_week,
               CASE WHEN day_of_week IN ('Saturday', 'Sunday') THEN 0 ELSE holiday_flg END AS holiday_flg,
               pow(row_number() OVER (ORDER BY visit_date) / count(*) OVER (), 5) AS weight FROM date_info""",
    "tw": """SELECT v.store_id, c.day_of_week, c.holiday_flg,
               sum(c.weight * ln(1 + v.visitors)) / sum(c.weight) AS visitors
             FROM visits_nation v LEFT JOIN cw c ON v.visit_date = c.visit_date GROUP BY 1, 2, 3""",
}


@reg("joins_time_weighted_mean", with_ctes(f"""
SELECT store_id, day_of_week, holiday_flg, {r('visitors')} AS visitors FROM tw""",
                                           "visits_nation", "date_info", extra=TW_CTE))
def q_time_weighted(spark, sf):
    v = A.visits_nation(spark, sf)
    return rounded(J.time_weighted_visitors(v, A.date_info(v)))


@reg("joins_hierarchical_fallback", with_ctes(f"""
SELECT s.store_id, s.visit_date, s.day_of_week, s.holiday_flg,
       {r('coalesce(t1.visitors, t2.visitors, t3.visitors)')} AS visitors
FROM (SELECT st.store_id, d.visit_date, dayname(d.visit_date) AS day_of_week,
             CASE WHEN isodow(d.visit_date) > 5 THEN 0 ELSE CAST(day(d.visit_date) IN (1, 2, 15) AS INTEGER) END
               AS holiday_flg
      FROM stores st CROSS JOIN (SELECT CAST(unnest(generate_series(max(visit_date) + 1, max(visit_date) + 39,
                                        INTERVAL 1 DAY)) AS DATE) AS visit_date FROM visits_nation) d) s
LEFT JOIN tw t1 ON s.store_id = t1.store_id AND s.day_of_week = t1.day_of_week AND s.holiday_flg = t1.holiday_flg
LEFT JOIN (SELECT * FROM tw WHERE holiday_flg = 0) t2 ON s.store_id = t2.store_id AND s.day_of_week = t2.day_of_week
LEFT JOIN (SELECT store_id, avg(visitors) AS visitors FROM tw GROUP BY 1) t3 ON s.store_id = t3.store_id""",
                                              "visits_nation", "date_info", "stores", extra=TW_CTE))
def q_hier(spark, sf):
    v = A.visits_nation(spark, sf)
    tw = J.time_weighted_visitors(v, A.date_info(v))
    sub = A.submission(spark, sf, v)
    rows = sub.select(F.substring_index("id", "_", 1).cast("int").alias("store_id"),
                      F.to_date(F.substring_index("id", "_", -1)).alias("visit_date"))
    rows = rows.withColumns({"day_of_week": F.date_format("visit_date", "EEEE"),
                             "holiday_flg": D.demote_weekend_holiday(
                                 "visit_date", F.dayofmonth("visit_date").isin(*A.HOLIDAY_DAYS_OF_MONTH).cast("int"))})
    return rounded(J.hierarchical_fallback(rows, tw))


@reg("joins_dual_calendar", with_ctes("""
SELECT r.store_id, r.reserve_visitors, r.system, CAST(r.visit_datetime AS DATE) AS visit_date,
       CAST(r.reserve_datetime AS DATE) AS reserve_date, r.visit_datetime, r.reserve_datetime,
       c1.holiday_flg AS visit_holiday_flg, c2.holiday_flg AS reserve_holiday_flg
FROM reservations r LEFT JOIN date_info c1 ON CAST(r.visit_datetime AS DATE) = c1.visit_date
LEFT JOIN date_info c2 ON CAST(r.reserve_datetime AS DATE) = c2.visit_date""", "reservations", "date_info"))
def q_dual(spark, sf):
    return J.dual_calendar(A.reservations(spark, sf), A.date_info(A.visits_nation(spark, sf)))


@reg("joins_two_system_union", with_ctes("""
SELECT r.*, s.air_genre_name AS genre_name, s.air_area_name AS area_name, s.latitude, s.longitude,
       NULL::DOUBLE AS hpg_latitude, NULL::DOUBLE AS hpg_longitude, 'air' AS src
FROM reservations r LEFT JOIN stores s ON r.store_id = s.store_id WHERE r.system = 'air'
UNION ALL
SELECT r.*, s.air_genre_name, NULL, NULL, NULL, s.latitude, s.longitude, 'hpg'
FROM reservations r LEFT JOIN stores s ON r.store_id = s.store_id WHERE r.system = 'hpg'""", "reservations", "stores"))
def q_two_sys(spark, sf):
    return J.two_system_union(A.reservations(spark, sf), A.stores(spark, sf))


@reg("joins_last_writer_wins", with_ctes(f"""
SELECT v.store_id, v.visit_date, v.visitors AS feat_a, {r('ln(1 + v.visitors)')} AS feat_b, {r('v.sales')} AS feat_c
FROM visits_nation v""", "visits_nation"))
def q_lww(spark, sf):
    v = A.visits_nation(spark, sf)
    base = v.select("store_id", "visit_date")
    t1 = v.select("store_id", "visit_date", F.col("visitors").alias("feat_a"), F.col("visitors").alias("feat_b"))
    t2 = v.select("store_id", "visit_date", F.log1p("visitors").alias("feat_b"), F.col("sales").alias("feat_c"))
    return rounded(J.last_writer_wins(base, ["store_id", "visit_date"], t1, t2))


@reg("joins_prior_period", with_ctes("""
SELECT v.store_id, v.visit_date, v.visitors, p.visitors AS visitors_prev365
FROM visits_nation v LEFT JOIN visits_nation p ON v.store_id = p.store_id AND p.visit_date + 365 = v.visit_date""",
                                      "visits_nation"))
def q_prior(spark, sf):
    return J.prior_period(_visits(spark, sf))


@reg("joins_weekday_grid", with_ctes(f"""
SELECT g.store_id, g.dow, s.min_visitors, {r('s.mean_visitors')} AS mean_visitors,
       {r('s.median_visitors')} AS median_visitors, s.max_visitors, s.count_observations
FROM (SELECT DISTINCT c.c_nationkey AS store_id, d.dow FROM customer c, range(0, 7) d(dow)) g0
JOIN (SELECT store_id, CAST(dow AS INTEGER) AS dow FROM (SELECT DISTINCT c_nationkey AS store_id FROM customer),
      range(0, 7) t(dow)) g ON g0.store_id = g.store_id AND g0.dow = g.dow
LEFT JOIN (SELECT store_id, CAST(isodow(visit_date) - 1 AS INTEGER) AS dow, min(visitors) AS min_visitors,
                  avg(visitors) AS mean_visitors, median(visitors) AS median_visitors, max(visitors) AS max_visitors,
                  count(*) AS count_observations
           FROM visits_nation GROUP BY 1, 2) s ON g.store_id = s.store_id AND g.dow = s.dow""", "visits_nation"))
def q_grid(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_nationkey").alias("store_id")).distinct()
    return rounded(J.store_weekday_grid(ids, J.weekday_summary(_visits(spark, sf))))


@reg("joins_group_mean_default", with_ctes(f"""
SELECT store_id, visit_date, {r('visitors')} AS visitors FROM (
  SELECT store_id, visit_date, CAST(visitors AS DOUBLE) AS visitors FROM visits_nation
  UNION ALL
  SELECT s.store_id, s.visit_date, m.visitors FROM
    (SELECT CAST(split_part(id, '_', 1) AS INTEGER) AS store_id, CAST(split_part(id, '_', 2) AS DATE) AS visit_date
     FROM submission) s
  JOIN (SELECT store_id, avg(visitors) AS visitors FROM visits_nation GROUP BY 1) m ON s.store_id = m.store_id)""",
                                            "visits_nation", "submission"))
def q_gmd(spark, sf):
    v = A.visits_nation(spark, sf)
    hist = v.select("store_id", "visit_date", F.col("visitors").cast("double").alias("visitors"))
    sub = A.submission(spark, sf, v).select(F.substring_index("id", "_", 1).cast("int").alias("store_id"),
                                            F.to_date(F.substring_index("id", "_", -1)).alias("visit_date"))
    return rounded(J.group_mean_default(hist, sub, "store_id", "visitors"))


RSM = """SELECT store_id, CAST(visit_datetime AS DATE) AS visit_date, system,
  CAST(sum(CAST(visit_datetime AS DATE) - CAST(reserve_datetime AS DATE)) AS BIGINT) AS rs1,
  CAST(sum(reserve_visitors) AS BIGINT) AS rv1,
  avg(CAST(visit_datetime AS DATE) - CAST(reserve_datetime AS DATE)) AS rs2, avg(reserve_visitors) AS rv2
FROM reservations GROUP BY 1, 2, 3"""


@reg("joins_reserve_sum_mean", with_ctes(f"""
SELECT store_id, visit_date, system, rs1, rv1, {r('rs2')} AS rs2, {r('rv2')} AS rv2 FROM ({RSM})""", "reservations"))
def q_rsm(spark, sf):
    return rounded(J.reserve_sum_mean(A.reservations(spark, sf)))


@reg("joins_cross_system_totals", with_ctes(f"""
SELECT coalesce(x.store_id, y.store_id) AS store_id, coalesce(x.visit_date, y.visit_date) AS visit_date,
       x.rv1 + y.rv1 AS total_reserv_sum, {r('(x.rv2 + y.rv2) / 2')} AS total_reserv_mean,
       {r('(x.rs2 + y.rs2) / 2')} AS total_reserv_dt_diff_mean
FROM (SELECT * FROM ({RSM}) WHERE system = 'air') x
FULL JOIN (SELECT * FROM ({RSM}) WHERE system = 'hpg') y ON x.store_id = y.store_id AND x.visit_date = y.visit_date""",
                                           "reservations"))
def q_cst(spark, sf):
    return rounded(J.cross_system_totals(J.reserve_sum_mean(A.reservations(spark, sf))))


@reg("joins_attr_static", with_ctes(f"""
SELECT s.*, a.min_visits_in_air_genre_name, a.max_visits_in_air_genre_name,
       {r('a.mean_visits_in_air_genre_name')} AS mean_visits_in_air_genre_name,
       {r('a.std_visits_in_air_genre_name')} AS std_visits_in_air_genre_name,
       {r('a.median_visits_in_air_genre_name')} AS median_visits_in_air_genre_name
FROM stores s LEFT JOIN (
  SELECT s2.air_genre_name, CAST(min(v.visitors) AS DOUBLE) AS min_visits_in_air_genre_name,
         CAST(max(v.visitors) AS DOUBLE) AS max_visits_in_air_genre_name,
         avg(v.visitors) AS mean_visits_in_air_genre_name, stddev_samp(v.visitors) AS std_visits_in_air_genre_name,
         median(v.visitors) AS median_visits_in_air_genre_name
  FROM visits_nation v JOIN stores s2 ON v.store_id = s2.store_id WHERE s2.air_genre_name IS NOT NULL GROUP BY 1
) a ON s.air_genre_name = a.air_genre_name""", "visits_nation", "stores"))
def q_attr(spark, sf):
    st = A.stores(spark, sf)
    src = _visits(spark, sf).join(st.select("store_id", "air_genre_name"), "store_id")
    return rounded(J.attr_static(st, src, "air_genre_name"))


@reg("joins_population_count", with_ctes("""
SELECT c.*, n.stores_in_area FROM customers_as_stores c
LEFT JOIN (SELECT area, count(store_id) AS stores_in_area FROM customers_as_stores WHERE area IS NOT NULL GROUP BY 1) n
ON c.area = n.area""", "customers_as_stores"))
def q_pop(spark, sf):
    return J.population_count(A.customers_as_stores(spark, sf), "area")


# ------------------------------------------------------------------ set operations
@reg("sets_outer_union", with_ctes("""
SELECT store_id, visit_date, visitors, NULL::VARCHAR AS id FROM visits_nation
UNION ALL
SELECT CAST(split_part(id, '_', 1) AS INTEGER), CAST(split_part(id, '_', 2) AS DATE), NULL::BIGINT, id
FROM submission""", "visits_nation", "submission"))
def q_outer_union(spark, sf):
    v = A.visits_nation(spark, sf)
    sub = A.submission(spark, sf, v).select(
        "id", F.substring_index("id", "_", 1).cast("int").alias("store_id"),
        F.to_date(F.substring_index("id", "_", -1)).alias("visit_date"))
    return J.outer_union(v.select("store_id", "visit_date", "visitors"), sub)


@reg("sets_union_frames", """
SELECT o_orderkey, o_orderdate, 'early' AS part FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'
UNION ALL SELECT o_orderkey, o_orderdate, 'late' FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'""")
def q_union_frames(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return J.outer_union(o.where(F.col("o_orderdate") < "1997-01-01").withColumn("part", F.lit("early")),
                         o.where(F.col("o_orderdate") >= "1997-01-01").withColumn("part", F.lit("late")))


@reg("sets_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def q_distinct(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()


@reg("sets_except", """SELECT c_custkey AS store_id FROM customer
EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'""")
def q_except(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("store_id"))
    o = (table(spark, sf, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
         .select(F.col("o_custkey").alias("store_id")))
    return c.subtract(o)


QUOTAS = {"train": 44, "pseudo": 16, "valid": 4}


def _quota_sources(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return {"train": e.where(F.col("label") <= 6), "pseudo": e.where(F.col("label").between(7, 8)),
            "valid": e.where(F.col("label") == 9)}


@reg("sets_quota_mix", """
WITH t AS (
  SELECT vec_id, label, CASE WHEN label <= 6 THEN 'train' WHEN label <= 8 THEN 'pseudo' ELSE 'valid' END AS src
  FROM embeddings),
rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY vec_id) AS rn FROM t),
b AS (SELECT *, CAST(floor((rn - 1) / CASE src WHEN 'train' THEN 44 WHEN 'pseudo' THEN 16 ELSE 4 END) AS BIGINT)
                AS batch FROM rk),
full_b AS (SELECT batch FROM (SELECT src, batch, count(*) AS n FROM b GROUP BY 1, 2)
           WHERE n = CASE src WHEN 'train' THEN 44 WHEN 'pseudo' THEN 16 ELSE 4 END
           GROUP BY batch HAVING count(*) = 3)
SELECT b.batch, b.vec_id, b.label, b.src, b.rn FROM b WHERE batch IN (SELECT batch FROM full_b)""")
def q_quota(spark, sf):
    return J.quota_mix(_quota_sources(spark, sf), QUOTAS, "vec_id").select("batch", "vec_id", "label", "src", "rn")


# ------------------------------------------------------------------ cleaning
CLIN_COLS = ["_id", "BE_PRIORITY", "BE_STATUS", "BE_CUSTKEY", "BE_FLAG", "TRANS_RBC", "AF_PRICE_K", "dt_data",
             "DEPT_CODE", "RBC_LOSS", "OP_CODE"]


@reg("clean_drop_if_present", with_ctes(
    "SELECT * EXCLUDE (DEPT_CODE, RBC_LOSS) FROM clinical", "clinical"))
def q_drop(spark, sf):
    return C.drop_if_present(A.clinical(spark, sf), ["DEPT_CODE", "NOT_A_COLUMN", "RBC_LOSS"])


@reg("clean_split_targets", with_ctes("SELECT AF_PRICE_K, _id, TRANS_RBC, RBC_LOSS FROM clinical", "clinical"))
def q_split_y(spark, sf):
    return C.split_by_prefix(A.clinical(spark, sf))[0]


@reg("clean_split_features", with_ctes(
    "SELECT BE_PRIORITY, BE_STATUS, BE_CUSTKEY, BE_FLAG, _id, DEPT_CODE, OP_CODE, TRANS_RBC FROM clinical", "clinical"))
def q_split_x(spark, sf):
    return C.split_by_prefix(A.clinical(spark, sf))[1]


@reg("clean_soft_delete", """
SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderkey % 11 = 0 AS INTEGER) = 0""")
def q_soft(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey",
                                          (F.col("o_orderkey") % 11 == 0).cast("int").alias("is_delete"))
    return C.soft_delete_filter(o)


@reg("clean_target_present", with_ctes("SELECT * FROM clinical WHERE TRANS_RBC IS NOT NULL", "clinical"))
def q_target(spark, sf):
    return C.target_present(A.clinical(spark, sf), "TRANS_RBC")


@reg("clean_drop_constant", with_ctes("SELECT * EXCLUDE (DEPT_CODE, RBC_LOSS) FROM clinical", "clinical"))
def q_const(spark, sf):
    return C.drop_constant(A.clinical(spark, sf))


@reg("clean_drop_all_null", with_ctes("SELECT * EXCLUDE (RBC_LOSS) FROM clinical", "clinical"))
def q_allnull(spark, sf):
    return C.drop_all_null(A.clinical(spark, sf))


@reg("clean_substring_flag", """
SELECT doc_id, CAST(contains(text, ' the ') AS INTEGER) AS has_the FROM documents""")
def q_substr(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.substring_flag("text", " the ").alias("has_the"))


@reg("clean_date_slice", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-10' AND DATE '1997-08-31'""")
def q_slice(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return C.date_slice(o, "o_orderdate", "1996-01-10", "1997-08-31")


@reg("clean_binary_target", with_ctes(
    "SELECT _id, CAST(TRANS_RBC > 150000 AS INTEGER) AS y FROM clinical", "clinical"))
def q_bin(spark, sf):
    return A.clinical(spark, sf).select("_id", C.binary_target("TRANS_RBC", 150000).alias("y"))


def _profile_sql():
    kinds = {"_id": "numeric", "BE_PRIORITY": "categorical", "BE_STATUS": "categorical", "BE_CUSTKEY": "numeric",
             "BE_FLAG": "bool", "TRANS_RBC": "numeric", "AF_PRICE_K": "numeric", "dt_data": "numeric",
             "DEPT_CODE": "categorical", "RBC_LOSS": "numeric", "OP_CODE": "numeric"}
    parts = []
    for c, k in kinds.items():
        parts.append(f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constant' ELSE '{k}' END
          AS kind, count(*) AS n_rows, count({c}) AS n_non_null, count(DISTINCT {c}) AS n_distinct,
          count(*) - count({c}) AS n_missing FROM clinical""")
    return with_ctes("\nUNION ALL\n".join(parts), "clinical")


@reg("clean_profile", _profile_sql())
def q_profile(spark, sf):
    return C.profile(A.clinical(spark, sf))


@reg("clean_distinct_spans", with_ctes("""
SELECT count(DISTINCT store_id) AS n_store_id, count(DISTINCT visit_date) AS n_visit_date,
       CAST(max(visit_date) - min(visit_date) AS INTEGER) AS span_days FROM visits_customer""", "visits_customer"))
def q_spans(spark, sf):
    return C.distinct_spans(A.visits_customer(spark, sf), "store_id", "visit_date")


@reg("clean_value_counts", "SELECT lang, count(*) AS count FROM documents GROUP BY lang")
def q_vc(spark, sf):
    return C.value_counts(table(spark, sf, "documents"), "lang")


@reg("clean_group_means", with_ctes(f"""
SELECT quality, {r('avg(n_chars)')} AS n_chars, {r('avg(toxic)')} AS toxic
FROM texts WHERE quality IS NOT NULL GROUP BY quality""", "texts"))
def q_gm(spark, sf):
    return rounded(C.group_means(A.texts(spark, sf), "quality", ["n_chars", "toxic"]))


@reg("clean_relative_spread", with_ctes(f"""
SELECT store_id, {r('stddev_samp(actual)')} AS pred_std, {r('avg(pred_a)')} AS pred,
       {r('stddev_samp(actual) / avg(pred_a)')} AS rel_spread FROM regressions GROUP BY store_id""", "regressions"))
def q_spread(spark, sf):
    g = A.regressions(spark, sf).groupBy("store_id").agg(F.stddev_samp("actual").alias("pred_std"),
                                                         F.avg("pred_a").alias("pred"))
    return rounded(C.relative_spread(g, "pred_std", "pred"))


@reg("clean_error_by_entity", with_ctes(f"""
SELECT store_id, {r('avg(abs(pred_a - actual))')} AS mean_abs_err,
       {r('avg(CASE WHEN actual = 0 THEN NULL ELSE (pred_a - actual) / actual END)')} AS mean_rel_err
FROM regressions GROUP BY store_id HAVING avg(abs(pred_a - actual)) BETWEEN 0.1 AND 0.5""", "regressions"))
def q_err(spark, sf):
    return rounded(C.error_by_entity(A.regressions(spark, sf), "store_id", "actual", "pred_a", 0.1, 0.5))


@reg("clean_log_scale", with_ctes(f"""
SELECT store_id, visit_date, visitors, {r('ln(1 + visitors) / max(ln(1 + visitors)) OVER ()')} AS y_scaled,
       {r('max(ln(1 + visitors)) OVER ()')} AS max_log,
       {r('exp(ln(1 + visitors) / max(ln(1 + visitors)) OVER () * max(ln(1 + visitors)) OVER ())')} AS y_back
FROM visits_nation""", "visits_nation"))
def q_logscale(spark, sf):
    d = C.log_scale(_visits(spark, sf), "visitors")
    return rounded(d.withColumn("y_back", C.unscale_log(F.col("y_scaled"), F.col("max_log"))))


@reg("clean_clip_renormalise", with_ctes(f"""
SELECT user_id, list_transform(c, lambda x: {r('x / list_sum(c)')}) AS p_clip FROM (
  SELECT user_id, list_transform(p, lambda x: least(greatest(x, 0.25), 0.75)) AS c FROM class_probs)""", "class_probs"))
def q_clip(spark, sf):
    cp = A.class_probs(spark, sf)
    return cp.select("user_id", F.transform(C.clip_renormalise("p", 0.75), lambda x: F.round(x, 6)).alias("p_clip"))


@reg("clean_clip_lower", with_ctes(f"""
SELECT id, {r('greatest(pred_a - 1.0, 0.0)')} AS pred_clipped FROM regressions""", "regressions"))
def q_cliplow(spark, sf):
    return rounded(A.regressions(spark, sf).select("id", C.clip_lower(F.col("pred_a") - 1.0).alias("pred_clipped")))


@reg("clean_scale_by_max", f"""
SELECT o_orderkey, {r('o_totalprice / max(o_totalprice) OVER ()')} AS o_totalprice_scaled,
       {r('CAST(epoch(o_orderdate) AS DOUBLE) / max(CAST(epoch(o_orderdate) AS DOUBLE)) OVER ()')} AS epoch_scaled
FROM orders""")
def q_scale_max(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice",
                                          F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
                                          .alias("epoch"))
    return rounded(C.scale_by_max(o, ["o_totalprice", "epoch"]).select("o_orderkey", "o_totalprice_scaled",
                                                                       "epoch_scaled"))


@reg("clean_fill_by_role", with_ctes("""
SELECT _id, coalesce(TRANS_RBC, -999) AS TRANS_RBC, coalesce(OP_CODE, -999) AS OP_CODE,
       coalesce(BE_PRIORITY, '_NAN') AS BE_PRIORITY, coalesce(BE_STATUS, '_NAN') AS BE_STATUS FROM clinical""",
                                     "clinical"))
def q_fill(spark, sf):
    c = A.clinical(spark, sf).select("_id", "TRANS_RBC", "OP_CODE", "BE_PRIORITY", "BE_STATUS")
    return C.fill_by_role(c, ["TRANS_RBC", "OP_CODE"], ["BE_PRIORITY", "BE_STATUS"])


W_COLS = ["avg_temperature", "hours_sunlight", "solar_radiation", "total_snowfall", "avg_humidity"]


@reg("clean_row_backfill", with_ctes(f"""
SELECT visit_date, store_id, {', '.join(f'coalesce({", ".join(W_COLS[i:])}) AS {c}' for i, c in enumerate(W_COLS))}
FROM weather""", "weather"))
def q_backfill(spark, sf):
    return C.row_backfill(A.weather(spark, sf), W_COLS)


@reg("clean_median_fill", with_ctes(f"""
SELECT _id, TRANS_RBC IS NULL AS TRANS_RBC_na, OP_CODE IS NULL AS OP_CODE_na,
       {r('coalesce(TRANS_RBC, m1)')} AS TRANS_RBC, {r('coalesce(CAST(OP_CODE AS DOUBLE), m2)')} AS OP_CODE
FROM clinical t,
     (SELECT median(TRANS_RBC) AS m1, median(OP_CODE) AS m2 FROM clinical WHERE _id % 5 <> 0) m""", "clinical"))
def q_median_fill(spark, sf):
    c = A.clinical(spark, sf).select("_id", "TRANS_RBC", "OP_CODE")
    med = C.fit_medians(c.where(F.col("_id") % 5 != 0), ["TRANS_RBC", "OP_CODE"])
    return rounded(C.apply_median_fill(c, med, ["TRANS_RBC", "OP_CODE"]))


QUERIES = Q


def oracle() -> dict[str, str]:
    return dict(SQL)
