"""Registered model queries: rows-only for fitted learners, DuckDB twins where the math is SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as EN
from ..operators import models as MD
from ..operators import split as SP
from ..session import staged
from ..sources import adapters as A
from ..sources.tables import table
from .canonical_sql import with_ctes
from .common import r, rounded

Q: dict = {}
SQL: dict = {}

FEATURES = ["store_f", "dow", "month", "pred_a", "pred_b", "t"]
SPLIT_DATE = "2000-06-01"


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def model_table(spark, sf):
    g = A.regressions(spark, sf)
    return g.select("id", "visit_date", F.col("store_id").cast("double").alias("store_f"),
                    F.weekday("visit_date").cast("double").alias("dow"),
                    F.month("visit_date").cast("double").alias("month"), "pred_a", "pred_b",
                    F.datediff("visit_date", F.lit("1970-01-01").cast("date")).cast("double").alias("t"),
                    F.col("actual").alias("label"))


def _split(spark, sf):
    m = model_table(spark, sf)
    return m.where(F.col("visit_date") < SPLIT_DATE), m.where(F.col("visit_date") >= SPLIT_DATE)


@reg("models_rf_predict")
def q_rf(spark, sf):
    tr, va = _split(spark, sf)
    _, p = MD.fit_predict(MD.rf_regressor(num_trees=30), tr, va, FEATURES)
    return p.select("id", "label", "prediction")


@reg("models_gbt_predict")
def q_gbt(spark, sf):
    tr, va = _split(spark, sf)
    _, p = MD.fit_predict(MD.gbt_regressor(max_iter=20), tr, va, FEATURES)
    return p.select("id", "label", "prediction")


@reg("models_linear_one", with_ctes(f"""
SELECT {r('regr_slope(actual, pred_a)')} AS slope, {r('regr_intercept(actual, pred_a)')} AS intercept,
       {r('regr_r2(actual, pred_a)')} AS r2, count(*) AS n FROM regressions""", "regressions"))
def q_lin1(spark, sf):
    return rounded(MD.linear_one(A.regressions(spark, sf), "actual", "pred_a"))


@reg("models_linear_multi")
def q_linm(spark, sf):
    tr, va = _split(spark, sf)
    _, p = MD.linear_multi(tr, va, FEATURES)
    return p.select("id", "label", "prediction")


def _knn_split(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    f = SP.kfold(e, "vec_id", 0, 0.2)
    return f.where("is_valid").drop("is_valid"), f.where(~F.col("is_valid")).drop("is_valid")


@reg("models_knn", """
WITH rk AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) AS rn,
                   floor(count(*) OVER () * 0.2) AS nv FROM embeddings),
q AS (SELECT e.vec_id, e.embedding FROM embeddings e JOIN rk USING (vec_id) WHERE rn <= nv),
t AS (SELECT e.vec_id, e.embedding, e.label FROM embeddings e JOIN rk USING (vec_id) WHERE rn > nv),
d AS (SELECT q.vec_id, t.vec_id AS tid, t.label,
             list_sum(list_transform(list_zip(q.embedding, t.embedding),
                      lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))) AS dist FROM q, t)
SELECT vec_id, avg(label) AS knn_pred FROM (
  SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY dist, tid) AS k FROM d) WHERE k <= 4
GROUP BY vec_id""")
def q_knn(spark, sf):
    qd, tr = _knn_split(spark, sf)
    return MD.knn_regress(qd, tr, "vec_id", "embedding", "label", 4)


@reg("models_als")
def q_als(spark, sf):
    ra = staged(A.ratings(spark, sf))
    users = EN.fit_dictionary(ra, "user")
    ra = staged(ra.join(users.withColumnRenamed("code", "uid"), "user").select(
        F.col("uid").cast("int"), F.col("item").cast("int"), "rating"))  # the fits read it many times
    # every rating is scored by a model that hasn't seen it: two halves by a hash of the pair, each scored by the other's
    half = F.pmod(F.xxhash64("uid", "item"), F.lit(2))
    parts = [ra.where(half == i) for i in (0, 1)]
    scored = [MD.als_fit_predict(parts[1 - i], "uid", "item", "rating", max_iter=5, scored=parts[i])[1] for i in (0, 1)]
    return scored[0].unionByName(scored[1])


FC_CTES = {
    "h": """SELECT v.store_id, v.visit_date, CAST(v.visit_date - DATE '1970-01-01' AS DOUBLE) AS t,
              ln(1 + v.visitors) AS y, CAST(isodow(v.visit_date) - 1 AS INTEGER) AS dow, c.holiday_flg AS hol
            FROM visits_nation v LEFT JOIN date_info c ON v.visit_date = c.visit_date""",
    "tr": "SELECT store_id, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept FROM h GROUP BY 1",
    "h1": "SELECT h.*, y - (intercept + slope * t) AS r FROM h JOIN tr USING (store_id)",
    "dw": "SELECT store_id, dow, avg(r) AS dow_eff FROM h1 GROUP BY 1, 2",
    "h2": "SELECT h1.*, r - dow_eff AS r2 FROM h1 JOIN dw USING (store_id, dow)",
    "ho": "SELECT store_id, avg(r2) AS hol_eff FROM h2 WHERE hol = 1 GROUP BY 1",
    "h3": """SELECT h2.*, r2 - CASE WHEN hol = 1 THEN coalesce(hol_eff, 0.0) ELSE 0.0 END AS r3
             FROM h2 LEFT JOIN ho USING (store_id)""",
    "sg": "SELECT store_id, stddev_samp(r3) AS sigma FROM h3 GROUP BY 1",
    "fut": """SELECT s.store_id, d.visit_date, CAST(day(d.visit_date) IN (1, 2, 15) AS INTEGER) AS holiday_flg
              FROM (SELECT DISTINCT store_id FROM visits_nation) s,
                   (SELECT CAST(unnest(generate_series(max(visit_date) + 1, max(visit_date) + 39, INTERVAL 1 DAY))
                           AS DATE) AS visit_date FROM visits_nation) d""",
}


def _fc_sql(rows: str) -> str:
    yhat = ("(tr.intercept + tr.slope * CAST(x.visit_date - DATE '1970-01-01' AS DOUBLE) + coalesce(dw.dow_eff, 0.0)"
            " + CASE WHEN x.holiday_flg = 1 THEN coalesce(ho.hol_eff, 0.0) ELSE 0.0 END)")
    return f"""SELECT x.store_id, x.visit_date, {yhat} AS yhat, {yhat} - 1.96 * sg.sigma AS yhat_lower,
       {yhat} + 1.96 * sg.sigma AS yhat_upper
FROM {rows} x JOIN tr ON x.store_id = tr.store_id LEFT JOIN ho ON x.store_id = ho.store_id
JOIN sg ON x.store_id = sg.store_id
LEFT JOIN dw ON x.store_id = dw.store_id AND CAST(isodow(x.visit_date) - 1 AS INTEGER) = dw.dow"""


def _fit(spark, sf):
    v = A.visits_nation(spark, sf)
    cal = A.date_info(v)
    hist = v.join(F.broadcast(cal.select("visit_date", "holiday_flg")), "visit_date", "left")
    fit, dow = MD.fit_series(hist, "store_id", "visit_date", "visitors", "holiday_flg")
    return v, hist, fit, dow


@reg("models_forecast", with_ctes(f"""
SELECT store_id, visit_date, {r('yhat')} AS yhat, {r('yhat_lower')} AS yhat_lower, {r('yhat_upper')} AS yhat_upper
FROM ({_fc_sql('fut')})""", "visits_nation", "date_info", extra=FC_CTES))
def q_fc(spark, sf):
    v, hist, fit, dow = _fit(spark, sf)
    last = v.agg(F.max("visit_date")).scalar()
    rows = (v.select("store_id").distinct()
            .select("store_id", F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, 39))).alias("visit_date"))
            .withColumn("holiday_flg", F.dayofmonth("visit_date").isin(*A.HOLIDAY_DAYS_OF_MONTH).cast("int")))
    return rounded(MD.predict_series(rows, fit, dow, "store_id", "visit_date", "holiday_flg"))


@reg("models_forecast_merge", with_ctes(f"""
SELECT v.store_id, v.visit_date, v.visitors, {r('exp(f.yhat)')} AS prop_yhat, {r('exp(f.yhat_lower)')} AS prop_yhat_lower,
       {r('exp(f.yhat_upper)')} AS prop_yhat_upper
FROM visits_nation v LEFT JOIN ({_fc_sql('(SELECT store_id, visit_date, hol AS holiday_flg FROM h)')}) f
ON v.store_id = f.store_id AND v.visit_date = f.visit_date""", "visits_nation", "date_info", extra=FC_CTES))
def q_fcm(spark, sf):
    v, hist, fit, dow = _fit(spark, sf)
    fc = MD.predict_series(hist.select("store_id", "visit_date", "holiday_flg"), fit, dow, "store_id",
                           "visit_date", "holiday_flg")
    return rounded(MD.merge_forecast(v.select("store_id", "visit_date", "visitors"), fc, "store_id", "visit_date"))


@reg("models_importance")
def q_imp(spark, sf):
    tr, va = _split(spark, sf)
    m, _ = MD.fit_predict(MD.rf_regressor(num_trees=30), tr, va, FEATURES)
    return MD.importance_table(m, FEATURES)


@reg("models_drop_column")
def q_dropcol(spark, sf):
    tr, va = _split(spark, sf)
    return MD.drop_column_importance(lambda: MD.rf_regressor(num_trees=10), tr, va, FEATURES)


@reg("models_tree_variance")
def q_treevar(spark, sf):
    tr, va = _split(spark, sf)
    m, _ = MD.fit_predict(MD.rf_regressor(num_trees=20), tr, va, FEATURES)
    spread = MD.tree_spread(m, va, FEATURES, ["id", "store_f", "label"])
    return spread.groupBy("store_f").agg(F.avg("pred_std").alias("pred_std"), F.avg("pred_mean").alias("pred"),
                                         F.count(F.lit(1)).alias("n"))


@reg("models_partial_dependence")
def q_pdp(spark, sf):
    tr, va = _split(spark, sf)
    m, _ = MD.fit_predict(MD.rf_regressor(num_trees=20), tr, va, FEATURES)
    return MD.partial_dependence(m, va, FEATURES, "dow", [0, 1, 2, 3, 4, 5, 6], "id")


@reg("models_partial_dependence_pair")
def q_pdp2(spark, sf):
    tr, va = _split(spark, sf)
    m, _ = MD.fit_predict(MD.rf_regressor(num_trees=20), tr, va, FEATURES)
    return MD.partial_dependence_pair(m, va, FEATURES, ("dow", "month"), ([0, 2, 4, 6], [1, 4, 7, 10]), "id")


@reg("models_drift")
def q_drift(spark, sf):
    tr, va = _split(spark, sf)
    _, imp = MD.drift_classifier(tr, va, FEATURES)
    return imp


QUERIES = Q


def oracle() -> dict[str, str]:
    return dict(SQL)
