"""Registered ranking / evaluation queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import joins as J
from ..operators import metrics as M
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


@reg("eval_total_sort", with_ctes("SELECT store_id, visit_date, visitors FROM visits_customer", "visits_customer"))
def q_sort(spark, sf):
    v = A.visits_customer(spark, sf).select("store_id", "visit_date", "visitors")
    return M.total_sort(v, ["visit_date"], ["store_id"])


@reg("eval_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_top(spark, sf):
    return M.top_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10, "o_orderkey")


PRED = "CAST(list_position(p, list_max(p)) - 1 AS INTEGER)"


PERTURB = "(SELECT user_id, p, CASE WHEN user_id % 3 = 0 THEN (actual + 1) % 5 ELSE actual END AS actual FROM class_probs)"


def _perturbed(spark, sf):
    cp = A.class_probs(spark, sf)
    return cp.withColumn("actual", F.when(F.col("user_id") % 3 == 0, (F.col("actual") + 1) % 5)
                         .otherwise(F.col("actual")).cast("int"))


def _most_sql(correct: bool) -> str:
    cond = "=" if correct else "<>"
    order = "py DESC" if correct else "py ASC"
    return with_ctes(f"""
SELECT user_id, class, {r('py')} AS py, CAST(rank AS INTEGER) AS rank FROM (
  SELECT user_id, actual AS class, p[actual + 1] AS py,
         row_number() OVER (PARTITION BY actual ORDER BY p[actual + 1] {order.split()[1]}, user_id) AS rank
  FROM {PERTURB} WHERE {PRED} {cond} actual) WHERE rank <= 4""", "class_probs")


@reg("eval_most_correct", _most_sql(True))
def q_mc(spark, sf):
    return rounded(M.most_by_correct(_perturbed(spark, sf), 5, True).withColumn("rank", F.col("rank").cast("int")))


@reg("eval_most_incorrect", _most_sql(False))
def q_mi(spark, sf):
    return rounded(M.most_by_correct(_perturbed(spark, sf), 5, False).withColumn("rank", F.col("rank").cast("int")))


@reg("eval_most_uncertain", with_ctes(f"""
SELECT user_id, class, {r('py')} AS py, {r('dist')} AS dist, CAST(rank AS INTEGER) AS rank FROM (
  SELECT user_id, actual AS class, p[actual + 1] AS py, abs(p[actual + 1] - 1.0 / 5) AS dist,
         row_number() OVER (PARTITION BY actual ORDER BY abs(p[actual + 1] - 1.0 / 5), user_id) AS rank
  FROM class_probs) WHERE rank <= 4""", "class_probs"))
def q_mu(spark, sf):
    return rounded(M.most_uncertain(A.class_probs(spark, sf), 5).withColumn("rank", F.col("rank").cast("int")))


IMP_COLS = ["BE_CUSTKEY", "AF_PRICE_K", "OP_CODE", "_id", "dt_data"]


@reg("eval_threshold_select", with_ctes("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r(f'abs(corr(CAST({c} AS DOUBLE), TRANS_RBC))')} AS importance FROM clinical"
    for c in IMP_COLS) + ") WHERE importance > 0.01 AND \"column\" NOT IN ('_id')", "clinical"))
def q_thr(spark, sf):
    c = A.clinical(spark, sf)
    one = c.agg(*[F.abs(F.corr(F.col(x).cast("double"), "TRANS_RBC")).alias(x) for x in IMP_COLS])
    imp = one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("importance"))
                                         for x in IMP_COLS])).alias("s")).select("s.*")
    excl = spark.createDataFrame([("_id",)], "column string")
    return rounded(M.threshold_select(rounded(imp), 0.01, excl))


SP_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@reg("eval_spearman", f"""
WITH rk AS (SELECT {', '.join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}__rank"
                             for c in SP_COLS)} FROM lineitem)
SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}__rank, {b}__rank)')} AS rho FROM rk"
    for i, a in enumerate(SP_COLS) for b in SP_COLS[i + 1:]) + ")")
def q_spear(spark, sf):
    li = table(spark, sf, "lineitem").select(*SP_COLS)
    return rounded(M.spearman_pairs(li, SP_COLS))


@reg("eval_feature_groups", None)
def q_groups(spark, sf):
    li = table(spark, sf, "lineitem").select(*SP_COLS)
    return rounded(M.feature_groups(li, SP_COLS))


@reg("eval_column_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
    f"{r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'quantile_cont({c}, 0.25)')} AS q25, "
    f"{r(f'quantile_cont({c}, 0.5)')} AS q50, {r(f'quantile_cont({c}, 0.75)')} AS q75 FROM lineitem" for c in SP_COLS))
def q_summary(spark, sf):
    return rounded(M.column_summary(table(spark, sf, "lineitem"), SP_COLS))


@reg("eval_blend", with_ctes(f"SELECT id, {r('(pred_a + 1.1 * pred_b) / 2')} AS blend FROM regressions",
                             "regressions"))
def q_blend(spark, sf):
    g = A.regressions(spark, sf)
    return rounded(M.blend(g.select("id", "pred_a"), g.select("id", "pred_b"), "id", "pred_a", "pred_b"))


@reg("eval_mean_over_runs", with_ctes(f"""
SELECT id, {r('avg(pred)')} AS pred FROM (SELECT id, pred_a AS pred FROM regressions
  UNION ALL SELECT id, pred_b FROM regressions UNION ALL SELECT id, actual FROM regressions) GROUP BY id""",
                                      "regressions"))
def q_runs(spark, sf):
    g = A.regressions(spark, sf)
    runs = J.outer_union(g.select("id", F.col("pred_a").alias("pred")), g.select("id", F.col("pred_b").alias("pred")),
                         g.select("id", F.col("actual").alias("pred")))
    return rounded(M.mean_over_runs(runs, "id", "pred"))


N_AUG = 4


def _tta_runs(spark, sf):
    cp = A.class_probs(spark, sf)
    ex = cp.select("user_id", F.posexplode("p").alias("class", "pv"))
    runs = ex.select("user_id", "class", "pv",
                     F.explode(F.array(*[F.lit(k) for k in range(N_AUG + 1)])).alias("run"))
    return runs.select("user_id", "class", (F.log(F.col("pv") + 0.001) + 0.03 * F.sqrt(F.col("run"))).alias("logp"))


@reg("eval_tta_mean", with_ctes("SELECT user_id, " + ", ".join(
    f"{r(f'avg(exp(logp)) FILTER (WHERE class = {c})')} AS \"{c}\"" for c in range(5)) + """
FROM (SELECT user_id, class, ln(pv + 0.001) + 0.03 * sqrt(run) AS logp FROM
  (SELECT user_id, unnest(p) AS pv, unnest(range(0, 5)) AS class FROM class_probs), range(0, 5) t(run))
GROUP BY user_id""", "class_probs"))
def q_tta(spark, sf):
    return rounded(M.tta_mean(_tta_runs(spark, sf), "user_id", "class", "logp", list(range(5))))


@reg("eval_regression_metrics", with_ctes(f"""
SELECT {r('sqrt(avg(pow(pred_a - actual, 2)))')} AS rmse, {r('sqrt(avg(pow(ln(1 + pred_a) - ln(1 + actual), 2)))')} AS rmsle,
       {r('sqrt(avg(pow(CASE WHEN actual = 0 THEN NULL ELSE (pred_a - actual) / actual END, 2)))')} AS rmspe,
       {r('1 - sum(pow(pred_a - actual, 2)) / sum(pow(actual - (SELECT avg(actual) FROM regressions), 2))')} AS r2
FROM regressions""", "regressions"))
def q_regm(spark, sf):
    return rounded(M.regression_metrics(A.regressions(spark, sf), "actual", "pred_a"))


@reg("eval_accuracy", with_ctes(f"SELECT {r(f'avg(CAST({PRED} = actual AS DOUBLE))')} AS accuracy FROM class_probs",
                                "class_probs"))
def q_acc(spark, sf):
    return rounded(M.accuracy(A.class_probs(spark, sf), "p", "actual"))


ONEHOT = "list_transform(range(0, 5), lambda k: CASE WHEN k = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def _cp_targets(spark, sf):
    from ..operators.encode import one_hot_array
    return A.class_probs(spark, sf).withColumn("t", one_hot_array("actual", 5))


@reg("eval_accuracy_multi", with_ctes(f"""
SELECT {r('sum(h) / sum(n)')} AS accuracy_multi FROM (
  SELECT list_sum(list_transform(list_zip(p, t), lambda z: CASE WHEN CAST(z[1] > 0.2 AS DOUBLE) = z[2] THEN 1.0
                                                                  ELSE 0.0 END)) AS h, len(p) AS n
  FROM (SELECT p, {ONEHOT} AS t FROM class_probs))""", "class_probs"))
def q_accm(spark, sf):
    return rounded(M.accuracy_multi(_cp_targets(spark, sf), "p", "t", 0.2))


@reg("eval_fbeta", with_ctes(f"""
SELECT {r('avg(prec * rec / (prec * 4 + rec + 1e-9) * 5)')} AS fbeta FROM (
  SELECT tp / (sp + 1e-9) AS prec, tp / (st + 1e-9) AS rec FROM (
    SELECT list_sum(list_transform(list_zip(yp, t), lambda z: z[1] * z[2])) AS tp, list_sum(yp) AS sp, list_sum(t) AS st
    FROM (SELECT list_transform(p, lambda x: CAST(x > 0.2 AS DOUBLE)) AS yp, {ONEHOT} AS t FROM class_probs)))""",
                          "class_probs"))
def q_fbeta(spark, sf):
    return rounded(M.fbeta(_cp_targets(spark, sf), "p", "t", 2.0, 0.2))


@reg("eval_cross_entropy", with_ctes(f"""
SELECT {r('avg(-ln(c[actual + 1] / list_sum(c)))')} AS log_loss FROM (
  SELECT actual, list_transform(p, lambda x: least(greatest(x, 0.1), 0.9)) AS c FROM class_probs)""", "class_probs"))
def q_ce(spark, sf):
    cp = A.class_probs(spark, sf).withColumn("pc", C.clip_renormalise("p", 0.9))
    return rounded(M.cross_entropy(cp, "pc", "actual"))


@reg("eval_confusion", with_ctes(f"""
SELECT actual, pred, n, {r('n / sum(n) OVER (PARTITION BY actual)')} AS share FROM (
  SELECT actual, {PRED} AS pred, count(*) AS n FROM class_probs GROUP BY 1, 2)""", "class_probs"))
def q_conf(spark, sf):
    cp = A.class_probs(spark, sf).withColumn("pred", M.argmax("p"))
    return rounded(M.confusion(cp, "actual", "pred"))


@reg("eval_within_tolerance", with_ctes(f"""
SELECT {r('avg(CAST(abs(exp(pred_a) - 1 - (exp(actual) - 1)) <= 1 AS INTEGER))')} AS share_within,
       CAST(sum(CAST(abs(exp(pred_a) - 1 - (exp(actual) - 1)) <= 1 AS INTEGER)) AS BIGINT) AS n_within,
       count(*) AS n FROM regressions""", "regressions"))
def q_tol(spark, sf):
    g = A.regressions(spark, sf).select(F.expm1("pred_a").alias("p"), F.expm1("actual").alias("a"))
    return rounded(M.within_tolerance(g, "a", "p", 1.0))


@reg("eval_submission", with_ctes(f"""
SELECT s.id, {r('coalesce(p.visitors, 0)')} AS visitors FROM submission s LEFT JOIN (
  SELECT CAST(s2.store_id AS VARCHAR) || '_' || strftime(d.visit_date, '%Y-%m-%d') AS id, m.visitors FROM
    (SELECT DISTINCT store_id FROM visits_nation WHERE store_id % 2 = 0) s2
    JOIN (SELECT store_id, avg(visitors) AS visitors FROM visits_nation GROUP BY 1) m ON s2.store_id = m.store_id,
    (SELECT CAST(unnest(generate_series(max(visit_date) + 1, max(visit_date) + 39, INTERVAL 1 DAY)) AS DATE)
            AS visit_date FROM visits_nation) d) p ON s.id = p.id""", "visits_nation", "submission"))
def q_sub(spark, sf):
    v = A.visits_nation(spark, sf)
    sub = A.submission(spark, sf, v)
    means = v.groupBy("store_id").agg(F.avg("visitors").alias("visitors")).where(F.col("store_id") % 2 == 0)
    from ..functions.strings import id_build
    last = v.agg(F.max("visit_date")).scalar()
    preds = (means.select("store_id", "visitors",
                          F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, 39))).alias("visit_date"))
             .select(id_build("store_id", "visit_date").alias("id"), "visitors"))
    return rounded(M.assemble_submission(sub, preds, "id", "visitors"))


def _wd(v):
    return J.weekday_summary(v)


@reg("eval_compare_tables", with_ctes("""
SELECT * FROM (SELECT coalesce(a.store_id, b.store_id) AS store_id, coalesce(a.dow, b.dow) AS dow,
  list_filter([CASE WHEN a.mn IS DISTINCT FROM b.mn THEN 'mn' END, CASE WHEN a.mx IS DISTINCT FROM b.mx THEN 'mx' END,
               CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END], lambda x: x IS NOT NULL) AS diff_columns
  FROM (SELECT store_id, CAST(isodow(visit_date) - 1 AS INTEGER) AS dow, min(visitors) AS mn, max(visitors) AS mx,
               count(*) AS n FROM visits_nation GROUP BY 1, 2) a
  FULL JOIN (SELECT store_id, CAST(isodow(visit_date) - 1 AS INTEGER) AS dow, min(visitors) AS mn,
                    max(visitors) AS mx, count(*) AS n FROM visits_nation WHERE year(visit_date) < 2001 GROUP BY 1, 2) b
  ON a.store_id = b.store_id AND a.dow = b.dow) WHERE len(diff_columns) > 0""", "visits_nation"))
def q_cmp(spark, sf):
    v = A.visits_nation(spark, sf).withColumn("dow", F.weekday("visit_date"))

    def summ(d):
        return d.groupBy("store_id", "dow").agg(F.min("visitors").alias("mn"), F.max("visitors").alias("mx"),
                                                F.count(F.lit(1)).alias("n"))
    return M.compare_tables(summ(v), summ(v.where(F.year("visit_date") < 2001)), ["store_id", "dow"])


QUERIES = Q


def oracle() -> dict[str, str]:
    return dict(SQL)
