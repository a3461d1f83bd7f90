"""Registered pivot-window queries (flagship) and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans import incremental, pit
from ..session import scratch_path
from ..sources import adapters as A
from .canonical_sql import with_ctes
from .common import q, r, rounded

# Parameters of the registered builds (the reference's defaults: step 7, label 39, min stat 37).
PIVOT_DATE = "2001-06-20"
END_DATE = "2001-08-01"
STEP, LABEL_DAYS, MIN_STAT = 7, 39, 37
# Orders of the stores that a task holds, so that it sorts them in memory.
ORDERS_A_TASK = 100_000
# The build that the incremental one starts from: four weeks earlier.
EARLIER_PIVOT, EARLIER_END = "2001-05-23", "2001-07-04"


def inputs(spark: SparkSession, sf_dir: str, rows_per_task: int | None = None):
    """Daily rows (with `rows_per_task` partitioned by store) and calendar of the builds: customers are the stores, so they grow
    with the data."""
    cal = A.date_info(A.visits_customer(spark, sf_dir))
    v = A.visits_customer(spark, sf_dir, rows_per_task).select("store_id", "visit_date", "visitors")
    c = A.customers_as_stores(spark, sf_dir)
    stores = c.select("store_id", F.col("genre").alias("air_genre_name"), F.col("area").alias("air_area_name"))
    return pit.pit_data(v, stores, cal), cal


def context(spark: SparkSession, sf_dir: str) -> pit.PitContext:
    data, cal = inputs(spark, sf_dir)  # the windows need its first day alone
    return pit.make_context(data, PIVOT_DATE, END_DATE, STEP, LABEL_DAYS, MIN_STAT, calendar=cal, by_store=inputs(spark, sf_dir, ORDERS_A_TASK)[0])


# ---------------------------------------------------------------- DuckDB building blocks
PIT_CTES = {
    "pit_data": """
SELECT v.store_id, v.visit_date, ln(1 + v.visitors) AS visitors,
       CAST(isodow(v.visit_date) - 1 AS INTEGER) AS dow,
       s.genre AS air_genre_name, s.area AS air_area_name, c.holiday_flg, c.holiday_flg2
FROM visits_customer v LEFT JOIN customers_as_stores s ON v.store_id = s.store_id
LEFT JOIN date_info c ON v.visit_date = c.visit_date""",
    "windows": f"""
SELECT CAST(b.d0 + CAST({MIN_STAT} + {STEP} * k AS INTEGER) AS DATE) AS end_date, {LABEL_DAYS} AS days_in_label
FROM (SELECT min(visit_date) AS d0 FROM pit_data) b, range(0, 100000) t(k)
WHERE k < floor((DATE '{PIVOT_DATE}' - b.d0 - {MIN_STAT}) / {STEP}.0)
UNION ALL
SELECT CAST(DATE '{PIVOT_DATE}' + CAST({STEP} * (k + 1) AS INTEGER) AS DATE) AS end_date,
       CAST({LABEL_DAYS - LABEL_DAYS % STEP} - k * {STEP} AS INTEGER) AS days_in_label
FROM range(0, 100000) t(k)
WHERE k < floor((DATE '{END_DATE}' - DATE '{PIVOT_DATE}') / {STEP}.0)""",
    "hist": """
SELECT d.*, w.end_date, CAST(w.end_date - d.visit_date AS INTEGER) AS age
FROM pit_data d JOIN windows w ON d.visit_date < w.end_date AND d.visit_date > w.end_date - 1000""",
}


def pit_sql(body: str, extra: dict | None = None) -> str:
    ctes = dict(PIT_CTES)
    ctes.update(extra or {})
    return with_ctes(body, "visits_customer", "customers_as_stores", "visits_nation", "date_info", extra=ctes)


def summary_sql(keys: list[str], prefix: str, horizons, src: str = "hist", where: str = "",
                raw: bool = False) -> str:
    r = (lambda e: e) if raw else globals()["r"]
    cols = []
    for n in horizons:
        f = f"FILTER (WHERE age < {n})"
        cnt = f"count(visitors) {f}"
        cols += [
            f"{r(f'min(visitors) {f}')} AS {prefix}_min{n}",
            f"{r(f'avg(visitors) {f}')} AS {prefix}_mean{n}",
            f"{r(f'median(visitors) {f}')} AS {prefix}_median{n}",
            f"{r(f'max(visitors) {f}')} AS {prefix}_max{n}",
            f"{cnt} AS {prefix}_count{n}",
            f"{r(f'stddev_samp(visitors) {f}')} AS {prefix}_std{n}",
            f"{r(f'CASE WHEN {cnt} < 3 THEN NULL WHEN max(visitors) {f} = min(visitors) {f} THEN 0.0 ELSE skewness(visitors) {f} END')} AS {prefix}_skew{n}",
        ]
    k = ", ".join(keys)
    w = f"WHERE {where}" if where else ""
    return f"SELECT end_date, {k}, {', '.join(cols)} FROM {src} {w} GROUP BY end_date, {k}"


def exp_sql(keys: list[str], prefix: str, horizon: int = 1000, rate: float = 0.985, where: str = "",
            raw: bool = False) -> str:
    r = (lambda e: e) if raw else globals()["r"]
    f = f"FILTER (WHERE age < {horizon})"
    k = ", ".join(keys)
    w = f"WHERE {where}" if where else ""
    return (f"SELECT end_date, {k}, "
            f"{r(f'sum(visitors * pow({rate}, age)) {f} / sum(pow({rate}, age)) {f}')} AS {prefix}_exp_mean{horizon}, "
            f"{r(f'sum(pow({rate}, age)) {f}')} AS {prefix}_exp_weight_sum{horizon} "
            f"FROM hist {w} GROUP BY end_date, {k}")


# ---------------------------------------------------------------- registered queries
def q_windows(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return ctx.windows


def q_labels(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(pit.labels(ctx).select(
        "end_date", "store_id", "visit_date", "visitors", "dow", "diff_of_day", "month", "year",
        "holiday_flg", "holiday_flg2", *[f"ahead_holiday_{t}" for t in ("3", "2", "1", "m1")],
        *[f"ahead_holiday2_{t}" for t in ("3", "2", "1", "m1")]))


def sql_labels():
    aheads = []
    for i in (3, 2, 1, -1):
        t = str(i) if i >= 0 else f"m{-i}"
        aheads.append(f"(SELECT holiday_flg FROM date_info c WHERE c.visit_date = l.visit_date - {i}) AS ahead_holiday_{t}")
        aheads.append(f"(SELECT holiday_flg2 FROM date_info c WHERE c.visit_date = l.visit_date - {i}) AS ahead_holiday2_{t}")
    body = f"""
SELECT l.end_date, l.store_id, l.visit_date, {r('l.visitors')} AS visitors, l.dow,
       CAST(l.visit_date - l.end_date AS INTEGER) AS diff_of_day,
       CAST(month(l.visit_date) AS INTEGER) AS month, CAST(year(l.visit_date) AS INTEGER) AS year,
       l.holiday_flg, l.holiday_flg2, {', '.join(aheads)}
FROM (SELECT d.*, w.end_date FROM pit_data d JOIN windows w
      ON d.visit_date >= w.end_date AND d.visit_date < w.end_date + w.days_in_label) l"""
    return pit_sql(body)


def q_store_stats(spark, sf_dir):
    return rounded(pit.store_visitor_feat(context(spark, sf_dir)))


def q_store_dow_stats(spark, sf_dir):
    return rounded(pit.store_week_feat(context(spark, sf_dir)))


def q_genre_stats(spark, sf_dir):
    return rounded(pit.genre_visitor_feat(context(spark, sf_dir)))


def q_genre_dow_stats(spark, sf_dir):
    return rounded(pit.genre_week_feat(context(spark, sf_dir)))


def q_store_holiday_stats(spark, sf_dir):
    f1, f2 = pit.store_holiday_feat(context(spark, sf_dir))
    return rounded(f1)


def q_store_holiday2_stats(spark, sf_dir):
    f1, f2 = pit.store_holiday_feat(context(spark, sf_dir))
    return rounded(f2)


def q_store_exp(spark, sf_dir):
    return rounded(pit.store_exp_feat(context(spark, sf_dir)))


def q_genre_exp(spark, sf_dir):
    return rounded(pit.genre_exp_feat(context(spark, sf_dir)))


def q_genre_dow_exp(spark, sf_dir):
    return rounded(pit.genre_week_exp_feat(context(spark, sf_dir)))


def q_store_dow_exp(spark, sf_dir):
    return rounded(pit.store_week_exp_feat(context(spark, sf_dir)))


def sql_store_dow_exp(horizon=1000):
    f = f"FILTER (WHERE age < {horizon})"
    cols = []
    cum = "1.0"
    for rt in S.DECAY_RATES:
        w = f"pow({rt}, age)"
        cum = f"{cum} * {w}"
        den = f"sum({w}) {f}"
        tag = f"{horizon}_{S.rate_name(rt)}"
        cols += [f"{r(f'sum(visitors * {w}) {f} / {den}')} AS store_dow_exp_mean{tag}",
                 f"{r(den)} AS store_dow_exp_weight_sum{tag}",
                 f"{r(f'sum(visitors * {cum}) {f} / {den}')} AS store_dow_exp_mean2{tag}"]
    return pit_sql(f"SELECT end_date, store_id, dow, {', '.join(cols)} FROM hist GROUP BY end_date, store_id, dow")


def q_store_dow_profile(spark, sf_dir):
    return rounded(pit.store_all_week_feat(context(spark, sf_dir)))


def sql_store_dow_profile(horizon=1000):
    cols = []
    for i in range(7):
        f = f"FILTER (WHERE age < {horizon} AND dow = {i})"
        cols += [f"{r(f'avg(visitors) {f}')} AS {q(f'{i}store_dow_mean{horizon}')}",
                 f"{r(f'median(visitors) {f}')} AS {q(f'{i}store_dow_median{horizon}')}",
                 f"{r(f'max(visitors) {f}')} AS {q(f'{i}store_dow_sum{horizon}')}",
                 f"count(visitors) {f} AS {q(f'{i}store_dow_count{horizon}')}",
                 f"max(CASE WHEN visitors IS NOT NULL THEN {i} END) {f} AS {q(f'{i}dow')}"]
    return pit_sql(f"SELECT end_date, store_id, {', '.join(cols)} FROM hist GROUP BY end_date, store_id")


def q_store_diff(spark, sf_dir):
    return rounded(pit.store_week_diff_feat(context(spark, sf_dir)))


def sql_store_diff():
    extra = {
        "ranked": "SELECT visit_date, dense_rank() OVER (ORDER BY visit_date) AS date_rank "
                  "FROM (SELECT DISTINCT visit_date FROM pit_data)",
        "dd": """SELECT d.*, lag(d.visit_date) OVER w AS prev_date,
                 CASE WHEN lag(k.date_rank) OVER w = k.date_rank - 1 THEN d.visitors - lag(d.visitors) OVER w END AS diff
                 FROM pit_data d JOIN ranked k ON d.visit_date = k.visit_date
                 WINDOW w AS (PARTITION BY d.store_id ORDER BY d.visit_date)""",
        "hd": """SELECT dd.*, w.end_date, CAST(w.end_date - dd.visit_date AS INTEGER) AS age,
                 CAST(w.end_date - dd.prev_date AS INTEGER) AS prev_age
                 FROM dd JOIN windows w ON dd.visit_date < w.end_date AND dd.visit_date > w.end_date - 1000""",
    }
    cols = []
    for n in pit.DIFF_HORIZONS:
        f = f"FILTER (WHERE age < {n} AND prev_age < {n})"
        cols += [f"{r(f'avg(abs(diff)) {f}')} AS store_diff_mean{n}",
                 f"{r(f'stddev_samp(diff) {f}')} AS store_diff_std{n}",
                 f"{r(f'max(diff) {f}')} AS store_diff_max{n}",
                 f"{r(f'min(diff) {f}')} AS store_diff_min{n}"]
    return pit_sql(f"SELECT end_date, store_id, {', '.join(cols)} FROM hd GROUP BY end_date, store_id", extra)


def q_first_last(spark, sf_dir):
    return pit.first_last_time_feat(context(spark, sf_dir))


def sql_first_last():
    return pit_sql("SELECT end_date, store_id, max(age) AS first_time, min(age) AS last_time "
                   "FROM hist GROUP BY end_date, store_id")


def _reserve_ctes():
    return {
        "res": """SELECT store_id, system, reserve_visitors, CAST(visit_datetime AS DATE) AS visit_date,
                  CAST(reserve_datetime AS DATE) AS reserve_date,
                  CAST(floor((epoch(visit_datetime) - epoch(reserve_datetime)) / 86400) AS INTEGER) AS diff_time
                  FROM reservations""",
        "rw": """SELECT res.*, w.end_date FROM res JOIN windows w
                 ON res.visit_date >= w.end_date AND res.visit_date < w.end_date + w.days_in_label
                 AND res.reserve_date < w.end_date""",
    }


def q_reserve(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(pit.reserve_store_day(pit.reserve_feat(ctx, A.reservations(spark, sf_dir))))


def sql_reserve():
    cols = []
    for s in ("air", "hpg"):
        f = f"FILTER (WHERE system = '{s}')"
        cols += [f"{r(f'sum(reserve_visitors) {f}')} AS {s}_reserve_visitors",
                 f"count(reserve_visitors) {f} AS {s}_reserve_count",
                 f"{r(f'avg(diff_time) {f}')} AS {s}_store_diff_time_mean"]
    body = f"SELECT end_date, store_id, visit_date, {', '.join(cols)} FROM rw GROUP BY end_date, store_id, visit_date"
    return with_ctes(body, "visits_customer", "customers_as_stores", "visits_nation", "stores", "date_info", "reservations",
                     extra={**PIT_CTES, **_reserve_ctes()})


def q_reserve_date(spark, sf_dir):
    ctx = context(spark, sf_dir)
    res = A.reservations(spark, sf_dir)
    return rounded(pit.reserve_date_feat(pit.reserve_feat(ctx, res)))


def sql_reserve_date():
    cols = []
    for s in ("air", "hpg"):
        f = f"FILTER (WHERE system = '{s}')"
        cols += [f"{r(f'sum(reserve_visitors) {f}')} AS {s}_date_visitors",
                 f"CAST(count(reserve_visitors) {f} AS BIGINT) AS {s}_date_count",
                 f"{r(f'avg(diff_time) {f}')} AS {s}_diff_time_mean"]
    body = f"SELECT end_date, visit_date, {', '.join(cols)} FROM rw GROUP BY end_date, visit_date"
    return with_ctes(body, "visits_customer", "customers_as_stores", "visits_nation", "stores", "date_info", "reservations",
                     extra={**PIT_CTES, **_reserve_ctes()})


def _shown(ts):
    keep = ["end_date", "store_id", "visit_date", "visitors", "dow", "air_genre_name", "diff_of_day",
            "ahead_holiday_1", "ahead_holiday2_m1"]
    feats = [c for c in ts.columns
             if c not in keep and c.startswith(("store_", "genre_", "sgenre_", "first_", "last_"))]
    return rounded(ts.select(*keep, *feats))


def q_training_set(spark, sf_dir):
    return _shown(pit.training_set(context(spark, sf_dir)))


def q_incremental(spark, sf_dir):
    """The training set of four weeks earlier, then the update to today's data; the same rows as a full build."""
    data, cal = inputs(spark, sf_dir)
    path = scratch_path(spark, f"pit_incremental_{uuid.uuid4().hex}")
    past = data.where(F.col("visit_date") < F.lit(EARLIER_END).cast("date"))
    for rows, pivot, end in ((past, EARLIER_PIVOT, EARLIER_END), (data, PIVOT_DATE, END_DATE)):
        incremental.update(pit.make_context(rows, pivot, end, STEP, LABEL_DAYS, MIN_STAT, calendar=cal), path)
    return _shown(incremental.read(spark, path))


def q_test_set(spark, sf_dir):
    ts = pit.test_set(inputs(spark, sf_dir)[0], LABEL_DAYS)
    keep = ["end_date", "store_id", "visit_date", "dow", "air_genre_name", "diff_of_day"]
    feats = [c for c in ts.columns if c not in keep and c.startswith(("store_", "genre_", "sgenre_", "first_", "last_"))]
    return rounded(ts.select(*keep, *feats))


def _training_parts() -> tuple[dict, list[str], list[str]]:
    """CTEs of the four feature families, their columns with missing ones as 0, and the ratios."""
    horizons_s, horizons_g = pit.STORE_HORIZONS, pit.GENRE_HORIZONS
    ctes = {
        "fs": summary_sql(["store_id"], "store", horizons_s, raw=True),
        "fe": exp_sql(["store_id"], "store", raw=True),
        "ffl": "SELECT end_date, store_id, max(age) AS first_time, min(age) AS last_time FROM hist GROUP BY 1, 2",
        "fg": summary_sql(["air_genre_name"], "genre", horizons_g, where="air_genre_name IS NOT NULL", raw=True),
    }
    names = [f"store_{s}{n}" for n in horizons_s for s in S.SUMMARY7]
    names += ["store_exp_mean1000", "store_exp_weight_sum1000", "first_time", "last_time"]
    names += [f"genre_{s}{n}" for n in horizons_g for s in S.SUMMARY7]
    whole = lambda c: "count" in c or c in ("first_time", "last_time")
    cols = [f"coalesce({c}, 0) AS {c}" if whole(c) else f"{r(f'coalesce({c}, 0)')} AS {c}" for c in names]
    ratios = [f"{r(f'coalesce({a}, 0) / (coalesce({b}, 0) + 0.01)')} AS {n}" for n, a, b in pit.RATIOS]
    return ctes, cols, ratios


FAMILY_JOINS = """FROM lab LEFT JOIN fs USING (end_date, store_id) LEFT JOIN fe USING (end_date, store_id)
LEFT JOIN ffl USING (end_date, store_id) LEFT JOIN fg USING (end_date, air_genre_name)"""


def sql_training_set():
    ctes, cols, ratios = _training_parts()
    lab = """SELECT d.*, w.end_date FROM pit_data d JOIN windows w
                  ON d.visit_date >= w.end_date AND d.visit_date < w.end_date + w.days_in_label"""
    body = f"""
SELECT lab.end_date, lab.store_id, lab.visit_date, {r('lab.visitors')} AS visitors, lab.dow, lab.air_genre_name,
       CAST(lab.visit_date - lab.end_date AS INTEGER) AS diff_of_day,
       (SELECT holiday_flg FROM date_info c WHERE c.visit_date = lab.visit_date - 1) AS ahead_holiday_1,
       (SELECT holiday_flg2 FROM date_info c WHERE c.visit_date = lab.visit_date + 1) AS ahead_holiday2_m1,
       {', '.join(cols)}, {', '.join(ratios)}
{FAMILY_JOINS}"""
    return pit_sql(body, {**ctes, "lab": lab})


def sql_test_set():
    ctes, cols, ratios = _training_parts()
    window = f"SELECT CAST(max(visit_date) + 1 AS DATE) AS end_date, {LABEL_DAYS} AS days_in_label FROM pit_data"
    lab = f"""SELECT s.store_id, s.air_genre_name, w.end_date, CAST(w.end_date + CAST(k AS INTEGER) AS DATE) AS visit_date
              FROM (SELECT DISTINCT store_id, air_genre_name FROM pit_data) s, windows w, range(0, {LABEL_DAYS}) t(k)"""
    body = f"""
SELECT lab.end_date, lab.store_id, lab.visit_date, CAST(isodow(lab.visit_date) - 1 AS INTEGER) AS dow, lab.air_genre_name,
       CAST(lab.visit_date - lab.end_date AS INTEGER) AS diff_of_day, {', '.join(cols)}, {', '.join(ratios)}
{FAMILY_JOINS}"""
    return pit_sql(body, {"windows": window, **ctes, "lab": lab})


def q_training_set_full(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return pit.full_training_set(ctx, A.reservations(spark, sf_dir))


QUERIES = {
    "pit_windows": q_windows,
    "pit_labels": q_labels,
    "pit_store_stats": q_store_stats,
    "pit_store_dow_stats": q_store_dow_stats,
    "pit_genre_stats": q_genre_stats,
    "pit_genre_dow_stats": q_genre_dow_stats,
    "pit_store_holiday_stats": q_store_holiday_stats,
    "pit_store_holiday2_stats": q_store_holiday2_stats,
    "pit_store_exp_mean": q_store_exp,
    "pit_genre_exp_mean": q_genre_exp,
    "pit_genre_dow_exp_mean": q_genre_dow_exp,
    "pit_store_dow_exp_means": q_store_dow_exp,
    "pit_store_dow_profile": q_store_dow_profile,
    "pit_store_diff_stats": q_store_diff,
    "pit_first_last_time": q_first_last,
    "pit_reserve_store_day": q_reserve,
    "pit_reserve_day": q_reserve_date,
    "pit_training_set": q_training_set,
    "pit_incremental": q_incremental,
    "pit_test_set": q_test_set,
    "pit_training_set_full": q_training_set_full,
}


def oracle() -> dict[str, str]:
    return {
        "pit_windows": pit_sql("SELECT end_date, days_in_label FROM windows"),
        "pit_labels": sql_labels(),
        "pit_store_stats": pit_sql(summary_sql(["store_id"], "store", pit.STORE_HORIZONS)),
        "pit_store_dow_stats": pit_sql(summary_sql(["store_id", "dow"], "store_dow", pit.STORE_HORIZONS)),
        "pit_genre_stats": pit_sql(summary_sql(["air_genre_name"], "genre", pit.GENRE_HORIZONS,
                                               where="air_genre_name IS NOT NULL")),
        "pit_genre_dow_stats": pit_sql(summary_sql(["air_genre_name", "dow"], "genre_dow", pit.GENRE_HORIZONS,
                                                   where="air_genre_name IS NOT NULL")),
        "pit_store_holiday_stats": pit_sql(summary_sql(["store_id", "holiday_flg"], "store_holiday", [1000])),
        "pit_store_holiday2_stats": pit_sql(summary_sql(["store_id", "holiday_flg2"], "store_holiday2", [1000])),
        "pit_store_exp_mean": pit_sql(exp_sql(["store_id"], "store")),
        "pit_genre_exp_mean": pit_sql(exp_sql(["air_genre_name"], "genre", where="air_genre_name IS NOT NULL")),
        "pit_genre_dow_exp_mean": pit_sql(exp_sql(["air_genre_name", "dow"], "genre_dow",
                                                  where="air_genre_name IS NOT NULL")),
        "pit_store_dow_exp_means": sql_store_dow_exp(),
        "pit_store_dow_profile": sql_store_dow_profile(),
        "pit_store_diff_stats": sql_store_diff(),
        "pit_first_last_time": sql_first_last(),
        "pit_reserve_store_day": sql_reserve(),
        "pit_reserve_day": sql_reserve_date(),
        "pit_training_set": sql_training_set(),
        "pit_incremental": sql_training_set(),
        "pit_test_set": sql_test_set(),
    }
