"""Registered date / event / rolling queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import events as EV
from ..operators import rolling as RO
from ..sources import adapters as A
from ..sources.tables import table
from .canonical_sql import with_ctes
from .common import q, r, rounded


# ------------------------------------------------------------------ dates
def q_datepart(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return D.add_datepart(o, "o_orderdate")


SQL_DATEPART = """
SELECT o_orderkey, CAST(year(d) AS INTEGER) AS o_orderYear, CAST(month(d) AS INTEGER) AS o_orderMonth,
  CAST(week(d) AS INTEGER) AS o_orderWeek, CAST(day(d) AS INTEGER) AS o_orderDay,
  CAST(isodow(d) - 1 AS INTEGER) AS o_orderDayofweek, CAST(dayofyear(d) AS INTEGER) AS o_orderDayofyear,
  d = last_day(d) AS o_orderIs_month_end, day(d) = 1 AS o_orderIs_month_start,
  d = last_day(make_date(year(d), quarter(d) * 3, 1)) AS o_orderIs_quarter_end,
  d = make_date(year(d), (quarter(d) - 1) * 3 + 1, 1) AS o_orderIs_quarter_start,
  (month(d) = 12 AND day(d) = 31) AS o_orderIs_year_end, dayofyear(d) = 1 AS o_orderIs_year_start,
  CAST(epoch(o_orderdate) AS BIGINT) AS o_orderElapsed
FROM (SELECT o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) AS d FROM orders)"""


def q_epoch_ms(spark, sf):
    c = A.clinical(spark, sf).select("_id", "dt_data")
    return c.withColumns(D.epoch_ms_parts("dt_data"))


SQL_EPOCH_MS = with_ctes("""
SELECT _id, ts AS dt_data, CAST(year(ts) AS INTEGER) AS dt_data_year, CAST(month(ts) AS INTEGER) AS dt_data_month,
  CAST(week(ts) AS INTEGER) AS dt_data_week, CAST(day(ts) AS INTEGER) AS dt_data_day,
  CAST(hour(ts) AS INTEGER) AS dt_data_hour
FROM (SELECT _id, make_timestamp(dt_data * 1000) AS ts FROM clinical)""", "clinical")


def q_date_info_parts(spark, sf):
    v = A.visits_nation(spark, sf).select("store_id", "visit_date")
    return v.withColumns(D.date_info_columns("visit_date", with_day=True))


SQL_DATE_INFO_PARTS = with_ctes("""
SELECT store_id, visit_date, CAST(week(visit_date) AS INTEGER) AS visit_date_week,
  CAST(isodow(visit_date) - 1 AS INTEGER) AS visit_date_dayofweek, CAST(year(visit_date) AS INTEGER) AS visit_date_year,
  CAST(month(visit_date) AS INTEGER) AS visit_date_month, CAST(day(visit_date) AS INTEGER) AS visit_date_day
FROM visits_nation""", "visits_nation")


def q_date_arith(spark, sf):
    v = A.visits_nation(spark, sf).select("store_id", "visit_date")
    cal = A.date_info(A.visits_nation(spark, sf))
    v = v.join(F.broadcast(cal.select("visit_date", "holiday_flg")), "visit_date", "left")
    return v.select("store_id", "visit_date",
                    D.date_add_days("visit_date", 39).alias("label_end"),
                    D.diff_of_days("visit_date", F.lit("1995-01-01")).alias("days_since_start"),
                    D.date_int("visit_date").alias("date_int"),
                    D.weekend_or_holiday("visit_date", "holiday_flg").alias("holiday_flg2"),
                    D.demote_weekend_holiday("visit_date", "holiday_flg").alias("holiday_flg_wd"))


SQL_DATE_ARITH = with_ctes("""
SELECT v.store_id, v.visit_date, CAST(v.visit_date + 39 AS DATE) AS label_end,
  CAST(v.visit_date - DATE '1995-01-01' AS INTEGER) AS days_since_start,
  CAST(strftime(v.visit_date, '%Y%m%d') AS INTEGER) AS date_int,
  CAST(isodow(v.visit_date) - 1 > 4 OR c.holiday_flg = 1 AS INTEGER) AS holiday_flg2,
  CASE WHEN isodow(v.visit_date) - 1 > 4 THEN 0 ELSE c.holiday_flg END AS holiday_flg_wd
FROM visits_nation v LEFT JOIN date_info c ON v.visit_date = c.visit_date""", "visits_nation", "date_info")


def q_compose(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", D.compose_timestamp(F.year("o_orderdate"), F.month("o_orderdate"),
                                                      F.dayofmonth("o_orderdate"),
                                                      (F.col("o_orderkey") % 24).cast("int")).alias("ts"))


SQL_COMPOSE = """
SELECT o_orderkey, make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate),
                                  CAST(o_orderkey % 24 AS INTEGER), 0, 0) AS ts FROM orders"""


def q_calendar(spark, sf):
    return A.date_info(A.visits_nation(spark, sf))


SQL_CALENDAR = with_ctes("SELECT * FROM date_info", "date_info")


# ------------------------------------------------------------------ events
def _flag_series(spark, sf):
    return EV.event_flag_daily(table(spark, sf, "events"), "purchase")


SERIES_SQL = """SELECT user_id, CAST(ts AS DATE) AS date,
  max(CAST(event_type = 'purchase' AS INTEGER)) AS flag FROM events GROUP BY 1, 2"""


def q_elapsed(spark, sf):
    return EV.add_elapsed(_flag_series(spark, sf), "flag", "date", ["user_id"])


def sql_elapsed(src: str, keys: list[str], flag: str, date: str) -> str:
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    ev = f"CASE WHEN {flag} = 1 THEN {date} END"
    return f"""
SELECT *, CAST({date} - coalesce(last_value({ev} IGNORE NULLS) OVER ({part} ORDER BY {date}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), min({ev}) OVER ({part})) AS INTEGER) AS af_{flag},
          CAST({date} - coalesce(first_value({ev} IGNORE NULLS) OVER ({part} ORDER BY {date}
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max({ev}) OVER ({part})) AS INTEGER) AS be_{flag}
FROM {src}"""


def sql_duration(src: str, keys: list[str], flag: str, date: str) -> str:
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    ipart = f"PARTITION BY {', '.join(keys + ['isl'])}"
    return f"""
SELECT * EXCLUDE (on_, isl, pos, len),
  CAST(pos AS BIGINT) AS dur_time_{flag}, CAST(len AS BIGINT) AS dur_{flag},
  CASE WHEN len = 0 THEN 0.0 ELSE pos / len END AS dur_prog_{flag}
FROM (SELECT *, CASE WHEN on_ = 1 THEN sum(on_) OVER ({ipart} ORDER BY {date}
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS pos,
             CASE WHEN on_ = 1 THEN sum(on_) OVER ({ipart}) ELSE 0 END AS len
      FROM (SELECT *, CAST({flag} = 1 AS INTEGER) AS on_,
                   sum(1 - CAST({flag} = 1 AS INTEGER)) OVER ({part} ORDER BY {date}
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl
            FROM {src}))"""


def q_duration(spark, sf):
    return EV.add_duration(_flag_series(spark, sf), "flag", "date", ["user_id"])


def q_calendar_events(spark, sf):
    cal = A.date_info(A.visits_nation(spark, sf)).select("visit_date", "holiday_flg")
    # calendar-sized series: the one place an unpartitioned window is acceptable
    return EV.add_duration(EV.add_elapsed(cal, "holiday_flg", "visit_date"), "holiday_flg", "visit_date")


def sql_calendar_events():
    inner = sql_elapsed("(SELECT visit_date, holiday_flg FROM date_info)", [], "holiday_flg", "visit_date")
    return with_ctes(sql_duration(f"({inner})", [], "holiday_flg", "visit_date"), "date_info")


def q_duplicates(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("date"))
    return EV.duplicate_keys(e, ["user_id"], "date")


SQL_DUPLICATES = """SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n_rows FROM events
GROUP BY 1, 2 HAVING count(*) > 1"""


# ------------------------------------------------------------------ rolling
def _customer_visits(spark, sf):
    v = A.visits_customer(spark, sf)
    c = A.customers_as_stores(spark, sf)
    return v.join(c, "store_id").withColumn("dow", F.weekday("visit_date"))


def q_roll_store(spark, sf):
    return rounded(RO.rolling_stats(A.visits_customer(spark, sf), ["store_id"]))


def q_roll_store_dow(spark, sf):
    v = A.visits_customer(spark, sf).withColumn("dow", F.weekday("visit_date"))
    return rounded(RO.rolling_stats(v, ["store_id", "dow"]))


def q_roll_genre(spark, sf):
    return rounded(RO.rolling_stats(_customer_visits(spark, sf), ["genre", "area", "dow"]))


ASSEMBLY = (["store_id"], ["store_id", "dow"], ["genre", "area", "dow"])


def q_roll_assembly(spark, sf):
    v = _customer_visits(spark, sf).select("store_id", "genre", "area", "visit_date", "dow", "visitors")
    return rounded(RO.rolling_assembly(v, list(ASSEMBLY)))


def sql_rolling(src: str, keys: list[str], ctes: tuple | None, periods=RO.PERIODS) -> str:
    k = ", ".join(keys)
    inner, outer, frames = [], [], []
    for period in periods:
        n = int(period.rstrip("d"))
        w = f"w{n}"
        frames.append(f"{w} AS (PARTITION BY {k} ORDER BY day RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
        exprs = {"max": f"max(v) OVER {w}", "min": f"min(v) OVER {w}", "median": f"median(v) OVER {w}",
                 "std": f"stddev_samp(v) OVER {w}", "cnt": f"CAST(count(v) OVER {w} AS DOUBLE)", "mean": f"avg(v) OVER {w}",
                 "skew": f"CASE WHEN count(v) OVER {w} < 3 THEN NULL WHEN max(v) OVER {w} = min(v) OVER {w} THEN 0.0 "
                         f"ELSE skewness(v) OVER {w} END"}
        inner += [f"{e} AS s_{s}_{n}" for s, e in exprs.items()]
        outer += [f"{r(f'lag(s_{s}_{n}) OVER o')} AS {RO.rolling_name(keys, period, s)}" for s in RO.ROLL_STATS]
    body = f"""
SELECT {k}, visit_date, {', '.join(outer)}
FROM (SELECT {k}, visit_date, day, {', '.join(inner)}
      FROM (SELECT {k}, visit_date, avg(CAST(visitors AS DOUBLE)) AS v,
                   CAST(visit_date - DATE '1970-01-01' AS INTEGER) AS day
            FROM {src} GROUP BY {k}, visit_date)
      WINDOW {', '.join(frames)})
WINDOW o AS (PARTITION BY {k} ORDER BY day)"""
    return with_ctes(body, *ctes) if ctes else body


def sql_roll_assembly() -> str:
    parts, joins = ["v.store_id, v.genre, v.area, v.visit_date, v.dow, v.visitors"], []
    for i, keys in enumerate(ASSEMBLY):
        on = [*keys, "visit_date"]
        parts.append(f"r{i}.* EXCLUDE ({', '.join(on)})")
        joins.append(f"LEFT JOIN ({sql_rolling(CUSTOMER_VISITS_SQL, keys, None)}) r{i} ON " + " AND ".join(f"v.{k} = r{i}.{k}" for k in on))
    body = f"SELECT {', '.join(parts)} FROM {CUSTOMER_VISITS_SQL} v " + " ".join(joins)
    return with_ctes(body, "visits_customer", "customers_as_stores")


CUSTOMER_VISITS_SQL = """(SELECT v.*, c.genre, c.area, CAST(isodow(v.visit_date) - 1 AS INTEGER) AS dow
  FROM visits_customer v JOIN customers_as_stores c ON v.store_id = c.store_id)"""


def q_lag_diff(spark, sf):
    v = A.visits_nation(spark, sf).select("store_id", "visit_date", "visitors")
    return RO.add_lag_diff(v, ["store_id"], "visit_date", "visitors")


SQL_LAG_DIFF = with_ctes("""
SELECT store_id, visit_date, visitors, lag(visitors) OVER w AS visitors_prev,
       visitors - lag(visitors) OVER w AS visitors_diff
FROM visits_nation WINDOW w AS (PARTITION BY store_id ORDER BY visit_date)""", "visits_nation")


def q_cal_weight(spark, sf):
    cal = A.date_info(A.visits_nation(spark, sf)).select("visit_date")
    return rounded(RO.calendar_position_weight(cal, "visit_date"))


SQL_CAL_WEIGHT = with_ctes(f"""
SELECT visit_date, {r('pow(row_number() OVER (ORDER BY visit_date) / count(*) OVER (), 5)')} AS weight
FROM date_info""", "date_info")


def q_max_minus(spark, sf):
    st = A.stores(spark, sf).select("store_id", "latitude", "longitude")
    return RO.max_minus(st, ["latitude", "longitude"])


SQL_MAX_MINUS = with_ctes("""
SELECT store_id, latitude, longitude, max(latitude) OVER () - latitude AS var_max_latitude,
       max(longitude) OVER () - longitude AS var_max_longitude FROM stores""", "stores")


QUERIES = {
    "dates_datepart": q_datepart,
    "dates_epoch_ms": q_epoch_ms,
    "dates_short_info": q_date_info_parts,
    "dates_arith_flags": q_date_arith,
    "dates_compose": q_compose,
    "dates_calendar": q_calendar,
    "events_elapsed": q_elapsed,
    "events_duration": q_duration,
    "events_calendar": q_calendar_events,
    "events_duplicate_keys": q_duplicates,
    "rolling_store_stats": q_roll_store,
    "rolling_store_dow_stats": q_roll_store_dow,
    "rolling_genre_area_dow_stats": q_roll_genre,
    "rolling_assembly": q_roll_assembly,
    "rolling_lag_diff": q_lag_diff,
    "rolling_calendar_weight": q_cal_weight,
    "rolling_max_minus": q_max_minus,
}


def oracle() -> dict[str, str]:
    return {
        "dates_datepart": SQL_DATEPART,
        "dates_epoch_ms": SQL_EPOCH_MS,
        "dates_short_info": SQL_DATE_INFO_PARTS,
        "dates_arith_flags": SQL_DATE_ARITH,
        "dates_compose": SQL_COMPOSE,
        "dates_calendar": SQL_CALENDAR,
        "events_elapsed": sql_elapsed(f"({SERIES_SQL})", ["user_id"], "flag", "date"),
        "events_duration": sql_duration(f"({SERIES_SQL})", ["user_id"], "flag", "date"),
        "events_calendar": sql_calendar_events(),
        "events_duplicate_keys": SQL_DUPLICATES,
        "rolling_store_stats": sql_rolling("visits_customer", ["store_id"], ("visits_customer",)),
        "rolling_store_dow_stats": sql_rolling(CUSTOMER_VISITS_SQL, ["store_id", "dow"], ("visits_customer", "customers_as_stores")),
        "rolling_genre_area_dow_stats": sql_rolling(CUSTOMER_VISITS_SQL, ["genre", "area", "dow"],
                                                    ("visits_customer", "customers_as_stores")),
        "rolling_assembly": sql_roll_assembly(),
        "rolling_lag_diff": SQL_LAG_DIFF,
        "rolling_calendar_weight": SQL_CAL_WEIGHT,
        "rolling_max_minus": SQL_MAX_MINUS,
    }
