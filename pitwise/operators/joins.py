"""Joins and set operations: O23-O37, O53-O60, O85-O90.

Dimension look-ups are left to the planner (AQE turns a small side into a
broadcast at run time); explicit `broadcast` is used only on calendars and
other tables whose size is bounded by a constant or the calendar span.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from .clean import group_quantiles
from .ordering import global_row_number


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """merge(how='left') without keys = on all common columns."""
    on = sorted(set(left.columns) & set(right.columns))
    return left.join(right, on, "left")


def left_then_right(a: DataFrame, b: DataFrame, c: DataFrame, on_ab: list[str], on_bc: list[str],
                    rename: dict[str, str] | None = None) -> DataFrame:
    """A LEFT JOIN b, then RIGHT JOIN c; suffix clean-up by rename."""
    out = a.join(b, on_ab, "left").join(c, on_bc, "right")
    return out.withColumnsRenamed(rename) if rename else out


def map_inner(df: DataFrame, id_map: DataFrame, left_key: str, map_key: str) -> DataFrame:
    """Keep only rows whose key is in the id map (and take its mapped columns)."""
    return df.join(id_map, df[left_key] == id_map[map_key], "inner").drop(id_map[map_key])


def map_with_fallback(df: DataFrame, id_map: DataFrame, key: str, map_key: str, mapped: str,
                      out: str | None = None) -> DataFrame:
    """`map(id_map).fillna(original)` = left join + coalesce(mapped, original)."""
    m = id_map.select(F.col(map_key).alias("__k"), F.col(mapped).alias("__m"))
    j = df.join(m, df[key] == m["__k"], "left")
    return j.withColumn(out or key, F.coalesce(F.col("__m").cast(df.schema[key].dataType), F.col(key))).drop(
        "__k", "__m")


def semi(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """isin(...) as a left-semi join."""
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """~isin(...) as a left-anti join."""
    return df.join(keys, on, "left_anti")


def time_weighted_visitors(visits: DataFrame, cal: DataFrame, power: int = 5) -> DataFrame:
    """Weighted mean of log1p(visitors) by (store, day_of_week, holiday_flg).

    Calendar weight ((i+1)/n)^power; holidays on Saturday/Sunday are demoted.
    """
    from .rolling import calendar_position_weight
    c = calendar_position_weight(cal.select("visit_date", "day_of_week", "holiday_flg"), "visit_date", power)
    c = c.withColumn("holiday_flg", F.when(F.col("day_of_week").isin("Saturday", "Sunday"), 0)
                     .otherwise(F.col("holiday_flg")))
    v = visits.join(F.broadcast(c), "visit_date", "left")  # calendar-sized
    return (v.groupBy("store_id", "day_of_week", "holiday_flg")
            .agg(S.weighted_mean("weight", F.log1p("visitors")).alias("visitors")))


def hierarchical_fallback(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(store, dow, hol) -> (store, dow, hol=0) -> store mean of the table."""
    t1 = table.select("store_id", "day_of_week", "holiday_flg", F.col("visitors").alias("__v1"))
    t2 = table.where(F.col("holiday_flg") == 0).select("store_id", "day_of_week", F.col("visitors").alias("__v2"))
    t3 = table.groupBy("store_id").agg(F.avg("visitors").alias("__v3"))
    j = (rows.join(t1, ["store_id", "day_of_week", "holiday_flg"], "left")
         .join(t2, ["store_id", "day_of_week"], "left").join(t3, ["store_id"], "left"))
    return j.withColumn("visitors", F.coalesce("__v1", "__v2", "__v3")).drop("__v1", "__v2", "__v3")


def dual_calendar(res: DataFrame, cal: DataFrame) -> DataFrame:
    """The calendar joined on the visit date and on the reserve date, flags renamed."""
    c = F.broadcast(cal.select("visit_date", "holiday_flg"))  # calendar-sized
    r = res.withColumns({"visit_date": F.to_date("visit_datetime"), "reserve_date": F.to_date("reserve_datetime")})
    r = r.join(c.withColumnRenamed("holiday_flg", "visit_holiday_flg"), "visit_date", "left")
    c2 = c.select(F.col("visit_date").alias("reserve_date"), F.col("holiday_flg").alias("reserve_holiday_flg"))
    return r.join(c2, "reserve_date", "left")


def two_system_union(res: DataFrame, stores: DataFrame) -> DataFrame:
    """The rows of both systems with a common schema, one pass: the columns of one system are null in the other's rows."""
    air = F.col("system") == "air"
    j = res.where(F.col("system").isin("air", "hpg")).join(stores, "store_id", "left")
    places = {f"hpg_{c}": F.when(~air, F.col(c)) for c in ("latitude", "longitude")}
    only_air = {c: F.when(air, F.col(c)) for c in ("air_area_name", "latitude", "longitude")}
    return (j.withColumns(places).withColumns(only_air).withColumn("src", F.col("system"))
            .withColumnsRenamed({"air_genre_name": "genre_name", "air_area_name": "area_name"}))


def last_writer_wins(base: DataFrame, keys: list[str], *tables: DataFrame) -> DataFrame:
    """Key join of feature tables; a column present in several tables takes the last one."""
    owner: dict[str, int] = {}
    for i, t in enumerate(tables):
        for c in t.columns:
            if c not in keys:
                owner[c] = i
    out = base.alias("b")
    for i, t in enumerate(tables):
        cols = [c for c in t.columns if c not in keys and owner[c] == i]
        out = out.join(t.select(*keys, *cols), keys, "left")
    return out


def prior_period(visits: DataFrame, days: int = 365, value: str = "visitors") -> DataFrame:
    """Value `days` earlier by equi-join on date_sub."""
    prev = visits.select("store_id", F.date_add("visit_date", days).alias("visit_date"),
                         F.col(value).alias(f"{value}_prev{days}"))
    return visits.join(prev, ["store_id", "visit_date"], "left")


def weekday_summary(visits: DataFrame) -> DataFrame:
    """min/mean/median/max/size by store x weekday."""
    v = visits.withColumn("dow", F.weekday("visit_date"))
    return v.groupBy("store_id", "dow").agg(
        F.min("visitors").alias("min_visitors"), F.avg("visitors").alias("mean_visitors"),
        F.percentile("visitors", 0.5).alias("median_visitors"), F.max("visitors").alias("max_visitors"),
        F.count(F.lit(1)).alias("count_observations"))


def store_weekday_grid(store_ids: DataFrame, summary: DataFrame) -> DataFrame:
    """Every store x 7 weekdays (a 7-row generator, not a cross join) + weekday summary."""
    g = store_ids.select("store_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dow"))
    return g.join(summary, ["store_id", "dow"], "left")


def group_mean_default(history: DataFrame, future: DataFrame, key: str, value: str) -> DataFrame:
    """Future rows get the key mean of history (inner join drops unseen keys), then union."""
    m = history.groupBy(key).agg(F.avg(value).alias(value))
    fut = future.drop(value).join(m, key, "inner")
    return history.unionByName(fut, allowMissingColumns=True)


def reserve_sum_mean(res: DataFrame) -> DataFrame:
    """Per (store, day, system) sums (rs1, rv1) and means (rs2, rv2) of lead days and party size."""
    r = res.select("store_id", "system", F.to_date("visit_datetime").alias("visit_date"),
                   F.datediff(F.to_date("visit_datetime"), F.to_date("reserve_datetime")).alias("dd"),
                   "reserve_visitors")
    return r.groupBy("store_id", "visit_date", "system").agg(
        F.sum("dd").cast("long").alias("rs1"), F.sum("reserve_visitors").cast("long").alias("rv1"),
        F.avg("dd").alias("rs2"), F.avg("reserve_visitors").alias("rv2"))


def cross_system_totals(per_system: DataFrame) -> DataFrame:
    """Air (x) and hpg (y) side by side; totals null when either side is missing."""
    names = ("rs1", "rv1", "rs2", "rv2")
    side = lambda c, s: F.max(F.when(F.col("system") == s, F.col(c))).alias(f"{c}_{s}")  # noqa: E731  one row per system
    j = per_system.where(F.col("system").isin("air", "hpg")).groupBy("store_id", "visit_date").agg(
        *[side(c, s) for c in names for s in ("air", "hpg")])
    both = lambda c: F.col(f"{c}_air") + F.col(f"{c}_hpg")
    return j.select("store_id", "visit_date", both("rv1").alias("total_reserv_sum"), (both("rv2") / 2).alias("total_reserv_mean"),
                    (both("rs2") / 2).alias("total_reserv_dt_diff_mean"))


def attr_static(rows: DataFrame, stats_src: DataFrame, key: str, value: str = "visitors",
                name: str = "visits") -> DataFrame:
    """min/max/mean/std/median of a value per attribute (null attribute dropped), joined back."""
    agg = (stats_src.where(F.col(key).isNotNull()).groupBy(key)
           .agg(F.min(value).cast("double").alias(f"min_{name}_in_{key}"),
                F.max(value).cast("double").alias(f"max_{name}_in_{key}"),
                F.avg(value).alias(f"mean_{name}_in_{key}"),
                F.stddev_samp(value).alias(f"std_{name}_in_{key}")))
    median = group_quantiles(stats_src.where(F.col(key).isNotNull()), [key], value, {f"median_{name}_in_{key}": 0.5}).drop("count")
    return rows.join(agg.join(median, key, "left"), key, "left")


def population_count(df: DataFrame, group: str, id_col: str = "store_id") -> DataFrame:
    """Number of ids per group, joined back; a null group gets null."""
    cnt = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(id_col).alias(f"stores_in_{group}"))
    return df.join(cnt, group, "left")


def outer_union(*frames: DataFrame) -> DataFrame:
    """Union by name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def quota_mix(sources: dict[str, DataFrame], quotas: dict[str, int], order_col: str) -> DataFrame:
    """Batches drawn in fixed quotas from several sources; the short tail is dropped.

    Batch b takes rows (b*q, (b+1)*q] of each source in `order_col` order; only
    batches that every source can fill are kept.
    """
    tagged = outer_union(*[df.withColumn("src", F.lit(name)) for name, df in sources.items()])
    ranked = global_row_number(tagged, [order_col], ["src"])
    q = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    ranked = ranked.withColumn("batch", F.floor((F.col("rn") - 1) / q[F.col("src")]).cast("long"))
    full = ranked.groupBy("src", "batch").agg(F.count(F.lit(1)).alias("__n"))
    full = full.where(F.col("__n") == q[F.col("src")]).groupBy("batch").agg(F.count(F.lit(1)).alias("__k"))
    full = full.where(F.col("__k") == len(sources)).select("batch")
    return ranked.join(full, "batch", "left_semi")
