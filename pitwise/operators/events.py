"""Event elapsed times and streaks as window expressions: O70-O74 (and O174).

The reference walks rows with a stateful Python object; here each output is a
window aggregate over the series ordered by date, partitioned by the series
keys.  A series without keys may be long, so it is scanned in segments: range partitions by date, each with
windows of its own, and what crosses their borders - the last event before, the next one after, the streak that runs
in and the one that runs out - from one summary row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def _segments(df: DataFrame, date_col: str) -> DataFrame:
    """The rows in range partitions by date, numbered in order; fixed once, as range bounds are sampled."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, date_col).withColumn("__seg", F.spark_partition_id()))


def _with_carry(segments: DataFrame, carry: list[tuple], fields: str) -> DataFrame:
    """Adds each partition's carry (one row per partition, so small)."""
    spark = segments.sparkSession
    return segments.join(F.broadcast(spark.createDataFrame(carry, f"__seg int, {fields}")), "__seg", "left")


def assert_unique(df: DataFrame, keys: list[str], date_col: str) -> None:
    """Refuse a series with repeated dates (an eager, distributed check)."""
    dup = df.groupBy(*keys, date_col).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"a series holds the same {date_col} more than once")


def duplicate_keys(df: DataFrame, keys: list[str], date_col: str) -> DataFrame:
    """O74 as a relation: the (key, date) pairs that occur more than once."""
    return (df.groupBy(*keys, date_col).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def add_elapsed(df: DataFrame, flag: str, date_col: str, keys: list[str] | None = None,
                prefixes=("af_", "be_")) -> DataFrame:
    """Days since the last event (af_) and to the next event (be_).

    Before the first event af_ is date - first event (negative); after the last
    event be_ is date - last event (positive).  Series without any event get null.
    """
    if not keys:
        return _elapsed_in_segments(df, flag, date_col, prefixes)
    w, whole = Window.partitionBy(*keys).orderBy(date_col), Window.partitionBy(*keys)
    ev = F.when(F.col(flag) == 1, F.col(date_col))
    last_ev = F.last(ev, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    next_ev = F.first(ev, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    first_all = F.min(ev).over(whole)
    last_all = F.max(ev).over(whole)
    return df.withColumns({
        prefixes[0] + flag: F.datediff(F.col(date_col), F.coalesce(last_ev, first_all)),
        prefixes[-1] + flag: F.datediff(F.col(date_col), F.coalesce(next_ev, last_all)),
    })


def _elapsed_in_segments(df: DataFrame, flag: str, date_col: str, prefixes) -> DataFrame:
    rows = _segments(df, date_col)
    ev = F.when(F.col(flag) == 1, F.col(date_col))
    ends = rows.groupBy("__seg").agg(F.min(ev).alias("lo"), F.max(ev).alias("hi")).where("lo is not null").orderBy("__seg").collect()
    segments = [r[0] for r in rows.select("__seg").distinct().collect()]
    first, last = (ends[0]["lo"], ends[-1]["hi"]) if ends else (None, None)
    carry = [(s, max((e["hi"] for e in ends if e["__seg"] < s), default=first), min((e["lo"] for e in ends if e["__seg"] > s), default=last))
             for s in segments]
    kind = df.schema[date_col].dataType.simpleString()
    w = Window.partitionBy("__seg").orderBy(date_col)
    last_ev = F.last(ev, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    next_ev = F.first(ev, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return _with_carry(rows, carry, f"__before {kind}, __after {kind}").withColumns({
        prefixes[0] + flag: F.datediff(F.col(date_col), F.coalesce(last_ev, F.col("__before"))),
        prefixes[-1] + flag: F.datediff(F.col(date_col), F.coalesce(next_ev, F.col("__after"))),
    }).drop("__seg", "__before", "__after")


def add_duration(df: DataFrame, flag: str, date_col: str, keys: list[str] | None = None,
                 prefix: str = "dur_") -> DataFrame:
    """Streak position, streak length and progress (0/0 -> 0) of flagged rows."""
    segmented = not keys
    if segmented:
        df, keys = _segments(df, date_col), ["__seg"]
    w = Window.partitionBy(*keys).orderBy(date_col)
    on = (F.col(flag) == 1).cast("int")
    # island id: number of unflagged rows so far (a streak shares it)
    isl = F.sum(1 - on).over(w.rowsBetween(Window.unboundedPreceding, 0))
    tmp = df.withColumn("__on", on).withColumn("__isl", F.coalesce(isl, F.lit(0)) if segmented else isl)
    wi = Window.partitionBy(*keys, "__isl").orderBy(date_col)
    pos = F.when(F.col("__on") == 1, F.sum("__on").over(wi.rowsBetween(Window.unboundedPreceding, 0))).otherwise(0)
    length = F.when(F.col("__on") == 1, F.sum("__on").over(Window.partitionBy(*keys, "__isl"))).otherwise(0)
    if segmented:
        tmp = _with_carry(tmp, _streak_carries(tmp), "__in long, __out long, __last long")
        leading, trailing = F.col("__isl") == 0, F.col("__isl") == F.col("__last")
        runs_in = F.when(F.col("__on") == 1, F.when(leading, F.col("__in")).otherwise(0)).otherwise(0)
        runs_out = F.when(F.col("__on") == 1, F.when(trailing, F.col("__out")).otherwise(0)).otherwise(0)
        pos, length = pos + runs_in, length + runs_in + runs_out
    out = tmp.withColumns({f"{prefix}time_{flag}": pos.cast("long"), f"{prefix}{flag}": length.cast("long")})
    prog = F.coalesce(F.try_divide(F.col(f"{prefix}time_{flag}"), F.col(f"{prefix}{flag}")), F.lit(0.0))
    return out.withColumn(f"{prefix}prog_{flag}", prog.cast("double")).drop("__on", "__isl", "__seg", "__in", "__out", "__last")


def _streak_carries(tmp: DataFrame) -> list[tuple]:
    """(partition, streak running into it, streak that goes on after it, its last island), from one row per partition."""
    islands = tmp.groupBy("__seg", "__isl").agg(F.coalesce(F.sum("__on"), F.lit(0)).alias("n"))
    ends = islands.groupBy("__seg").agg(F.max("__isl").alias("last"), F.max_by("n", "__isl").alias("trail"),
                                        F.max(F.when(F.col("__isl") == 0, F.col("n"))).alias("lead")).orderBy("__seg").collect()
    run, into = 0, []
    for e in ends:
        into.append(run)
        run = run + (e["lead"] or 0) if not e["last"] else e["trail"]
    run, out = 0, []
    for e in reversed(ends):
        out.append(run)
        run = run + (e["lead"] or 0) if not e["last"] else e["lead"] or 0
    return [(e["__seg"], i, o, e["last"]) for e, i, o in zip(ends, into, reversed(out))]


def event_flag_daily(events: DataFrame, event_type: str, key: str = "user_id",
                     ts: str = "ts") -> DataFrame:
    """Per (key, day) series with flag = 1 when an event of `event_type` happened that day."""
    return (events.groupBy(F.col(key).alias(key), F.to_date(ts).alias("date"))
            .agg(F.max((F.col("event_type") == event_type).cast("int")).alias("flag")))
