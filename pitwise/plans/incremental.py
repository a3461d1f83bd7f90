"""Training sets that grow by pivots (O4, O86, O147): a new week builds only the pivots it touches.

The table lies in one folder per pivot (`end_date=...`), written with dynamic partition overwrite.  Beside it a small table
`_windows` says for every pivot how long its label window was, how many label rows it has and up to which day the data reached.  A pivot's
statistics come from days before it, so a new day can change only the pivots whose label window reaches it.

Files first, `_windows` last: a build that stops half-way leaves the old `_windows`, and the next build does the same pivots
again.  Rows of pivots that `_windows` doesn't name, or that have lost all label rows, are not read.  The holiday calendar is
given for the days ahead as well: a flag of a day that it lacked is not filled in later."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .pit import PitContext, labels, training_set

WINDOWS, COLUMNS = "_windows", "_columns"  # beside the pivots' folders; Spark doesn't read names with an underscore as data
FILE_ROWS = 1_000_000  # label rows of a file
_SCHEMA = "end_date date, days_in_label int, label_rows long, through date"


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """The pivots of the table at `path` (empty if there is none yet)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{WINDOWS}")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(_SCHEMA).parquet(f"{path}/{WINDOWS}") if there else spark.createDataFrame([], _SCHEMA)


def touched(windows: DataFrame, before: DataFrame, since: dt.date | None = None) -> DataFrame:
    """The windows to build: new ones, those of another length, and those whose label window reaches a day after the
    last build's data, or `since` (the first day on which older rows were corrected, if any were).

    A correction also changes the statistics of all later pivots, whose label windows reach beyond it as well."""
    known = before.select("end_date", F.col("days_in_label").alias("__days"), F.date_add("through", 1).alias("__from"))
    first = F.least("__from", F.lit(since).cast("date"))  # the nulls of either are left out
    same = F.col("days_in_label").eqNullSafe(F.col("__days")) & (F.date_add("end_date", F.col("days_in_label")) <= first)
    return windows.join(known, "end_date", "left").where(~F.coalesce(same, F.lit(False))).drop("__days", "__from")


def update(ctx: PitContext, path: str, build: Callable[[PitContext], DataFrame] = training_set,
           since: dt.date | None = None, history_days: int = 1000) -> DataFrame:
    """Brings the table at `path` to the windows of `ctx`; returns the pivots that were built.

    `build` makes a training set with a column end_date from a context; its features look back fewer than `history_days`
    days, so older daily rows are not read.  Null dates belong to no window."""
    spark = ctx.data.sparkSession
    before = spark.createDataFrame(recorded(spark, path).collect(), _SCHEMA)  # one row per pivot; `_windows` is replaced below
    todo = cut_lineage(touched(ctx.windows, before, since))
    n = todo.count()
    through = ctx.data.agg(F.max("visit_date")).scalar()
    if not n and not before.isEmpty():
        return todo.select("end_date")
    first = todo.agg(F.date_sub(F.min("end_date"), history_days)).scalar()
    part = PitContext(data=ctx.data.where(F.col("visit_date") > first), windows=todo, n_windows=n, calendar=ctx.calendar,
                      max_label_days=ctx.max_label_days)
    rows = cut_lineage(labels(part).groupBy("end_date").agg(F.count(F.lit(1)).alias("label_rows")))
    most = rows.agg(F.coalesce(F.max("label_rows"), F.lit(1))).scalar()
    made = build(part)
    # a pivot goes to as many tasks, and files, as its rows need
    piece = F.pmod(F.hash("store_id"), F.ceil(most / FILE_ROWS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (made.repartition(parts, "end_date", piece).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("end_date").parquet(path))
    made.limit(0).write.mode("overwrite").parquet(f"{path}/{COLUMNS}")
    built = todo.join(rows, "end_date", "left").select("end_date", "days_in_label", F.coalesce("label_rows", F.lit(0)).alias("label_rows"))
    kept = before.join(ctx.windows.select("end_date"), "end_date", "left_semi").join(todo.select("end_date"), "end_date", "left_anti")
    now = kept.select("end_date", "days_in_label", "label_rows").unionByName(built).withColumn("through", through)
    cut_lineage(now).coalesce(1).write.mode("overwrite").parquet(f"{path}/{WINDOWS}")  # one row per pivot
    return todo.select("end_date")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The training set at `path`: the rows of the pivots that `_windows` names."""
    named = recorded(spark, path).where("label_rows > 0").select("end_date")
    columns = spark.read.parquet(f"{path}/{COLUMNS}").schema
    return spark.read.schema(columns).parquet(path).join(F.broadcast(named), "end_date", "left_semi")  # one row per pivot
