"""Driver-free global row numbering (used by splits, sampling, quotas, token indexes).

A `row_number()` over a whole table (or over a few huge groups) runs in one
task.  Instead: range-partition on (group, order) keys, sort inside each
partition, take the local position from `monotonically_increasing_id`
(partition id << 33 | position), count rows per (group, partition) - a table
with one row per partition - and add the prefix sum of earlier partitions of
the same group.  Every step is parallel; without groups the offsets table is
bounded by the partition count and broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

_LOCAL_MASK = (1 << 33) - 1


def join_groups(df: DataFrame, side: DataFrame, group_cols: list, plain_cols: list | None = None) -> DataFrame:
    """Inner join on group columns where a null group meets the null group of the other side (an equi-join all the
    same), and on never-null `plain_cols`; the key columns come once."""
    plain_cols = plain_cols or []
    keys = [*group_cols, *plain_cols]
    right = side.withColumnsRenamed({c: f"__r_{c}" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in group_cols] + [F.col(c) == F.col(f"__r_{c}") for c in plain_cols]
    return df.join(right, reduce(and_, same)).drop(*[f"__r_{c}" for c in keys])


def global_row_number(df: DataFrame, order_cols: list, group_cols: list | None = None,
                      out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """Add `out` = 1-based position of each row in `order_cols` order within `group_cols`.

    `order_cols` must make the order total (add a unique tie-break), so the
    numbering is deterministic and survives task retries.
    """
    group_cols = group_cols or []
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    tagged = ranged.withColumn("__mid", mid).withColumns(
        {"__pid": F.shiftright("__mid", 33), "__pos": F.col("__mid").bitwiseAND(F.lit(_LOCAL_MASK))}
    ).drop("__mid")
    # Range bounds are sampled from the input; with a shuffled input two evaluations could
    # disagree.  Materialise the tagged rows once (reliable checkpoint, survives executor loss).
    tagged = cut_lineage(tagged)
    # position within (group, partition): local position minus the first position of the group there
    counts = tagged.groupBy(*group_cols, "__pid").agg(F.count(F.lit(1)).alias("__n"),
                                                     F.min("__pos").alias("__p0"))
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy("__pid")
    offsets = counts.select(*group_cols, "__pid", "__p0",
                            (F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("__off"))
    offsets = offsets.fillna(0, subset=["__off"])
    # without groups: one row per partition (bounded by the partition count) -> broadcast;
    # with groups it grows with the number of groups, so the planner/AQE decides
    j = join_groups(tagged, offsets if group_cols else F.broadcast(offsets), group_cols, ["__pid"])
    return j.withColumn(out, (F.col("__off") + F.col("__pos") - F.col("__p0") + 1).cast("long")).drop(
        "__pid", "__pos", "__p0", "__off")


def global_prefix_sum(df: DataFrame, order_cols: list, value_col: str | list[str], group_cols: list | None = None,
                      out: str | list[str] = "offset", num_partitions: int | None = None) -> DataFrame:
    """Add `out` = sum of `value_col` over all earlier rows (exclusive prefix sum) within `group_cols`; of several columns at once
    if both are lists.

    Two levels: a window over each (range partition, group), then the totals of the partitions before (one row per
    partition and group), joined back.  A hot group is spread over as many range partitions as its rows fill.
    """
    group_cols = group_cols or []
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    # range bounds are sampled, so the partition of a row is fixed once, in a reliable checkpoint
    tagged = cut_lineage(df.repartitionByRange(n, *keys).withColumn("__pid", F.spark_partition_id()))
    sums = dict(zip(out, value_col)) if isinstance(out, list) else {out: value_col}
    value = {o: F.coalesce(F.col(c), F.lit(0)) for o, c in sums.items()}
    earlier = Window.partitionBy("__pid", *group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumns({f"__local_{o}": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for o, v in value.items()})
    totals = tagged.groupBy(*group_cols, "__pid").agg(*[F.sum(v).cast("long").alias(f"__t_{o}") for o, v in value.items()])
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*group_cols, "__pid", *[F.coalesce(F.sum(f"__t_{o}").over(w), F.lit(0)).alias(f"__poff_{o}") for o in sums])
    j = join_groups(local, offs if group_cols else F.broadcast(offs), group_cols, ["__pid"])
    return j.withColumns({o: (F.col(f"__poff_{o}") + F.col(f"__local_{o}")).cast("long") for o in sums}).drop(
        "__pid", *[f"__{x}_{o}" for o in sums for x in ("local", "poff")])
