"""Point-in-time (pivot-window) training sets: O17, O18, O27, O31, O38-O52, O110, O146, O147.

Data model
----------
* `data`     one row per (store_id, visit_date): visitors = log1p(count), dow (Mon=0),
             genre, holiday flags.  Daily pre-aggregation bounds every statistic
             group (pivot, store) by the horizon length, so no store can be hot.
* `windows`  (end_date, days_in_label): weekly pivots (O146).  Its size is bounded
             by calendar span / step, never by data volume.
* statistic calendar  windows x age 1..H-1 -> (visit_date, end_date, age)
* label calendar      windows x day 0..L-1  -> (visit_date, end_date)

Both calendars turn the range join "visit inside the window of a pivot" (O38)
into an equi-join on visit_date.  They are broadcast when their row count,
checked against `BROADCAST_ROWS`, allows it; otherwise the planner shuffles on
visit_date and AQE splits hot dates.  The daily rows are partitioned by store
once; store-keyed families form their windows as ranges of the sorted series (plans.pivots),
so only the daily rows are shuffled and none is copied once per pivot that sees it.
Genre families, whose few groups span all stores, first count the days of each (pivot,
genre, value) and take all statistics, the exact median too, from these counts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats as S
from ..session import cut_lineage, staged
from .pivots import feature_columns, label_features, pivot_features

# Largest calendar map (rows) we broadcast; beyond it the join shuffles on the date.
BROADCAST_ROWS = 4_000_000
# Largest family without stores (rows x columns) that label rows look up in a broadcast; beyond it the join shuffles.
LOOKUP_CELLS = 8_000_000

# Horizons (days) of the feature families.
STORE_HORIZONS = (1000, 56, 28, 14)
GENRE_HORIZONS = (1000, 56, 28)
DIFF_HORIZONS = (58, 1000)
AHEAD_SHIFTS = (3, 2, 1, -1)
RATIO_SMOOTHING = 0.01
RESERVE_KEYS = ("end_date", "store_id", "visit_date")
# (name, numerator column, denominator column) of the second-order rates.
RATIOS = (  # fixed values
    ("store_mean_14_28_rate", "store_mean14", "store_mean28"),
    ("store_mean_28_56_rate", "store_mean28", "store_mean56"),
    ("store_mean_56_1000_rate", "store_mean56", "store_mean1000"),
    ("genre_mean_28_56_rate", "genre_mean28", "genre_mean56"),
    ("sgenre_mean_56_1000_rate", "genre_mean56", "genre_mean1000"),
)


# ----------------------------------------------------------------------------- inputs
def pit_data(visits: DataFrame, stores: DataFrame | None = None,
             calendar: DataFrame | None = None, value: str = "visitors",
             log1p: bool = True) -> DataFrame:
    """The unified fact table: (store_id, visit_date, visitors[, genre, area, holiday flags])."""
    v = F.log1p(value) if log1p else F.col(value).cast("double")
    d = visits.select("store_id", "visit_date", v.alias("visitors"),
                      F.weekday("visit_date").alias("dow"))
    if stores is not None:
        d = d.join(stores.select("store_id", "air_genre_name", "air_area_name"), "store_id", "left")
    if calendar is not None:
        # calendar: one row per day of the span -> bounded, safe to broadcast
        d = d.join(F.broadcast(calendar.select("visit_date", "holiday_flg", "holiday_flg2")),
                   "visit_date", "left")
    return d


def pivot_windows(data: DataFrame, pivot_date: str, end_date: str, step: int = 7,
                  days_in_label: int = 39, min_stat_days: int = 37) -> DataFrame:
    """O146: weekly pivots before `pivot_date` (fixed label length), then shrinking ones after it."""
    p = F.lit(pivot_date).cast("date")
    e = F.lit(end_date).cast("date")
    b = data.agg(F.min("visit_date").alias("d0"))
    n_before = F.floor((F.datediff(p, "d0") - min_stat_days) / step).cast("int")
    before = b.select(
        F.explode(F.when(n_before > 0, F.sequence(F.lit(0), n_before - 1))
                  .otherwise(F.array().cast("array<int>"))).alias("k"), "d0")
    before = before.select(F.date_add(F.date_add("d0", min_stat_days), F.col("k") * step).alias("end_date"),
                           F.lit(days_in_label).alias("days_in_label"))
    unit = days_in_label - days_in_label % step
    n_after = F.floor(F.datediff(e, p) / step).cast("int")
    after = b.select(F.explode(F.when(n_after > 0, F.sequence(F.lit(0), n_after - 1))
                               .otherwise(F.array().cast("array<int>"))).alias("k"))
    after = after.select(F.date_add(p, (F.col("k") + 1) * step).alias("end_date"),
                         (F.lit(unit) - F.col("k") * step).cast("int").alias("days_in_label"))
    return before.unionByName(after)


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def stat_calendar(windows: DataFrame, max_horizon: int) -> DataFrame:
    """(visit_date, end_date, age) for ages 1 .. max_horizon-1: the open window of O18."""
    return windows.select(
        "end_date", F.explode(F.sequence(F.lit(1), F.lit(max_horizon - 1))).alias("age")
    ).select(F.date_sub("end_date", F.col("age")).alias("visit_date"), "end_date", "age")


def label_calendar(windows: DataFrame) -> DataFrame:
    """(visit_date, end_date, days_in_label) for the half-open label window of O17."""
    return windows.where(F.col("days_in_label") > 0).select(
        "end_date", "days_in_label",
        F.explode(F.sequence(F.lit(0), F.col("days_in_label") - 1)).alias("j")
    ).select(F.date_add("end_date", F.col("j")).alias("visit_date"), "end_date", "days_in_label")


@dataclass
class PitContext:
    """Inputs shared by all feature families of one build; `data` is partitioned by store."""

    data: DataFrame
    windows: DataFrame
    n_windows: int
    calendar: DataFrame | None = None
    max_label_days: int = 39
    labelled: bool = False  # store families only of the (pivot, series) pairs that have label rows

    @cached_property
    def pivots(self) -> dict:
        """The pivot dates and the lengths of their label windows; as many as the calendar has steps, whatever the data."""
        ends = self.windows.where("end_date is not null").groupBy("end_date").agg(F.max("days_in_label"))
        return {p: days or 0 for p, days in ends.collect()}

    @cached_property
    def label_windows(self) -> list[tuple]:
        """(pivot date, label days) of the windows that have any."""
        return [tuple(r) for r in self.windows.where("end_date is not null and days_in_label > 0").select("end_date", "days_in_label").collect()]

    def at_labels(self) -> "PitContext":
        """For features that label rows alone look up by the family's own keys."""
        return replace(self, labelled=True)

    def family(self, keys: list[str], *features, data: DataFrame | None = None) -> DataFrame:
        """Features (plans.pivots) of one key family; its first key is the store."""
        return pivot_features(data if data is not None else self.data, list(self.pivots), keys, features,
                              list(self.pivots.values()) if self.labelled else None)

    def history(self, max_horizon: int = 1000, data: DataFrame | None = None) -> DataFrame:
        """Every (pivot, visit) pair with 1 <= age <= max_horizon-1, as an equi-join."""
        cal = stat_calendar(self.windows, max_horizon)
        cal = _maybe_broadcast(cal, self.n_windows * max_horizon)
        return (data if data is not None else self.data).join(cal, "visit_date")

    def label_rows(self, data: DataFrame | None = None) -> DataFrame:
        cal = label_calendar(self.windows)
        cal = _maybe_broadcast(cal, self.n_windows * self.max_label_days)
        return (data if data is not None else self.data).join(cal, "visit_date")


def make_context(data: DataFrame, pivot_date: str, end_date: str, step: int = 7,
                 days_in_label: int = 39, min_stat_days: int = 37,
                 calendar: DataFrame | None = None, by_store: DataFrame | None = None) -> PitContext:
    """Partition `data` by store and build the windows.

    The partition count is the session's shuffle setting and is kept by AQE, since the rows fan out
    after the exchange.  `by_store`: the same rows already partitioned by store by an exchange of that kind; then there is no other."""
    w = pivot_windows(data, pivot_date, end_date, step, days_in_label, min_stat_days)
    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = w.count()  # bounded by calendar span / step; sizes the broadcast decision
    return PitContext(data=data.repartition(parts, "store_id") if by_store is None else by_store, windows=w, n_windows=n, calendar=calendar,
                      max_label_days=max(days_in_label, 1))


# ----------------------------------------------------------------------------- labels
def labels(ctx: PitContext, calendar: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """O17 + O31: label rows of every window (or those given) with day offset, month, year and shifted holiday flags."""
    lab = ctx.label_rows().drop("days_in_label") if rows is None else rows
    lab = lab.select("*", F.datediff("visit_date", "end_date").alias("diff_of_day"),
                     F.month("visit_date").alias("month"), F.year("visit_date").alias("year"))
    cal = calendar if calendar is not None else ctx.calendar
    if cal is not None:
        # shifted flags are joined on the calendar itself (exact on gaps, calendar-sized), so each
        # label row needs one broadcast join instead of four
        aheads = cal.select("visit_date")
        for i in AHEAD_SHIFTS:
            tag = str(i) if i >= 0 else f"m{-i}"
            shifted = cal.select(F.date_add("visit_date", i).alias("visit_date"),
                                 F.col("holiday_flg").alias(f"ahead_holiday_{tag}"),
                                 F.col("holiday_flg2").alias(f"ahead_holiday2_{tag}"))
            aheads = aheads.join(shifted, "visit_date", "left")
        lab = lab.join(F.broadcast(aheads), "visit_date", "left")
    return lab


# ----------------------------------------------------------------------------- families
def exp_aggs(prefix: str, horizon: int, rate: float = S.DEFAULT_DECAY) -> list[Column]:
    """Decayed mean and its weight sum over rows that stand for `days` each."""
    x = S.within("age", horizon, F.col("visitors"))
    w = S.decay_weight("age", rate) * F.col("days")
    num, den = F.sum(x * w), F.sum(F.when(x.isNotNull(), w))
    return [(num / den).alias(f"{prefix}_exp_mean{horizon}"), den.alias(f"{prefix}_exp_weight_sum{horizon}")]


def decayed(prefix: str, horizon: int, rate: float = S.DEFAULT_DECAY) -> tuple:
    """Decayed mean and its weight sum."""
    return "decay", horizon, ((f"{prefix}_exp_mean{horizon}", f"{prefix}_exp_weight_sum{horizon}", None, rate, rate),)


def dow_decayed(horizon: int = 1000, rates=S.DECAY_RATES) -> tuple:
    """For each rate the decayed mean, its weight sum, and mean2, weighed by the product of the rates so far."""
    specs, product = [], 1.0
    for r in rates:
        product *= r
        tag = f"{horizon}_{S.rate_name(r)}"
        specs.append((f"store_dow_exp_mean{tag}", f"store_dow_exp_weight_sum{tag}", f"store_dow_exp_mean2{tag}", r, product))
    return "decay", horizon, tuple(specs)


def counted_family(hist: DataFrame, keys: list[str], prefix: str, horizons) -> DataFrame:
    """The seven statistics for groups that span many stores, from counts (`days`) per value.

    The first aggregation leaves one row per (pivot, group, value), with partial sums on the map side; the
    order statistics and central moments then come from windows over the values of a group, so no group keeps a buffer
    of its days."""
    group = ["end_date", *keys]
    v = F.col("visitors")
    counts = hist.groupBy(*group, "visitors").agg(
        *[F.coalesce(F.sum(F.when((F.col("age") < n) & v.isNotNull(), F.col("days"))), F.lit(0)).alias(f"c{n}") for n in horizons])
    whole = Window.partitionBy(*group)
    before = whole.orderBy("visitors").rowsBetween(Window.unboundedPreceding, -1)
    parts, aggs = {}, []
    for n in horizons:
        c = F.col(f"c{n}")
        parts |= {f"n{n}": F.sum(c).over(whole), f"b{n}": F.coalesce(F.sum(c).over(before), F.lit(0)),
                  f"m{n}": F.try_divide(F.sum(c * v).over(whole), F.sum(c).over(whole))}
        size, mean, at = F.max(f"n{n}"), F.max(f"m{n}"), F.col(f"b{n}")
        here = F.when(c > 0, v)
        middle = [F.sum(F.when((at <= p) & (p < at + c), v)) for p in (F.floor((F.col(f"n{n}") - 1) / 2), F.ceil((F.col(f"n{n}") - 1) / 2))]
        square, cube = (F.sum(c * F.pow(v - F.col(f"m{n}"), k)) for k in (2, 3))
        skew = F.try_divide(F.sqrt(size * (size - 1)) * F.try_divide(cube, size), (size - 2) * F.pow(F.try_divide(square, size), 1.5))
        values = {"min": F.min(here).cast("double"), "mean": mean, "median": (middle[0] + middle[1]) / 2,
                  "max": F.max(here).cast("double"), "count": size,
                  "std": F.when(size > 1, F.sqrt(F.try_divide(square, size - 1))),
                  "skew": F.when(size < 3, F.lit(None).cast("double")).when(F.max(here) == F.min(here), 0.0).otherwise(skew)}
        aggs += [values[name].alias(f"{prefix}_{name}{n}") for name in S.SUMMARY7]
    return counts.withColumns(parts).groupBy(*group).agg(*aggs)


def store_visitor_feat(ctx: PitContext, horizons=STORE_HORIZONS) -> DataFrame:
    return ctx.family(["store_id"], ("summary", "store", tuple(horizons)))


def store_week_feat(ctx: PitContext, horizons=STORE_HORIZONS) -> DataFrame:
    return ctx.family(["store_id", "dow"], ("summary", "store_dow", tuple(horizons)))


def _genre_days(ctx: PitContext, keys: list[str]) -> DataFrame:
    """The stores' days of a date, group and value as one row with their number, before the date meets its pivots: what is
    copied once per pivot then doesn't grow with the stores of a group."""
    return ctx.data.where(F.col("air_genre_name").isNotNull()).groupBy("visit_date", *keys, "visitors").agg(F.count(F.lit(1)).alias("days"))


def genre_visitor_feat(ctx: PitContext, horizons=GENRE_HORIZONS) -> DataFrame:
    h = ctx.history(max(horizons), _genre_days(ctx, ["air_genre_name"]))
    return counted_family(h, ["air_genre_name"], "genre", horizons)


def genre_week_feat(ctx: PitContext, horizons=GENRE_HORIZONS) -> DataFrame:
    h = ctx.history(max(horizons), _genre_days(ctx, ["air_genre_name", "dow"]))
    return counted_family(h, ["air_genre_name", "dow"], "genre_dow", horizons)


def store_holiday_feat(ctx: PitContext, horizon: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Two families, keyed by the two holiday-flag definitions."""
    return (ctx.family(["store_id", "holiday_flg"], ("summary", "store_holiday", (horizon,))),
            ctx.family(["store_id", "holiday_flg2"], ("summary", "store_holiday2", (horizon,))))


def exp_family(hist: DataFrame, keys: list[str], prefix: str, horizon: int,
               rate: float = S.DEFAULT_DECAY) -> DataFrame:
    return hist.groupBy("end_date", *keys).agg(*exp_aggs(prefix, horizon, rate))


def store_exp_feat(ctx: PitContext, horizon: int = 1000) -> DataFrame:
    return ctx.family(["store_id"], decayed("store", horizon))


def genre_exp_feat(ctx: PitContext, horizon: int = 1000) -> DataFrame:
    h = ctx.history(horizon, _genre_days(ctx, ["air_genre_name"]))
    return exp_family(h, ["air_genre_name"], "genre", horizon)


def genre_week_exp_feat(ctx: PitContext, horizon: int = 1000) -> DataFrame:
    h = ctx.history(horizon, _genre_days(ctx, ["air_genre_name", "dow"]))
    return exp_family(h, ["air_genre_name", "dow"], "genre_dow", horizon)


def store_week_exp_feat(ctx: PitContext, horizon: int = 1000, rates=S.DECAY_RATES) -> DataFrame:
    """For each rate, the decayed mean and the cumulative-product variant (mean2)."""
    return ctx.family(["store_id", "dow"], dow_decayed(horizon, rates))


def store_all_week_feat(ctx: PitContext, horizon: int = 1000) -> DataFrame:
    """Per store a wide weekday profile: {i}store_dow_{mean,median,sum(=max),count}, {i}dow."""
    return ctx.family(["store_id"], ("profile", horizon))


def with_previous_date(data: DataFrame) -> DataFrame:
    """Adds prev_date / diff for O49: v(d) - v(previous global date), only when the store has both.

    The global date order comes from the distinct dates (a calendar-sized table);
    the per-store lag is partitioned by store.
    """
    dates = data.select("visit_date").distinct()
    # calendar-sized (bounded by span days): the only unpartitioned window allowed
    ranked = dates.select("visit_date", F.dense_rank().over(Window.orderBy("visit_date")).alias("date_rank"))
    d = data.join(F.broadcast(ranked), "visit_date")
    w = Window.partitionBy("store_id").orderBy("visit_date")
    prev_rank = F.lag("date_rank").over(w)
    return d.select("*", F.lag("visit_date").over(w).alias("prev_date"),
                    F.when(prev_rank == F.col("date_rank") - 1,
                           F.col("visitors") - F.lag("visitors").over(w)).alias("diff"))


def store_week_diff_feat(ctx: PitContext, horizons=DIFF_HORIZONS) -> DataFrame:
    """Mean |diff|, std, max, min of consecutive-date differences per horizon."""
    return ctx.family(["store_id"], ("diff", tuple(horizons)), data=with_previous_date(ctx.data))


def first_last_time_feat(ctx: PitContext, horizon: int = 1000) -> DataFrame:
    """Pivot - first and pivot - last visit date in the window."""
    return ctx.family(["store_id"], ("first_last", horizon))


def reserve_feat(ctx: PitContext, reserves: DataFrame) -> DataFrame:
    """Reservations for label days booked before the pivot, per system.

    Returns one row per (end_date, store_id, visit_date) with store/day sums,
    counts and mean lead times, plus per-day totals (joined by key at label time).
    """
    r = reserves.select("store_id", "system", "reserve_visitors",
                        F.to_date("visit_datetime").alias("visit_date"),
                        F.to_date("reserve_datetime").alias("reserve_date"),
                        F.floor((F.unix_timestamp("visit_datetime") - F.unix_timestamp("reserve_datetime"))
                                / 86400).cast("int").alias("diff_time"))
    r = ctx.label_rows(data=r).where(F.col("reserve_date") < F.col("end_date"))
    aggs = []
    for s in ("air", "hpg"):
        rv = F.when(F.col("system") == s, F.col("reserve_visitors"))
        dt = F.when(F.col("system") == s, F.col("diff_time"))
        aggs += [F.sum(rv).cast("double").alias(f"{s}_reserve_visitors"),
                 F.count(rv).alias(f"{s}_reserve_count"),
                 F.avg(dt).alias(f"{s}_store_diff_time_mean"),
                 F.sum(dt).alias(f"__{s}_lead"), F.count(dt).alias(f"__{s}_leads")]
    return r.groupBy("end_date", "store_id", "visit_date").agg(*aggs)


def reserve_date_feat(store_day: DataFrame) -> DataFrame:
    """Per (end_date, visit_date) totals and mean lead times from the parts of the per-store table."""
    aggs = []
    for s in ("air", "hpg"):
        aggs += [F.sum(f"{s}_reserve_visitors").alias(f"{s}_date_visitors"),
                 F.sum(f"{s}_reserve_count").alias(f"{s}_date_count"),
                 F.try_divide(F.sum(f"__{s}_lead"), F.sum(f"__{s}_leads")).alias(f"{s}_diff_time_mean")]
    return store_day.groupBy("end_date", "visit_date").agg(*aggs)


def reserve_store_day(parts: DataFrame) -> DataFrame:
    """The per-store table without the sums that only the per-day table needs."""
    return parts.drop(*[f"__{s}_{x}" for s in ("air", "hpg") for x in ("lead", "leads")])


# ----------------------------------------------------------------------------- assembly
def co_partition(spark: SparkSession) -> None:
    """Lets a join on (pivot, store, ...) keep a side that is partitioned by store alone.

    Spark asks by default for a partitioning by all join keys and so would shuffle the widening label table at every family.  The
    session setting has to hold when the plan runs; a store's rows per pivot are bounded, so no partition gets hot by it."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def look_up(feats: DataFrame) -> DataFrame:
    """A family without stores (pivot x genre, weekday or day): written once, and broadcast if its checked size allows it."""
    feats = cut_lineage(feats)
    return F.broadcast(feats) if feats.count() * len(feats.columns) <= LOOKUP_CELLS else feats


def attach(label: DataFrame, feats: DataFrame, keys: list[str]) -> DataFrame:
    """O27 left_merge by key: every label row kept, missing features -> 0.

    The label table stays partitioned by store: families keyed by store are brought to it, the others looked up.  The former are
    merged whatever Spark makes of their size: it takes them for as small as the daily rows they come from, and would broadcast
    them through the driver."""
    fcols = [c for c in feats.columns if c not in keys and c != "end_date"]
    out = label.join(feats.hint("merge") if "store_id" in keys else look_up(feats), ["end_date", *keys], "left")
    return out.na.fill(0, subset=fcols)


def second_feat(df: DataFrame) -> DataFrame:
    """O110: smoothed ratios of means (only those whose inputs are present)."""
    cols = {name: F.col(a) / (F.col(b) + RATIO_SMOOTHING)
            for name, a, b in RATIOS if a in df.columns and b in df.columns}
    return df.withColumns(cols) if cols else df


def training_set(ctx: PitContext, families: list | None = None, store_families: list | None = None, reserves: DataFrame | None = None) -> DataFrame:
    """O147: label rows of every window with the requested feature families and ratios.

    `families` is a list of (feature DataFrame, key columns) produced by the
    family functions above (O172 plug-in surface); default: store and genre
    statistics, decayed store mean and first/last activity.  `store_families` are (keys, features of plans.pivots) whose first key is
    the store: they are formed with the label rows, in one pass over the sorted series.  `reserves`: the table of reserve_feat,
    brought to the daily rows, as a list by pivot, before these become label rows.
    """
    co_partition(ctx.data.sparkSession)
    if families is None:
        store_families = [(["store_id"], (("summary", "store", STORE_HORIZONS), decayed("store", 1000), ("first_last", 1000)))]
        families = [(genre_visitor_feat(ctx), ["air_genre_name"])]
    if store_families:
        data, made = ctx.data, [n for _, features in store_families for n, _ in feature_columns(features)]
        kept = ["visit_date", *(c for c in data.columns if c != "visit_date")]
        if reserves is not None:
            booked = [c for c in reserves.columns if c not in RESERVE_KEYS]
            lists = reserves.groupBy("store_id", "visit_date").agg(F.collect_list(F.struct("end_date", *booked)).alias("__booked"))  # a row per pivot of a day
            data = data.join(lists.hint("merge"), ["store_id", "visit_date"], "left")
        if any(kind == "diff" for _, features in store_families for kind, *_ in features):
            data = with_previous_date(data)
        extra = ("date_rank", "prev_date", "diff")
        rows = label_features(data, ctx.label_windows, store_families, extra)
        if reserves is not None:
            at = F.element_at(F.filter("__booked", lambda x: x["end_date"] == F.col("end_date")), 1)
            rows = rows.withColumn("__at", F.when(F.exists("__booked", lambda x: x["end_date"] == F.col("end_date")), at))
            rows = rows.select(*kept, "end_date", *made, *[F.col("__at")[c].alias(c) for c in booked])
            made += booked
        else:
            rows = rows.select(*kept, "end_date", *made)
        lab = labels(ctx, rows=rows.na.fill(0, subset=made))
    else:
        made, lab = [], labels(ctx)
    columns = [*(c for c in lab.columns if c not in made), *made, *(c for f, keys in families for c in f.columns if c not in (*keys, "end_date"))]
    for f, keys in sorted(families, key=_join_place):
        lab = attach(lab, f, keys)
    return second_feat(lab.select(*columns))


def _join_place(family: tuple) -> tuple:
    """The label rows are sorted for every further set of keys of a store, so those with the fewest columns come first, and the
    store alone, whose order they then have, last; look-ups need no order."""
    feats, keys = family
    return "store_id" not in keys, len(keys) == 1, len(feats.columns)


def test_set(data: DataFrame, days: int = 39, families: list | None = None) -> DataFrame:
    """O147 for the days after the history: every store's next `days` days as label rows (visitors unknown), with the
    features that the history gives at the first of them.

    The future rows are unioned with the history, so they take the same path as training labels; statistic
    windows end before them."""
    last = data.agg(F.max("visit_date")).scalar()
    store = [c for c in data.columns if c in ("store_id", "air_genre_name", "air_area_name")]
    future = data.select(*store).distinct().select(
        *store, F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, days))).alias("visit_date"))
    both = data.unionByName(future.withColumn("dow", F.weekday("visit_date")), allowMissingColumns=True)
    window = data.agg(F.date_add(F.max("visit_date"), 1).alias("end_date"), F.lit(days).alias("days_in_label"))
    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ctx = PitContext(data=both.repartition(parts, "store_id"), windows=window, n_windows=1, max_label_days=days)
    return training_set(ctx, families)


def full_training_set(ctx: PitContext, reserves: DataFrame | None = None) -> DataFrame:
    """O147 with every family of the reference's feature list.

    Families sharing a key are fused into one pass over the sorted series: store (statistics, decayed mean, first/last, differences, weekday
    profile), store x weekday (statistics, eight decay rates), store x holiday
    flag (two definitions), genre, genre x weekday, and the reservation tables.
    Families of stores are formed at the label rows alone.
    """
    store = [(["store_id"], (("summary", "store", STORE_HORIZONS), decayed("store", 1000), ("first_last", 1000), ("diff", DIFF_HORIZONS), ("profile", 1000))),
             (["store_id", "dow"], (("summary", "store_dow", STORE_HORIZONS), dow_decayed(1000))),
             (["store_id", "holiday_flg"], (("summary", "store_holiday", (1000,)),)),
             (["store_id", "holiday_flg2"], (("summary", "store_holiday2", (1000,)),))]
    fams = [(genre_visitor_feat(ctx), ["air_genre_name"]), (genre_exp_feat(ctx), ["air_genre_name"]),
            (genre_week_feat(ctx), ["air_genre_name", "dow"]), (genre_week_exp_feat(ctx), ["air_genre_name", "dow"])]
    booked = None
    if reserves is not None:
        rs = staged(reserve_feat(ctx, reserves))  # read for the stores' days and for the days
        booked = reserve_store_day(rs)
        fams.append((reserve_date_feat(rs), ["visit_date"]))
    return training_set(ctx, fams, store, booked)
