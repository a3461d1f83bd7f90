"""Projection, filtering, profiling and missing-value operators: O11-O22, O61-O66, O109-O115, O179."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import global_prefix_sum, join_groups


# ---------------------------------------------------------------- projections / filters
def drop_if_present(df: DataFrame, cols) -> DataFrame:
    """Drop columns, ignoring absent ones (a cut-list)."""
    return df.drop(*[c for c in cols if c in df.columns])


def split_by_prefix(df: DataFrame, id_col: str = "_id", target_prefixes=("AF_", "TRANS_"),
                    feature_prefix: str = "BE_", extra_targets=("RBC_LOSS",),
                    ignore=("dt_data", "dt_now"), feature_target: str = "TRANS_RBC"):
    """(targets, features).  Each column has a rank on either side, by its prefix or name, or none:
    targets are the first prefix, the id, the other prefixes, the extras; features their prefix, the id, the
    columns no rule names (by name), and one target that is a feature too."""
    first, *others = target_prefixes

    def target_rank(c):
        return (0 if c.startswith(first) else 1 if c == id_col else 2 if c.startswith(tuple(others))
                else 3 + extra_targets.index(c) if c in extra_targets else None)

    def feature_rank(c):
        if c == feature_target:
            return (3, "")
        if c.startswith(feature_prefix) or c == id_col:
            return (int(c == id_col), "")
        return None if target_rank(c) is not None or c in ignore else (2, c)

    def side(rank):
        ranked = [(rank(c), i, c) for i, c in enumerate(df.columns) if rank(c) is not None]
        return df.select(*[c for _, _, c in sorted(ranked)])

    return side(target_rank), side(feature_rank)


def soft_delete_filter(df: DataFrame, flag: str = "is_delete") -> DataFrame:
    """O13."""
    return df.where(F.col(flag) == 0).drop(flag)


def target_present(df: DataFrame, target: str) -> DataFrame:
    """O14."""
    return df.where(F.col(target).isNotNull())


def column_kinds(df: DataFrame) -> dict[str, str]:
    """Kind by declared type: numeric / bool / date / categorical."""
    out = {}
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, T.BooleanType):
            out[f.name] = "bool"
        elif isinstance(t, T.NumericType):
            out[f.name] = "numeric"
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[f.name] = "date"
        else:
            out[f.name] = "categorical"
    return out


def profile(df: DataFrame) -> DataFrame:
    """One row per column: kind, rows, non-null, distinct, missing, from one long (column, value) form.

    A column with at most one distinct value is 'constant'.
    """
    kinds = column_kinds(df)
    value = lambda c: F.md5(F.col(f"`{c}`").cast("string").cast("binary"))  # noqa: E731  a short stand-in for the value
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("v")) for c in df.columns]))
    counts = df.select(pairs.alias("p")).select("p.*").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("column").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("n_non_null"),
                                       F.count("v").alias("n_distinct"))
    declared = df.sparkSession.createDataFrame(list(kinds.items()), "column string, declared string")
    s = declared.join(per, "column", "left").na.fill(0, subset=["n_rows", "n_non_null", "n_distinct"])
    return s.select("column", F.when(F.col("n_distinct") <= 1, "constant").otherwise(F.col("declared")).alias("kind"),
                    "n_rows", "n_non_null", "n_distinct", (F.col("n_rows") - F.col("n_non_null")).alias("n_missing"))


def constant_columns(df: DataFrame) -> list[str]:
    """O15 (planning step): names of columns with <= 1 distinct value: least and greatest are equal (or both null)."""
    row = df.agg(*[F.min(f"`{c}`").eqNullSafe(F.max(f"`{c}`")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c]]


def drop_constant(df: DataFrame) -> DataFrame:
    """O15."""
    return df.drop(*constant_columns(df))


def drop_all_null(df: DataFrame) -> DataFrame:
    """dropna(how='all', axis=1)."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if row[c] == 0])


def substring_flag(col: str, needle: str) -> Column:
    """O19."""
    return F.col(col).contains(needle).cast("int")


def date_slice(df: DataFrame, col: str, start: str, end_inclusive: str) -> DataFrame:
    """Inclusive partial-date slice, e.g. '2017-01-10' .. end of '2017-08'."""
    # the column itself is compared, so the filter reaches the scan
    return df.where((F.col(col) >= F.lit(start).cast("date")) & (F.col(col) < F.date_add(F.lit(end_inclusive).cast("date"), 1)))


def binary_target(col: str, threshold: float) -> Column:
    """O21."""
    return (F.col(col) > threshold).cast("int")


# ---------------------------------------------------------------- exploratory aggregates
def distinct_spans(df: DataFrame, key: str, date_col: str) -> DataFrame:
    """Distinct keys, distinct dates and the date span in days."""
    return df.agg(F.count_distinct(key).alias(f"n_{key}"), F.count_distinct(date_col).alias(f"n_{date_col}"),
                  F.datediff(F.max(date_col), F.min(date_col)).alias("span_days"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """O63."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


def group_means(df: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Means of chosen fields, null group removed."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.avg(f).alias(f) for f in fields])


def relative_spread(df: DataFrame, std_col: str, mean_col: str, out: str = "rel_spread") -> DataFrame:
    """Std / mean ranked descending."""
    return df.withColumn(out, F.try_divide(F.col(std_col), F.col(mean_col))).orderBy(F.desc(out))


def error_by_entity(df: DataFrame, key: str, actual: str, pred: str, lo: float, hi: float) -> DataFrame:
    """Abs error and relative error per row, mean by entity, entities inside a band."""
    e = df.withColumns({"abs_err": F.abs(F.col(pred) - F.col(actual)),
                        "rel_err": F.try_divide(F.col(pred) - F.col(actual), F.col(actual))})
    g = e.groupBy(key).agg(F.avg("abs_err").alias("mean_abs_err"), F.avg("rel_err").alias("mean_rel_err"))
    return g.where(F.col("mean_abs_err").between(lo, hi))


# ---------------------------------------------------------------- math / missing values
def log_scale(df: DataFrame, col: str, out: str = "y_scaled") -> DataFrame:
    """O109: log1p(x) / max(log1p(x)); the inverse is exp(p * max) (scalar subquery, no driver trip)."""
    mx = df.agg(F.max(F.log1p(col))).scalar()
    return df.withColumns({out: F.log1p(col) / mx, "max_log": mx})


def unscale_log(p, max_log) -> Column:
    """O109 inverse of log_scale: exp(p * max_log) (the reference's inverse, not expm1)."""
    return F.exp(p * max_log)


def clip_renormalise(arr: str, mx: float, renormalise: bool = True) -> Column:
    """O111: clip each probability to [1-mx, mx], then divide by the row sum."""
    c = F.transform(F.col(arr), lambda x: F.least(F.greatest(x, F.lit(1 - mx)), F.lit(mx)))
    if not renormalise:
        return c
    s = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(c, lambda x: x / s)


def clip_lower(col, lower: float = 0.0) -> Column:
    """O112."""
    return F.greatest(F.col(col) if isinstance(col, str) else col, F.lit(lower))


def scale_by_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """O179: x / max(x) with the maximum as a scalar subquery."""
    mx = df.agg(*[F.max(c).alias(c) for c in cols])
    return df.withColumns({f"{c}_scaled": F.col(c) / mx.select(c).scalar() for c in cols})


def fill_by_role(df: DataFrame, numeric: list[str], categorical: list[str], num_fill=-999,
                 cat_fill: str = "_NAN") -> DataFrame:
    """O113: numeric -> -999 (or 0 / -1), categorical -> '_NAN' (or 'UD' / '')."""
    return df.na.fill({**{c: num_fill for c in numeric}, **{c: cat_fill for c in categorical}})


def row_backfill(df: DataFrame, cols: list[str]) -> DataFrame:
    """O114: fillna(method='bfill', axis=1): a null takes the next non-null column to its right."""
    return df.withColumns({c: F.coalesce(*[F.col(x) for x in cols[i:]]) for i, c in enumerate(cols)})


def quantiles(df: DataFrame, cols: list[str], at: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation: (column, count, one column per name of `at`).

    A column without values has count 0 and null quantiles."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in cols]))
    found = group_quantiles(df.select(pairs.alias("p")).select("p.*"), ["column"], "value", at)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(found, "column", "left").na.fill(0, subset=["count"])


def group_quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles of a value by group, with linear interpolation: (keys, count, one column per name of `at`).

    Counts per (keys, value) first, with map-side sums; positions come from a prefix sum over range partitions, so no
    task holds all values of a group.  Null values don't count; a group without values has no row, a null key is a group."""
    counts = (df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")
              .groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c")))
    placed = global_prefix_sum(counts, ["__v"], "__c", keys, out="__b")
    j = join_groups(placed, placed.groupBy(*keys).agg(F.sum("__c").alias("__n")), keys)
    aggs = [F.max("__n").alias("count")]
    for name, q in at.items():
        pos = (F.col("__n") - 1) * F.lit(q)
        low, high = F.floor(pos), F.ceil(pos)
        held = lambda p: F.sum(F.when((F.col("__b") <= p) & (p < F.col("__b") + F.col("__c")), F.col("__v")))
        part = F.max(pos - low)
        aggs.append((held(low) * (1 - part) + held(high) * part).alias(name))
    return j.groupBy(*keys).agg(*aggs)


def fit_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """O115 fit: one-row table of medians (the reusable na_dict)."""
    m = quantiles(df, cols, {"median": 0.5})
    return m.agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in cols])


def apply_median_fill(df: DataFrame, medians: DataFrame, cols: list[str],
                      force: list[str] | None = None) -> DataFrame:
    """O115 apply: `{c}_na` flag + fill with the stored median (flag forced for known names)."""
    force = force or []
    # one-row state: each median is a scalar subquery
    return df.withColumns({**{f"{c}_na": F.col(c).isNull() for c in cols},
                           **{c: F.coalesce(F.col(c).cast("double"), medians.select(F.col(c).cast("double")).scalar())
                              for c in cols}})
