"""Encoding and scaling with fitted state as DataFrames: O132-O140, O180, O181.

Fitted state (dictionaries, medians, means) is a small DataFrame that can be
written to Parquet and re-applied to other splits - the reference pickles it.
Dictionaries are numbered with the driver-free `global_row_number`, so a
high-cardinality column never funnels through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import global_row_number

NA_CATEGORY = "#NA#"
NN_NUMERIC_PAD = 100


def fit_dictionary(df: DataFrame, col: str, order_by: str | None = None) -> DataFrame:
    """Sorted distinct values -> 0-based code (O132).  With `order_by`, values are
    numbered by their first appearance in that order instead (O134)."""
    vals = df.where(F.col(col).isNotNull())
    # the distinct values are small next to the input: materialise them once before ranking
    if order_by is None:
        d = cut_lineage(vals.select(col).distinct())
        ranked = global_row_number(d, [col])
    else:
        d = cut_lineage(vals.groupBy(col).agg(F.min(order_by).alias("__first")))
        ranked = global_row_number(d, ["__first", col]).drop("__first")
    return ranked.select(col, (F.col("rn") - 1).alias("code"))


def apply_label_encoding(df: DataFrame, dictionary: DataFrame, col: str, out: str | None = None,
                         strict: bool = True) -> DataFrame:
    """O132 apply: value -> code; an unseen non-null value raises (as LabelEncoder does)."""
    d = dictionary.select(F.col(col).alias("__v"), F.col("code").alias("__code"))
    j = df.join(d, df[col] == d["__v"], "left")
    code = F.col("__code")
    if strict:
        code = F.when(F.col(col).isNotNull() & code.isNull(),
                      F.raise_error(F.concat(F.lit("unseen label: "), F.col(col).cast("string")))).otherwise(code)
    return j.withColumn(out or col, code.cast("int")).drop("__v", "__code")


def apply_category_codes(df: DataFrame, dictionary: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """O133: codes from the train dictionary, +1; null or unseen -> 0."""
    d = dictionary.select(F.col(col).alias("__v"), F.col("code").alias("__code"))
    j = df.join(d, df[col] == d["__v"], "left")
    return j.withColumn(out or col, F.coalesce(F.col("__code") + 1, F.lit(0)).cast("int")).drop("__v", "__code")


def fit_levels(df: DataFrame, col: str, max_levels: int) -> list:
    """O135 planning step: the sorted levels of a low-cardinality column (at most max_levels+1 fetched)."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels")
    return sorted(r[0] for r in rows)


def one_hot(col: str, levels: list, dummy_na: bool = True) -> list[Column]:
    """O135: one 0/1 column per level (+ `{col}_nan`), as get_dummies(dummy_na=True)."""
    out = [F.when(F.col(col) == F.lit(v), 1).otherwise(0).cast("int").alias(f"{col}_{v}") for v in levels]
    if dummy_na:
        out.append(F.col(col).isNull().cast("int").alias(f"{col}_nan"))
    return out


def one_hot_array(idx, n_classes: int) -> Column:
    """O136: np.eye(c)[a] as array<double>."""
    i = F.col(idx) if isinstance(idx, str) else idx
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.when(k == i, 1.0).otherwise(0.0))


def n_hot_array(indices, n_classes: int) -> Column:
    """O136 multi-label: 1.0 at every index in the array."""
    a = F.col(indices) if isinstance(indices, str) else indices
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                       lambda k: F.when(F.array_contains(a, k), 1.0).otherwise(0.0))


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """O137 fit: one-row table of mean and population std per column."""
    return df.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))])


def apply_scaler(df: DataFrame, state: DataFrame, cols: list[str]) -> DataFrame:
    """O137/O140 apply: (x - mean) / std with the stored state (one-row broadcast)."""
    # one-row state: means and stds are scalar subqueries
    return df.withColumns({c: (F.col(c) - state.select(f"{c}__mean").scalar()) / state.select(f"{c}__std").scalar()
                           for c in cols})


def nn_fill(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """O139: numeric null -> column max + 100; categorical null -> '#NA#'."""
    mx = df.agg(*[F.max(c).alias(c) for c in numeric])
    fills = {c: F.coalesce(F.col(c), mx.select(c).scalar() + NN_NUMERIC_PAD) for c in numeric}
    fills.update({c: F.coalesce(F.col(c), F.lit(NA_CATEGORY)) for c in categorical})
    return df.withColumns(fills)


def cardinality_width(df: DataFrame, cols: list[str], max_width: int = 50) -> DataFrame:
    """O181: per category column its cardinality (distinct + 1) and embedding width min(50, (c+1)//2)."""
    one = df.agg(*[(F.count_distinct(c) + 1).alias(c) for c in cols])
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("cardinality"))
                             for c in cols]))
    return one.select(st.alias("s")).select("s.*").withColumn(
        "width", F.least(F.lit(max_width), F.floor((F.col("cardinality") + 1) / 2)).cast("long"))


def pack_roles(df: DataFrame, cats: list[str], contins: list[str], target: str | None = None) -> DataFrame:
    """O180 pack: categories -> one int array, numerics -> one float array (+ target)."""
    cols = [F.array(*[F.col(c).cast("int") for c in cats]).alias("cats"),
            F.array(*[F.col(c).cast("float") for c in contins]).alias("contins")]
    if target:
        cols.append(F.col(target))
    return df.select(*cols)


def unpack_roles(df: DataFrame, cats: list[str], contins: list[str]) -> DataFrame:
    """O180 unpack: back to single columns."""
    return df.select(*[F.element_at("cats", i + 1).alias(c) for i, c in enumerate(cats)],
                     *[F.element_at("contins", i + 1).alias(c) for i, c in enumerate(contins)],
                     *[c for c in df.columns if c not in ("cats", "contins")])


def proc_df(df: DataFrame, y_fld: str, skip_flds=(), na_state: DataFrame | None = None,
            numeric: list[str] | None = None, categorical: list[str] | None = None,
            code_dicts: dict[str, DataFrame] | None = None, max_n_cat: int | None = None,
            do_scale: bool = False, scale_state: DataFrame | None = None, preproc_fn=None):
    """O138: hook, split y, drop, median fill with indicators, optional scaling, codes / dummies.

    Returns (features, y, state) where state holds the fitted medians, scaler
    and dictionaries, reusable on the validation and test sets.
    """
    from .clean import apply_median_fill, fit_medians
    if preproc_fn is not None:
        df = df.transform(preproc_fn)  # O173 hook
    y = df.select(y_fld)
    x = df.drop(y_fld, *skip_flds)
    kinds = dict(x.dtypes)
    numeric = numeric if numeric is not None else [c for c, t in kinds.items()
                                                   if t in ("int", "bigint", "double", "float", "smallint")]
    categorical = categorical if categorical is not None else [c for c, t in kinds.items() if t == "string"]
    if na_state is None:
        # medians and null counts in one pass; only columns with nulls get a `_na` flag
        row = x.agg(*[F.count(F.lit(1)).alias("__rows")],
                    *[F.count(c).alias(c) for c in numeric]).first()
        flagged = [c for c in numeric if row[c] < row["__rows"]]
        na_state = fit_medians(x, flagged) if flagged else None
    flagged = na_state.columns if na_state is not None else []
    if flagged:
        x = apply_median_fill(x, na_state, flagged)
    if do_scale:
        scale_state = scale_state if scale_state is not None else fit_scaler(x, numeric)
        x = apply_scaler(x, scale_state, numeric)
    code_dicts = code_dicts or {}
    for c in categorical:
        if max_n_cat is not None:
            lv = x.select(c).distinct().limit(max_n_cat + 1).count()
            if lv <= max_n_cat:
                x = x.select("*", *one_hot(c, fit_levels(x, c, max_n_cat))).drop(c)
                continue
        if c not in code_dicts:
            code_dicts[c] = fit_dictionary(x, c)
        x = apply_category_codes(x, code_dicts[c], c)
    return x, y, {"na": na_state, "scale": scale_state, "codes": code_dicts}
