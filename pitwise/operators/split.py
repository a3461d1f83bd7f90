"""Deterministic splits and samples: O75, O141-O148.

Randomness is a hash rank: md5('<seed>:<id>') orders rows identically in
Spark and DuckDB and on every task retry.  Ranks come from the driver-free
`global_row_number`, so neither a whole table nor a hot class lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import global_row_number, join_groups

DEFAULT_SEED = 42


def hash_key(id_col: str, seed: int = DEFAULT_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _with_n(df: DataFrame, group_cols: list[str]) -> DataFrame:
    if group_cols:
        n = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("__n"))
        return join_groups(df, n, group_cols)
    return df.withColumn("__n", df.agg(F.count(F.lit(1))).scalar())


def ordered_group_split(df: DataFrame, group_cols: list[str], order_cols: list[str],
                        train_frac: float = 0.9) -> DataFrame:
    """O75/O144: within each group the first floor(frac*n) rows in order are train (type 0), the rest valid (1)."""
    ranked = _with_n(global_row_number(df, order_cols, group_cols), group_cols)
    t = F.when(F.col("rn") <= F.floor(F.col("__n") * train_frac), 0).otherwise(1)
    return ranked.withColumn("type", t.cast("int")).drop("__n")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """O141: n rows without replacement (hash order), returned in id order. The limit is the feature."""
    return df.withColumn("__h", hash_key(id_col, seed)).orderBy("__h", id_col).limit(n).drop("__h").orderBy(id_col)


def kfold(df: DataFrame, id_col: str, k: int, val_pct: float = 0.2, seed: int = DEFAULT_SEED) -> DataFrame:
    """O142: fold k validation = hash ranks (k*nv, (k+1)*nv] with nv = int(val_pct*n); `is_valid` flag."""
    ranked = _with_n(global_row_number(df.withColumn("__h", hash_key(id_col, seed)), ["__h", id_col]), [])
    nv = F.floor(F.col("__n") * val_pct)
    v = (F.col("rn") > k * nv) & (F.col("rn") <= (k + 1) * nv)
    return ranked.withColumn("is_valid", v).drop("__h", "__n", "rn")


def stratified_split(df: DataFrame, class_col: str, id_col: str, n_valid: int = 20, n_test: int = 20,
                     seed: int = DEFAULT_SEED) -> DataFrame:
    """O143: per class the first n_valid hash-ranked rows valid, next n_test test, rest train."""
    ranked = global_row_number(df.withColumn("__h", hash_key(id_col, seed)), ["__h", id_col], [class_col])
    part = (F.when(F.col("rn") <= n_valid, "valid").when(F.col("rn") <= n_valid + n_test, "test")
            .otherwise("train"))
    return ranked.withColumn("part", part).drop("__h", "rn")


def head_tail(df: DataFrame, order_cols: list[str], train_frac: float | None = None,
              n_tail: int | None = None) -> DataFrame:
    """O144: first p% (or all but the last n_tail rows) are train."""
    ranked = _with_n(global_row_number(df, order_cols), [])
    cut = F.floor(F.col("__n") * train_frac) if train_frac is not None else F.col("__n") - n_tail
    return ranked.withColumn("is_train", F.col("rn") <= cut).drop("__n", "rn")


def date_holdout(df: DataFrame, date_col: str, start: str, end_exclusive: str) -> DataFrame:
    """O145: valid = [start, end), train = the rest (a flag; both parts stay)."""
    d = F.to_date(F.col(date_col))
    return df.withColumn("is_valid", (d >= F.lit(start).cast("date")) & (d < F.lit(end_exclusive).cast("date")))


def holdout_test_set(data: DataFrame, sub_keys: DataFrame, store_col: str, date_col: str):
    """O148: test = rows on submission dates; train = the other dates, limited to submission stores."""
    dates = sub_keys.select(date_col).distinct()
    stores = sub_keys.select(store_col).distinct()
    test = data.join(dates, date_col, "left_semi")
    train = data.join(dates, date_col, "left_anti").join(stores, store_col, "left_semi")
    return train, test
