"""Ranking, blending and evaluation tables: O80-O84, O161-O171.

Metrics are aggregations returning one-row (or per-group) DataFrames, so
they run where the predictions are and compose like any other query.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .clean import quantiles
from .ordering import global_prefix_sum

# Ranks of a column's values that are broadcast; beyond it rows and values are shuffled by value.
RANKS = 1_000_000


def total_sort(df: DataFrame, cols: list, tie: list) -> DataFrame:
    """A total order (explicit unique tie-break)."""
    return df.orderBy(*cols, *tie)


def top_n(df: DataFrame, score: str, n: int, tie: str) -> DataFrame:
    """N rows with the highest score (TakeOrderedAndProject; the limit is the feature)."""
    return df.orderBy(F.desc(score), F.asc(tie)).limit(n)


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int) -> DataFrame:
    """Exact top-k per group: a plain rank with a limit, for which Spark keeps at most k rows of each group in
    every task before the shuffle, so a hot group brings k rows per task."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def argmax(arr) -> Column:
    """Index (0-based) of the first maximum of an array."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def most_by_correct(probs: DataFrame, n_classes: int, correct: bool, k: int = 4, key: str = "user_id",
                    p: str = "p", actual: str = "actual") -> DataFrame:
    """Per class y, the k rows of class y whose prediction is (in)correct, by p[y] desc (asc)."""
    pred = argmax(p)
    d = probs.withColumn("pred", pred).where((F.col("pred") == F.col(actual)) == F.lit(correct))
    d = d.withColumn("py", F.element_at(p, F.col(actual) + 1)).withColumn("class", F.col(actual))
    order = [F.desc("py") if correct else F.asc("py"), F.asc(key)]
    return top_k_per_group(d.select(key, "class", "py"), ["class"], order, k)


def most_uncertain(probs: DataFrame, n_classes: int, k: int = 4, key: str = "user_id", p: str = "p",
                   actual: str = "actual") -> DataFrame:
    """Per class y, the k rows of class y with p[y] closest to 1/C."""
    d = probs.withColumn("class", F.col(actual)).withColumn("py", F.element_at(p, F.col(actual) + 1))
    d = d.withColumn("dist", F.abs(F.col("py") - 1.0 / n_classes))
    return top_k_per_group(d.select(key, "class", "py", "dist"), ["class"], [F.asc("dist"), F.asc(key)], k)


def threshold_select(imp: DataFrame, t: float, exclude: DataFrame, col: str = "column") -> DataFrame:
    """Importances above t, minus an exclusion list (left-anti join)."""
    return imp.where(F.col("importance") > t).join(exclude, col, "left_anti")


def spearman_pairs(df: DataFrame, cols: list[str], threshold: float = 0.0) -> DataFrame:
    """O161: Spearman correlation of every column pair over the rows where both are present, |rho| >= threshold.

    A value's average rank follows from counts per (column, value) and a prefix sum over range partitions; every row then
    looks its ranks up, in a broadcast where a column has few values, and one aggregation gives all pairs.  A column whose rows
    all hold the other column has one rank for all of these; for another column with nulls the values are ranked among its rows.
    A pair with a constant column has no correlation and no row."""
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    there = [F.col(f"c{i}").isNotNull() for i in range(k)]
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    found = rows.agg(*[F.count(F.when(there[i] & there[j], 1)).alias(f"n{i}_{j}") for i, j in [*pairs, *((i, i) for i in range(k))]]).first()
    total = {(i, j): found[f"n{min(i, j)}_{max(i, j)}"] for i in range(k) for j in range(k)}
    holes = [j for j in range(k) if any(total[i, j] < total[i, i] for i in range(k))]
    kept = ["n", *(f"n{j}" for j in holes)]
    one = [F.struct(F.lit(i).alias("col"), F.col(f"c{i}").alias("v"), *[there[j].cast("long").alias(f"n{j}") for j in holes]) for i in range(k)]
    values = (rows.select(F.explode(F.array(*one)).alias("e")).select("e.*").where("v is not null").groupBy("col", "v")
              .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"n{j}").alias(f"n{j}") for j in holes]))
    placed = global_prefix_sum(values, ["v"], kept, ["col"], out=[f"b{c}" for c in kept])
    placed = cut_lineage(placed.select("col", "v", *[(F.col(f"b{c}") + (F.col(c) + 1) / 2.0).alias(c) for c in kept]))
    sizes = dict(placed.groupBy("col").count().collect())  # one row per column
    for i in range(k):
        side = placed.where(F.col("col") == i).select(F.col("v").alias(f"c{i}"), *[F.col(c).alias(f"{c}_of{i}") for c in kept])
        small = sizes.get(i, 0) * len(kept) <= RANKS
        rows = rows.join(F.broadcast(side) if small else side, f"c{i}", "left")

    def off(i: int, j: int) -> Column:
        """How far the rank of column i lies from the mean of all ranks, among the rows that hold j."""
        rank = F.col(f"n{j}_of{i}") if total[i, j] < total[i, i] else F.col(f"n_of{i}")
        return F.when(there[i] & there[j], rank - (total[i, j] + 1) / 2.0)

    sums = [F.sum(x * y).alias(f"{name}{i}_{j}") for i, j in pairs for name, x, y in
            (("xy", off(i, j), off(j, i)), ("xx", off(i, j), off(i, j)), ("yy", off(j, i), off(j, i)))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, rho double")
    rho = [F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"),
                    F.try_divide(F.col(f"xy{i}_{j}"), F.sqrt(F.col(f"xx{i}_{j}") * F.col(f"yy{i}_{j}"))).alias("rho")) for i, j in pairs]
    return rows.agg(*sums).select(F.explode(F.array(*rho)).alias("p")).select("p.*").where(F.abs("rho") >= threshold)


def average_linkage(names: list[str], distance: np.ndarray) -> list[tuple]:
    """Agglomerative clustering with average linkage: (left members, right members, distance) of each merge, nearest
    first, of equally near ones those named first.  A helper over columns, whose number is the table's width."""
    groups = {i: [n] for i, n in enumerate(names)}
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    merges = []
    while len(groups) > 1:
        i, j = divmod(int(np.argmin(np.round(d, 12))), len(names))
        i, j = min(i, j), max(i, j)
        merges.append((sorted(groups[i]), sorted(groups[j]), float(d[i, j])))
        n, m = len(groups[i]), len(groups[j])
        near = (n * d[i] + m * d[j]) / (n + m)  # the mean over all pairs of members
        d[i], d[:, i] = near, near
        d[i, i] = d[j] = d[:, j] = np.inf
        groups[i] += groups.pop(j)
    return merges


def feature_groups(df: DataFrame, cols: list[str], limit: float = 0.5, absolute: bool = True, decimals: int = 4) -> DataFrame:
    """O161: redundant columns.  Average-linkage clustering over 1 - |rho| (or 1 - rho), rho the Spearman correlation
    rounded to `decimals`; a pair without a correlation (a constant or empty column) is at distance 1.

    One row per merge: step, left and right (arrays of member columns), distance, size, and whether the merge lies within
    `limit`, so that its members form one group of redundant columns.  The correlations are computed by Spark; one number per
    pair of columns comes to the driver."""
    place = {c: i for i, c in enumerate(cols)}
    distance = np.ones((len(cols), len(cols)))
    for p in spearman_pairs(df, cols).collect():
        if p["rho"] is not None and not np.isnan(p["rho"]):
            rho = round(p["rho"], decimals)
            a, b = place[p["a"]], place[p["b"]]
            distance[a, b] = distance[b, a] = 1 - (abs(rho) if absolute else rho)
    rows = [(step, a, b, d, len(a) + len(b), d <= limit) for step, (a, b, d) in enumerate(average_linkage(cols, distance), 1)]
    return df.sparkSession.createDataFrame(rows, "step int, left array<string>, right array<string>, distance double, size int, redundant boolean")


def column_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """O162: count, mean, std, min, quartiles, max per column (long form)."""
    one = df.agg(*[x for c in cols for x in (F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"),
                                             F.stddev_samp(c).alias(f"{c}__std"),
                                             F.min(c).cast("double").alias(f"{c}__min"),
                                             F.max(c).cast("double").alias(f"{c}__max"))])
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("count"),
                                      F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                                      F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"))
                             for c in cols]))
    quarters = quantiles(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("count")
    return one.select(st.alias("s")).select("s.*").join(quarters, "column")


def blend(a: DataFrame, b: DataFrame, key: str, col_a: str, col_b: str, weight_b: float = 1.1) -> DataFrame:
    """O163: (a + w*b)/2 after an inner join on the id."""
    return a.join(b, key).select(key, ((F.col(col_a) + weight_b * F.col(col_b)) / 2).alias("blend"))


def mean_over_runs(runs: DataFrame, key: str, value: str) -> DataFrame:
    """O163: mean prediction over runs."""
    return runs.groupBy(key).agg(F.avg(value).alias(value))


def tta_mean(runs: DataFrame, key: str, cls: str, logp: str, classes: list) -> DataFrame:
    """O164: mean of exp(log-prob) over runs per (id, class), pivoted to one column per class."""
    return (runs.groupBy(key).pivot(cls, classes).agg(F.avg(F.exp(logp))))


def regression_metrics(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """O165: RMSE, RMSLE, RMSPE, R2 in one aggregation."""
    e = F.col(pred) - F.col(actual)
    mean_a = df.agg(F.avg(actual)).scalar()
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"),
                  F.sqrt(F.avg(F.pow(F.log1p(pred) - F.log1p(actual), 2))).alias("rmsle"),
                  F.sqrt(F.avg(F.pow(F.try_divide(e, F.col(actual)), 2))).alias("rmspe"),
                  (1 - F.sum(e * e) / F.sum(F.pow(F.col(actual) - mean_a, 2))).alias("r2"))


def accuracy(df: DataFrame, probs: str, actual: str) -> DataFrame:
    """O166: argmax accuracy."""
    return df.agg(F.avg((argmax(probs) == F.col(actual)).cast("double")).alias("accuracy"))


def accuracy_multi(df: DataFrame, probs: str, targets: str, thresh: float) -> DataFrame:
    """O166: element-wise (p > t) == target, averaged over all elements."""
    hit = F.zip_with(probs, targets, lambda p, t: ((p > thresh).cast("double") == t).cast("double"))
    return df.agg((F.sum(F.aggregate(hit, F.lit(0.0), lambda a, x: a + x)) /
                   F.sum(F.size(probs))).alias("accuracy_multi"))


def fbeta(df: DataFrame, probs: str, targets: str, beta: float, thresh: float, eps: float = 1e-9) -> DataFrame:
    """O166: per-row F-beta of thresholded predictions, averaged."""
    yp = F.transform(probs, lambda p: (p > thresh).cast("double"))
    tp = F.aggregate(F.zip_with(yp, targets, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    sp = F.aggregate(yp, F.lit(0.0), lambda s, x: s + x)
    st = F.aggregate(F.col(targets), F.lit(0.0), lambda s, x: s + x)
    prec = tp / (sp + eps)
    rec = tp / (st + eps)
    f = prec * rec / (prec * beta ** 2 + rec + eps) * (1 + beta ** 2)
    return df.agg(F.avg(f).alias("fbeta"))


def cross_entropy(df: DataFrame, probs: str, actual: str) -> DataFrame:
    """O167: mean -log p[actual]."""
    return df.agg(F.avg(-F.log(F.element_at(probs, F.col(actual) + 1))).alias("log_loss"))


def confusion(df: DataFrame, actual: str, pred: str, normalize: bool = True) -> DataFrame:
    """O168: counts by (actual, predicted) and the row-normalised share."""
    c = df.groupBy(F.col(actual).alias("actual"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        tot = c.groupBy("actual").agg(F.sum("n").alias("__t"))
        c = c.join(tot, "actual").withColumn("share", F.col("n") / F.col("__t")).drop("__t")
    return c


def within_tolerance(df: DataFrame, actual: str, pred: str, tol: float = 1.0) -> DataFrame:
    """O169: share and count of rows with |error| <= tol."""
    ok = (F.abs(F.col(pred) - F.col(actual)) <= tol).cast("int")
    return df.agg(F.avg(ok).alias("share_within"), F.sum(ok).cast("long").alias("n_within"),
                  F.count(F.lit(1)).alias("n"))


def assemble_submission(ids: DataFrame, preds: DataFrame, key: str, value: str) -> DataFrame:
    """O170: every id of the list, prediction or 0."""
    return ids.select(key).join(preds.select(key, value), key, "left").na.fill(0, subset=[value])


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """O171: rows whose shared columns differ (null-safe), with the names of the differing columns."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    j = a.select(*keys, *[F.col(c).alias(f"a__{c}") for c in shared]).join(
        b.select(*keys, *[F.col(c).alias(f"b__{c}") for c in shared]), keys, "full")
    diffs = F.filter(F.array(*[F.when(~F.col(f"a__{c}").eqNullSafe(F.col(f"b__{c}")), F.lit(c)) for c in shared]),
                     lambda x: x.isNotNull())
    return j.select(*keys, diffs.alias("diff_columns")).where(F.size("diff_columns") > 0)
