"""Models and model diagnostics on DataFrames: O149-O160 (Spark MLlib; fits run on executors).

Learners are MLlib's.  Diagnostics (importances, per-tree spread, partial
dependence, drift) are DataFrames built from fitted models without pulling
data to the driver; only fitted parameters (small) are read there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_dir, cut_lineage, staged

# Rows of a slice of either side of the exact k-NN, and the most pivots that its tasks are given.
KNN_BLOCK = 2048
KNN_PIVOTS = 16384
# Distances to pivots that a task holds at a time.
KNN_DISTANCES = 1 << 21
# Items whose biases and factors go to every task; more are joined by a shuffle.
ALS_BROADCAST = 50_000
SEED = 42


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def rf_regressor(num_trees: int = 30, min_leaf: int = 3, feature_share: str = "0.5",
                 row_share: float = 1.0, label: str = "label", seed: int = SEED) -> RandomForestRegressor:
    """O149: trees, min leaf, feature share, row sampling per tree."""
    return RandomForestRegressor(numTrees=num_trees, minInstancesPerNode=min_leaf,
                                 featureSubsetStrategy=feature_share, subsamplingRate=row_share,
                                 labelCol=label, featuresCol="features", seed=seed)


def gbt_regressor(max_iter: int = 30, depth: int = 5, label: str = "label", seed: int = SEED) -> GBTRegressor:
    """O150 (same role as the boosted-tree libraries)."""
    return GBTRegressor(maxIter=max_iter, maxDepth=depth, labelCol=label, featuresCol="features", seed=seed)


def fit_predict(est, train: DataFrame, test: DataFrame, features: list[str]):
    model = est.fit(assemble(train, features))
    return model, model.transform(assemble(test, features)).drop("features")


def linear_one(df: DataFrame, y: str, x: str) -> DataFrame:
    """O151: one-feature least squares as two aggregates."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def linear_multi(train: DataFrame, test: DataFrame, features: list[str], label: str = "label"):
    return fit_predict(LinearRegression(labelCol=label, featuresCol="features"), train, test, features)


def _usable(vec: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite, F.lit(False))


class Cells:
    """Pivots of the training vectors with the size and the radius of their cells; bounded by KNN_PIVOTS, so tasks get all."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.norms = pivots, (pivots ** 2).sum(1)
        self.count, self.radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))

    def squares(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of rows to all pivots, and a bound on their rounding errors."""
        own = (m ** 2).sum(1)
        return np.maximum(own[:, None] + self.norms - 2 * m @ self.pivots.T, 0), 1e-9 * (own + self.norms.max() + 1e-300)

    def enough(self, far: np.ndarray, k: int) -> np.ndarray:
        """For each row a distance within which k training rows lie: whole cells, nearest far end first, until k are together."""
        order = np.argsort(far, axis=1)
        full = np.cumsum(self.count[order], axis=1) >= k
        reach = np.take_along_axis(far, order, 1)[np.arange(len(far)), full.argmax(1)]
        return np.where(full.any(1), reach, np.inf)

    def to_see(self, m: np.ndarray, home: np.ndarray, kth: np.ndarray, k: int) -> list[np.ndarray]:
        """For each row the cells, its home left out, that can hold one of its k nearest; `kth` is the k-th distance found so far.

        By the triangle inequality no row of a cell is nearer than the pivot's distance less the radius; and since it is no farther from
        its pivot than from the home's, none is nearer than the plane between the two pivots."""
        sq, error = self.squares(m)
        d = np.sqrt(sq)
        slack = np.sqrt(error)
        reach = np.fmin(kth, self.enough(d + self.radius + slack[:, None], k))
        out = []
        for i, h in enumerate(home):
            near = np.flatnonzero(~(d[i] - self.radius - 2 * slack[i] > reach[i]) & (self.count > 0))
            near = near[near != h]
            between = np.sqrt(((self.pivots[near] - self.pivots[h]) ** 2).sum(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (sq[i, near] - sq[i, h] - 2 * error[i]) / (2 * between)
            out.append(near[~(plane > reach[i] + slack[i])])
        return out


def _stacked(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lots(batches, cells: Cells):
    """The batches in pieces whose distances to all pivots are few enough to hold."""
    step = max(1, KNN_DISTANCES // len(cells.pivots))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _home(cells: Cells):
    """Rows (id, vec, y) with the cell of their nearest pivot and their distance to it."""
    def run(batches):
        for b in _lots(batches, cells):
            m = _stacked(b.column("vec"))
            cell = cells.squares(m)[0].argmin(1)
            dist = np.sqrt(((m - cells.pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(dist)], names=[*b.schema.names, "cell", "dist"])
    return run


def _other(cells: Cells, k: int):
    """Queries (id, vec, cell, kth) with the other cells that they must see."""
    def run(batches):
        for b in _lots(batches, cells):
            kth = b.column("kth").to_numpy(zero_copy_only=False).astype(float)
            see = cells.to_see(_stacked(b.column("vec")), b.column("cell").to_numpy(), np.where(np.isnan(kth), np.inf, kth), k)
            at = np.repeat(np.arange(len(see)), [len(c) for c in see])
            cell = np.concatenate(see).astype(np.int32)
            step = max(1, KNN_DISTANCES // (4 * max(1, len(cells.pivots[0]))))  # copies of a vector that are out at a time
            for a in range(0, len(at), step):
                kept = b.select(["id", "vec"]).take(pa.array(at[a:a + step]))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell[a:a + step])], names=["id", "vec", "cell"])
    return run


def _meet(queries: DataFrame, cells_of: DataFrame, sizes: np.ndarray, k: int, block: int) -> DataFrame:
    """The k best rows (id, t, d, y) that each slice of its cell gives a query; both sides of a cell are cut into slices of about
    `block` rows, so a group has a bounded size whatever the cell holds."""
    spark = queries.sparkSession
    asked = {c: n for c, n in queries.groupBy("cell").count().collect()}  # at most KNN_PIVOTS rows
    slices = spark.createDataFrame([(c, -(-n // block), -(-int(sizes[c]) // block)) for c, n in asked.items()], "cell int, q int, t int")
    slices = F.broadcast(slices)

    def side(rows: DataFrame, no: int) -> DataFrame:
        mine, other = ("q", "t") if no == 0 else ("t", "q")
        cut = rows.join(slices, "cell").withColumn(f"{mine}_no", F.pmod(F.xxhash64("id", F.lit(7)), F.col(mine)).cast("int"))
        y = F.lit(None).cast("double") if no == 0 else F.col("y")
        return cut.select("id", "vec", y.alias("y"), F.lit(no).alias("side"), "cell", f"{mine}_no",
                          F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_no")).select(
            "id", "vec", "y", "side", "cell", "q_no", "t_no")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("id")
        if not len(q) or not len(t):
            return pd.DataFrame({"id": [], "t": [], "d": [], "y": []})
        m, ids, y = np.stack(t["vec"].to_numpy()), t["id"].to_numpy(), t["y"].to_numpy()
        d = [((m - v) ** 2).sum(-1) for v in q["vec"]]
        at = [np.argsort(x, kind="stable")[:k] for x in d]
        where = np.concatenate(at)
        return pd.DataFrame({"id": np.repeat(q["id"].to_numpy(), [len(a) for a in at]), "t": ids[where],
                             "d": np.concatenate([x[a] for x, a in zip(d, at)]), "y": y[where]})

    met = side(queries, 0).unionByName(side(cells_of, 1)).groupBy("cell", "q_no", "t_no")
    return met.applyInPandas(best, "id long, t long, d double, y double")


def _nearest(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("d", "t")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def knn_regress(query: DataFrame, train: DataFrame, key: str, vec: str, label: str, k: int = 4,
                block: int = KNN_BLOCK, max_pivots: int = KNN_PIVOTS) -> DataFrame:
    """O152: mean label of the k nearest training vectors (Euclidean, ties by training id); exact.

    Training vectors fall into the cells of their nearest pivots (about as many as the root of their number, at most `max_pivots`,
    chosen by a hash of the key).  A query first meets its own cell; the k-th distance found there, and the triangle inequality, then
    name the few other cells that can hold a nearer row (`Cells.to_see`).  Of equal training vectors only the k with the smallest ids
    can count, so copies do not swell a cell.  How much is pruned depends on the data: vectors without any structure in
    many dimensions still see most cells.

    `key` is an integer that is unique among the queries; vectors have one length.  Null vectors, and those with null or non-finite
    components, are nobody's neighbours; a query without neighbours gets null."""
    def rows(df: DataFrame, y) -> DataFrame:
        out = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"), y.cast("double").alias("y"))
        return out.where(_usable(F.col("vec")))

    copies = Window.partitionBy("vec").orderBy("id")
    points = rows(train, F.col(label)).withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k).drop("r")
    points = cut_lineage(points)
    n = min(max_pivots, max(1, int(points.count() ** 0.5)))
    chosen = points.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(n).select("vec").toPandas()["vec"]  # at most max_pivots
    answers = query.select(F.col(key).cast("long").alias("id"), F.lit(None).cast("double").alias("y"))
    if len(chosen):
        cells = Cells(np.unique(np.stack(chosen.to_numpy()), axis=0))
        schema = "id long, vec array<double>, y double, cell int, dist double"
        homes = cut_lineage(points.mapInArrow(_home(cells), schema))
        for c, size, radius in homes.groupBy("cell").agg(F.count(F.lit(1)), F.max("dist")).collect():
            cells.count[c], cells.radius[c] = size, radius
        asked = cut_lineage(rows(query, F.lit(None)).mapInArrow(_home(cells), schema))
        first = cut_lineage(_nearest(_meet(asked, homes, cells.count, k, block), k).drop("r"))
        kth = first.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d"))).alias("kth"))
        others = asked.select("id", "vec", "cell").join(kth, "id", "left").mapInArrow(_other(cells, k), "id long, vec array<double>, cell int")
        near = first.unionByName(_meet(cut_lineage(others), homes, cells.count, k, block))
        answers = answers.unionByName(_nearest(near, k).select("id", "y"))
    return answers.groupBy(F.col("id").cast(query.schema[key].dataType).alias(key)).agg(F.avg("y").alias("knn_pred"))


def als_fit_predict(ratings: DataFrame, user: str, item: str, rating: str, rank: int = 10,
                    max_iter: int = 10, reg: float = 0.1, scored: DataFrame | None = None, damping: float = 5.0):
    """O153: mean + user bias + item bias + factor product on dense ids (O134), scores bounded to the ratings' range.

    The biases are damped means of what the parts before leave; the factors fit the rest.  `scored` are the rows to
    predict, hold-out rows as a rule (default: the training rows); an unknown user or item has bias and product 0."""
    checkpoint_dir(ratings.sparkSession)
    state = ratings.agg(F.avg(rating).alias("mean"), F.min(rating).alias("lo"), F.max(rating).alias("hi"))
    mean, lo, hi = (F.lit(v).cast(f.dataType) for v, f in zip(state.first(), state.schema))

    def bias(df: DataFrame, key: str, rest) -> DataFrame:
        return df.groupBy(key).agg((F.sum(rest) / (F.count(F.lit(1)) + damping)).alias(f"{key}_bias"))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= ALS_BROADCAST else df

    users = staged(bias(ratings, user, F.col(rating) - mean))
    with_user = ratings.join(users, user)
    items = staged(bias(with_user, item, F.col(rating) - mean - F.col(f"{user}_bias")))
    left = with_user.join(small(items), item).select(
        user, item, (F.col(rating) - mean - F.col(f"{user}_bias") - F.col(f"{item}_bias")).alias("rest"))
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, userCol=user, itemCol=item, ratingCol="rest",
              coldStartStrategy="nan", seed=SEED, checkpointInterval=5)
    model = als.fit(left)
    # one table a side with bias and factors, so that a row to predict is shuffled once, by user, before it carries factors
    users, items = (staged(b.join(f.select(F.col("id").alias(key), F.col("features").alias(f"__{key}")), key, "left"))
                    for key, b, f in ((user, users, model.userFactors), (item, items, model.itemFactors)))
    p = (scored if scored is not None else ratings).join(users, user, "left").join(small(items), item, "left")
    product = F.lit(0.0).cast("float")  # in floats and in this order, as the model's own transform
    for i in range(rank):
        product = product + F.col(f"__{user}")[i] * F.col(f"__{item}")[i]
    total = mean + F.coalesce(f"{user}_bias", F.lit(0.0)) + F.coalesce(f"{item}_bias", F.lit(0.0)) + F.nanvl(
        F.coalesce(product.cast("double"), F.lit(0.0)), F.lit(0.0))
    return model, p.withColumn("prediction", F.least(F.greatest(total, lo), hi)).drop(f"__{user}", f"__{item}")


def importance_table(model, features: list[str]) -> DataFrame:
    """O156: importance per feature, sorted (a model attribute, a handful of numbers)."""
    spark = __import__("pyspark").sql.SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, [float(x) for x in imp])), "column string, importance double") \
        .orderBy(F.desc("importance"))


def rmse(pred: DataFrame, label: str = "label") -> float:
    return pred.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(label), 2)))).scalar()


def drop_column_importance(est_factory, train: DataFrame, valid: DataFrame, features: list[str],
                           label: str = "label") -> DataFrame:
    """O157: refit without each column; importance = hold-out RMSE increase (the hold-out replaces OOB)."""
    _, p = fit_predict(est_factory(), train, valid, features)
    base = p.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(label), 2))).alias("e"))
    parts = []
    for c in features:
        rest = [f for f in features if f != c]
        _, pc = fit_predict(est_factory(), train, valid, rest)
        parts.append(pc.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(label), 2))).alias("e"))
                     .select(F.lit(c).alias("column"), "e"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("column", (F.col("e") - base.select("e").scalar()).alias("importance"))


def tree_spread(model, df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """O158: mean and std of the per-tree predictions of a forest, in one projection."""
    d = assemble(df, features)
    cols = []
    for i, tree in enumerate(model.trees):
        d = tree.transform(d).withColumnRenamed("prediction", f"__t{i}")
        cols.append(f"__t{i}")
    arr = F.array(*[F.col(c) for c in cols])
    n = len(cols)
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / n
    d = d.withColumn("pred_mean", mean)
    var = F.aggregate(F.transform(arr, lambda x: (x - F.col("pred_mean")) * (x - F.col("pred_mean"))),
                      F.lit(0.0), lambda a, x: a + x) / n
    return d.select(*keep, "pred_mean", F.sqrt(var).alias("pred_std"))


def partial_dependence(model, df: DataFrame, features: list[str], feature: str, grid: list[float],
                       key: str, n_sample: int | None = None) -> DataFrame:
    """O159: the feature swept over a grid for every row (or a hash sample of `n_sample`), mean prediction."""
    return partial_dependence_pair(model, df, features, (feature,), (grid,), key, n_sample)


def partial_dependence_pair(model, df: DataFrame, features: list[str], swept: tuple[str, ...], grids: tuple[list[float], ...],
                            key: str, n_sample: int | None = None) -> DataFrame:
    """O159 for several features at once: mean prediction at each point of the product of the grids."""
    from .split import sample_n
    s = df if n_sample is None else sample_n(df, key, n_sample)
    for feature, grid in zip(swept, grids):
        s = s.withColumn(feature, F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    p = model.transform(assemble(s, features))
    return p.groupBy(*swept).agg(F.avg("prediction").alias("pd_mean"), F.count(F.lit(1)).alias("n"))


def drift_classifier(train: DataFrame, valid: DataFrame, features: list[str]):
    """O160: label rows by set, fit a forest; high importances flag leaking columns."""
    d = train.withColumn("is_valid", F.lit(0.0)).unionByName(valid.withColumn("is_valid", F.lit(1.0)))
    rf = RandomForestClassifier(numTrees=20, labelCol="is_valid", featuresCol="features", seed=SEED)
    model = rf.fit(assemble(d, features))
    return model, importance_table(model, features)


# ---------------------------------------------------------------- per-series forecast (O154, O155)
def fit_series(hist: DataFrame, key: str, date_col: str, value: str, holiday: str) -> DataFrame:
    """O154 re-aimed: per series a linear trend on log1p(y) plus weekday and holiday mean residuals.

    Returns one row per series (trend) and the effect tables, all from
    grouped aggregations (each series is bounded by its days).
    """
    t = F.datediff(F.col(date_col), F.lit("1970-01-01").cast("date")).cast("double")
    h = hist.select(key, date_col, t.alias("t"), F.log1p(value).alias("y"), F.weekday(date_col).alias("dow"),
                    F.col(holiday).alias("hol"))
    h = cut_lineage(h)  # read by five aggregations below
    trend = h.groupBy(key).agg(F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"))
    h = h.join(trend, key).withColumn("r", F.col("y") - (F.col("intercept") + F.col("slope") * F.col("t")))
    dow = h.groupBy(key, "dow").agg(F.avg("r").alias("dow_eff"))
    h = h.join(dow, [key, "dow"]).withColumn("r2", F.col("r") - F.col("dow_eff"))
    hol = h.where(F.col("hol") == 1).groupBy(key).agg(F.avg("r2").alias("hol_eff"))
    h = h.join(hol, key, "left").withColumn(
        "r3", F.col("r2") - F.when(F.col("hol") == 1, F.coalesce("hol_eff", F.lit(0.0))).otherwise(0.0))
    sig = h.groupBy(key).agg(F.stddev_samp("r3").alias("sigma"))
    return trend.join(hol, key, "left").join(sig, key), dow


def predict_series(rows: DataFrame, fit: DataFrame, dow: DataFrame, key: str, date_col: str, holiday: str,
                   z: float = 1.96) -> DataFrame:
    """O154: forecast, lower and upper band on a calendar of (key, date, holiday) rows."""
    t = F.datediff(F.col(date_col), F.lit("1970-01-01").cast("date")).cast("double")
    r = rows.withColumn("dow", F.weekday(date_col)).join(fit, key).join(dow, [key, "dow"], "left")
    yhat = (F.col("intercept") + F.col("slope") * t + F.coalesce("dow_eff", F.lit(0.0))
            + F.when(F.col(holiday) == 1, F.coalesce("hol_eff", F.lit(0.0))).otherwise(0.0))
    r = r.withColumn("yhat", yhat)
    return r.select(key, date_col, "yhat", (F.col("yhat") - z * F.col("sigma")).alias("yhat_lower"),
                    (F.col("yhat") + z * F.col("sigma")).alias("yhat_upper"))


def merge_forecast(rows: DataFrame, fc: DataFrame, key: str, date_col: str, prefix: str = "prop_") -> DataFrame:
    """O155: exp of the forecast columns, prefixed, left-joined by (key, date)."""
    f = fc.select(key, date_col, *[F.exp(c).alias(prefix + c) for c in ("yhat", "yhat_lower", "yhat_upper")])
    return rows.join(f, [key, date_col], "left")
