"""Statistic expression factories (O39, O45-O47, O58, O176).

All return `Column`s usable inside one `agg`, so many horizons and statistics
share one shuffle and Spark's partial (map-side) aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The statistic names and their order in the summaries.
SUMMARY7 = ("min", "mean", "median", "max", "count", "std", "skew")
# Decay rates of the store x weekday exponential means.
DECAY_RATES = (0.9, 0.95, 0.97, 0.98, 0.985, 0.99, 0.999, 0.9999)
DEFAULT_DECAY = 0.985


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def skew_g1(x) -> Column:
    """Bias-corrected sample skewness (pandas `skew`): null for n<3, 0.0 for zero variance."""
    x = _c(x)
    n = F.count(x)
    g1 = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.max(x) == F.min(x), F.lit(0.0))
            .otherwise(g1))


def stat(name: str, x) -> Column:
    x = _c(x)
    if name == "min":
        return F.min(x).cast("double")
    if name == "mean":
        return F.avg(x)
    if name == "median":
        return F.percentile(x, 0.5)
    if name == "max":
        return F.max(x).cast("double")
    if name == "count":
        return F.count(x)
    if name == "std":
        return F.stddev_samp(x)
    if name == "skew":
        return skew_g1(x)
    if name == "sum":
        return F.sum(x)
    raise ValueError(name)


def summary7(x, prefix: str, suffix: str = "", stats=SUMMARY7) -> list[Column]:
    """`{prefix}_{stat}{suffix}` for the seven statistics of O39 over column/expression x."""
    return [stat(s, x).alias(f"{prefix}_{s}{suffix}") for s in stats]


def within(age, horizon: int, x) -> Column:
    """x restricted to the open statistic window of a horizon: ages 1 .. horizon-1."""
    return F.when(_c(age) < horizon, _c(x))


def decay_weight(age, rate: float) -> Column:
    return F.pow(F.lit(rate), _c(age).cast("double"))


def decay_sums(x, age, rate: float) -> tuple[Column, Column]:
    """(sum(x * rate^age), sum(rate^age)) - the two additive parts of a decayed mean."""
    w = decay_weight(age, rate)
    return F.sum(_c(x) * w), F.sum(F.when(_c(x).isNotNull(), w))


def weighted_mean(w, x) -> Column:
    """O176 custom aggregate: sum(w*x)/sum(w) over rows where both are present."""
    w, x = _c(w), _c(x)
    ok = w.isNotNull() & x.isNotNull()
    return F.sum(F.when(ok, w * x)) / F.sum(F.when(ok, w))


def rate_name(rate: float) -> str:
    """Column-name form of a rate: 0.985 -> '0p985' (dots are path separators in Spark names)."""
    return repr(rate).replace(".", "p")
