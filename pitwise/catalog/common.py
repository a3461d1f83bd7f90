"""Shared helpers for registered queries and oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

DIGITS = 6


def rounded_column(x: Column, digits: int = DIGITS) -> Column:
    """F.round of a double, without its way over decimal strings: a number whose place between two multiples of the last
    digit is clear is the nearer one, which one correctly rounded division gives; the rest (ties, large, NaN) goes to F.round."""
    scaled = x * 10.0 ** digits
    whole = F.rint(scaled)
    clear = (F.abs(scaled - whole) < 0.499) & (F.abs(scaled) < 1e12)  # beyond, a double's own steps near the thousandths left
    return F.when(clear, whole.cast("long") / F.lit(10.0 ** digits)).otherwise(F.round(x, digits))


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column so the value hash is stable across engines."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(rounded_column(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def q(name: str) -> str:
    """Quote an identifier for DuckDB."""
    return '"' + name.replace('"', '""') + '"'


def r(expr: str, digits: int = DIGITS) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits})"
