"""Plug-in surface: O172-O177.

Feature functions, hooks, custom aggregates and metrics are plain Python
callables returning DataFrames or Columns; they compose into Spark plans, so a
plug-in runs distributed like built-in code.  Only a user's own functions cross
into Python: a pandas function per group (O175), and an aggregate given by
zero, update, merge and finish, which keeps one state per key and task (O176).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, Callable, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from ..functions import stats as S


@dataclass
class FeatureFamily:
    """O172: a feature function and the key it joins to the label rows with."""

    fn: Callable  # (PitContext) -> DataFrame keyed by end_date + keys
    keys: list[str]
    labelled: bool = False  # the function makes `ctx.family` features with these very keys, so it needs only the pairs of label rows


@dataclass
class ColumnRoles:
    """Column roles that travel with a table; roles keep only columns still present."""

    categorical: list[str] = field(default_factory=list)
    continuous: list[str] = field(default_factory=list)

    def restrict(self, df: DataFrame) -> "ColumnRoles":
        cols = set(df.columns)
        return ColumnRoles([c for c in self.categorical if c in cols], [c for c in self.continuous if c in cols])

    def extend(self, cats=(), contins=()) -> "ColumnRoles":
        return ColumnRoles(list(dict.fromkeys([*self.categorical, *cats])),
                           list(dict.fromkeys([*self.continuous, *contins])))


def build_with_families(ctx, families: list[FeatureFamily], high_eng: Callable | None = None) -> DataFrame:
    """O172: label rows + every plug-in family joined by key; optional second-order hook."""
    from ..plans import pit
    pit.co_partition(ctx.data.sparkSession)
    lab = pit.labels(ctx)
    for fam in families:
        lab = pit.attach(lab, fam.fn(ctx.at_labels() if fam.labelled else ctx), fam.keys)
    return high_eng(lab) if high_eng else lab


def apply_hook(df: DataFrame, fn: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """O173: a preprocessing hook is a DataFrame transform."""
    return df.transform(fn) if fn else df


def group_apply(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """O175: a user pandas function per group (Arrow batches; groups must be bounded, e.g. per store-day series)."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def custom_aggregate(name: str) -> Callable[..., Column]:
    """O176: named custom aggregates as Column factories."""
    table = {"weighted_mean": S.weighted_mean,
             "first_time": lambda pivot, d: F.datediff(pivot, F.min(d)),
             "last_time": lambda pivot, d: F.datediff(pivot, F.max(d))}
    return table[name]


class Aggregate(NamedTuple):
    """O176: a user's aggregate in four functions; states must be picklable, `merge` associative and commutative."""
    zero: Callable[[], Any]
    update: Callable[..., Any]  # (state, *values of a row) -> state
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


#: The weighted mean as an aggregate: rows where weight or value is null don't count, no such row gives null.
WEIGHTED_MEAN = Aggregate(
    lambda: (0.0, 0.0), lambda s, w, x: s if w is None or x is None else (s[0] + w * x, s[1] + w),
    lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[0] / s[1] if s[1] else None)

STATES = 50_000  #: states that a task holds before it hands them on


def _partial_states(keys: list[str], cols: list[str], agg: Aggregate):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}

        def out(schema):
            arrays = [pa.array([k[i] for k in states], schema.field(c).type) for i, c in enumerate(keys)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], names=[*keys, "__state"])

        schema = None
        for b in batches:
            schema = b.schema
            values = [b.column(c).to_pylist() for c in cols]
            key_rows = zip(*(b.column(k).to_pylist() for k in keys)) if keys else (() for _ in range(b.num_rows))
            for key, *row in zip(key_rows, *values):
                state = states[key] if key in states else agg.zero()
                states[key] = agg.update(state, *row)
            if len(states) >= STATES:
                yield out(schema)
                states.clear()
        if states:
            yield out(schema)
    return run


def _merged_states(keys: list[str], agg: Aggregate, names: list[str], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def out(schema):
            arrays = [pa.array([k[i] for k, _ in done], schema.field(c).type) for i, c in enumerate(keys)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([v for _, v in done], kind)], names=names)

        schema = None
        for b in batches:
            schema = b.schema
            key_rows = zip(*(b.column(k).to_pylist() for k in keys)) if keys else (() for _ in range(b.num_rows))
            for key, raw in zip(key_rows, b.column("__state").to_pylist()):
                if now is not None and key == now:
                    state = agg.merge(state, pickle.loads(raw))
                    continue
                if now is not None:
                    done.append((now, agg.finish(state)))
                now, state = key, pickle.loads(raw)
            if len(done) >= STATES:
                yield out(schema)
                done.clear()
        if now is not None:
            done.append((now, agg.finish(state)))
        if done:
            yield out(schema)
    return run


def mergeable_aggregate(df: DataFrame, keys: list[str], cols: list[str], agg: Aggregate, out: str, kind: str = "double") -> DataFrame:
    """O176: a user's aggregate with partial states per task.

    Every task folds its rows into one state per key (handing states on when it holds `STATES`), so what is shuffled is
    states, not rows, and a key that holds a third of all rows costs one state a task.  The states of a key are merged in
    key order, one at a time.  A null key is a group of its own; without keys there is one group, and no rows give none."""
    kinds = [f"`{k}` {dict(df.dtypes)[k]}" for k in keys]
    states = df.select(*keys, *[c for c in cols if c not in keys]).mapInArrow(_partial_states(keys, cols, agg), ", ".join([*kinds, "__state binary"]))
    dealt = states.repartition(*keys).sortWithinPartitions(*keys) if keys else states.repartition(1)
    schema = StructType([*(df.schema[k] for k in keys), StructField(out, DataType.fromDDL(kind))])
    return dealt.mapInArrow(_merged_states(keys, agg, schema.names, to_arrow_type(schema[out].dataType)), schema)


METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_metric(name: str):
    """O177: a custom evaluation metric is a function DataFrame -> one-row DataFrame."""
    def deco(fn):
        METRICS[name] = fn
        return fn
    return deco


@register_metric("rmsle")
def _rmsle(df: DataFrame, actual: str = "actual", pred: str = "pred") -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.log1p(pred) - F.log1p(actual), 2))).alias("rmsle"))
