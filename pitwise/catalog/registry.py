"""All registered queries: name -> Spark callable, name -> DuckDB SQL."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

MODULES = ("pit_queries", "ts_queries", "rel_queries", "prep_queries", "text_queries", "str_queries",
           "eval_queries", "model_queries", "io_queries")


def _mods():
    return [import_module(f"pitwise.catalog.{m}") for m in MODULES]


def _utc(fn):
    """Timestamps in the data are zone-less; pin the session zone so conversions match the oracle.

    Stages over dozens of columns compile to methods that the JVM's compiler refuses (8000 bytes, HotSpot's limit) and would run
    interpreted; with Spark's limit at the same value such a stage runs operator by operator, in compiled pieces."""
    @wraps(fn)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        return fn(spark, sf_dir)
    return run


def queries() -> dict:
    out: dict = {}
    for m in _mods():
        out.update({k: _utc(v) for k, v in m.QUERIES.items()})
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _mods():
        out.update(m.oracle())
    return out


def flagship(spark, sf_dir):
    from . import pit_queries
    return _utc(pit_queries.q_training_set)(spark, sf_dir)
