"""A cross-section of registered queries against their DuckDB twins at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from pitwise.sources.tables import TABLE_NAMES
from tools.oracle_check import digest

NAMES = ["pit_store_stats", "pit_labels", "rolling_store_stats", "events_duration", "joins_hierarchical_fallback",
         "encode_proc_df", "split_stratified", "text_vocabulary", "text_nb_ratio", "boxes_rescaled_with_default",
         "eval_spearman", "models_forecast", "io_word_vectors"]


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, small_dir, con, name):
    s = E.queries()[name](spark, small_dir).toPandas()
    o = con.sql(E.oracle_sql()[name]).to_arrow_table().to_pandas()
    assert digest(s) == digest(o)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "end_date" in df.columns
