"""pitwise: point-in-time feature engineering on Spark DataFrames.

Layout
------
sources/    table loading, canonical inputs, readers and sinks
functions/  Column-expression factories (dates, strings, statistics, arrays)
operators/  DataFrame -> DataFrame operators (joins, cleaning, events, rolling,
            encoding, splits, text, boxes, metrics, models, plug-ins)
plans/      composed jobs: pivot-window training set, rolling table, clinical ETL
streaming/  (intentionally empty: the feature set has no streaming operators)
catalog/    registered queries with their DuckDB oracle SQL
"""

__version__ = "0.1.0"
