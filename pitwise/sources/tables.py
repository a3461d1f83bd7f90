"""Driver Parquet tables and the `Tables` bundle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass
class Tables:
    """Named bundle of lazily read tables (the reference passes a dict of frames)."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = table(self.spark, self.sf_dir, name)
        return self._cache[name]

    def __getitem__(self, name: str) -> DataFrame:
        return self.__getattr__(name)


def glob_bundle(spark: SparkSession, folder: str, fmt: str = "parquet",
                names: list[str] | None = None, **options) -> dict[str, DataFrame]:
    """Every file of a folder becomes a table named by its stem.

    The listing happens on the driver through Hadoop's file system (names
    only); the data stays in Spark.
    """
    jvm = spark.sparkContext._jvm
    jsc = spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(jsc.hadoopConfiguration())
    out: dict[str, DataFrame] = {}
    for st in fs.listStatus(path):
        fname = st.getPath().getName()
        if not fname.endswith("." + fmt):
            continue
        stem = fname[: -(len(fmt) + 1)]
        if names is not None and stem not in names:
            continue
        out[stem] = spark.read.format(fmt).options(**options).load(str(st.getPath()))
    return out
