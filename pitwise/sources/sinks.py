"""Sinks: O4 (columnar intermediate), O5 (fixed-format CSV) and folders of text files (for O182)."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_intermediate(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet between steps (optionally partitioned, e.g. by end_date)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_intermediate(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: What Spark escapes in the name of a partition's folder.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _folder(label: str, value: str | None) -> str:
    """The folder that partitionBy(label) gives to a value."""
    name = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"
    return f"{label}={name}"


def _text_files(root: str, label: str):
    """Rows (label, text) as files; one row out: their number.

    A task writes into a folder of its own that readers don't see, and renames it when all files are there: of several attempts
    one counts."""
    def run(batches):
        own, n, made = f"{root}/.{uuid.uuid4().hex}", 0, set()
        for b in batches:
            for value, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folder = f"{own}/{_folder(label, value)}"
                if folder not in made:
                    os.makedirs(folder)
                    made.add(folder)
                with open(f"{folder}/{n:08d}.txt", "wb") as f:
                    f.write((text or b"") + b"\n")
                n += 1
        if n:
            whole = f"{root}/part-{TaskContext.get().partitionId():05d}"
            try:
                os.rename(own, whole)
            except OSError:
                if not os.path.isdir(whole):
                    raise
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])
    return run


def write_text_folders(df: DataFrame, path: str, label: str, text: str = "text", **options) -> None:
    """A file per row, its text and a line feed, in folders `label`=value as partitionBy(label) names them, one set of them per task.

    With a set per task its files are moved by renaming one folder, and readers list the sets in parallel.  In a store that
    executors open as local files they write the files themselves: there Hadoop, without its native library, starts a process
    (chmod) for each file it makes and for each check sum.  In other stores Spark's writer makes them, with `options`."""
    spark = df.sparkSession
    rows = df.select(F.col(label).cast("string").alias(label), F.col(text).cast("binary").alias(text))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        rows = rows.select(F.spark_partition_id().alias("part"), label, F.col(text).cast("string").alias(text))
        rows.write.options(maxRecordsPerFile=1, **options).partitionBy("part", label).text(path)
        return
    store.mkdirs(at)
    rows.mapInArrow(_text_files(at.toUri().getPath(), label), "n long").agg(F.sum("n")).collect()


def fixed_float(df: DataFrame, digits: int = 4) -> DataFrame:
    """Every double rendered with a fixed number of decimals (float_format='%.4f')."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.format_string(f"%.{digits}f", F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_submission_csv(df: DataFrame, path: str, digits: int = 4, gzip: bool = False) -> None:
    """CSV with header, no index, fixed float format, optional gzip."""
    w = fixed_float(df, digits).write.mode("overwrite").option("header", True)
    if gzip:
        w = w.option("compression", "gzip")
    w.csv(path)
