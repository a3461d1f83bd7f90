"""Session helpers.

`build_session` is for tests, benches and local runs.  Library code never
creates a session; it takes the caller's.  `checkpoint_dir` reads the shared
folder the cluster names in ``spark.checkpoint.dir`` and only sets one when
the setting is absent and the master is local (tests); on a cluster it raises.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "pitwise", extra: dict | None = None,
                  driver_memory: str = "16g") -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only if unset."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return spark.sparkContext.getCheckpointDir() or conf_dir
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="pitwise-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage like ``checkpoint()``, survives lost executors, and is compressed and columnar, so
    a table that several branches read costs little disk and each branch reads only its columns."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/pitwise-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def ensure_parallelism(df: DataFrame, *keys: str, factor: int = 2) -> DataFrame:
    """Hash-spread a table whose scan yields fewer partitions than cores (few large row groups)
    before CPU-heavy row work such as regex tokenising.  Large inputs are left untouched."""
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism * factor
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


#: Bytes of an Arrow batch of rows with long arrays or texts.
BATCH_BYTES = 8 << 20


def limit_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches, so that rows with long arrays go to a worker in small lots instead of 10,000 at once.
    The setting holds when a plan runs, so it stays; a lower one of the user is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?[0-9]+)([a-z]?)[a-z]*", spark.conf.get(key).strip().lower()).groups()
    if not 0 < int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
