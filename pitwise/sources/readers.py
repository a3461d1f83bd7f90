"""Readers: O1-O3, O6-O9, O182.  All return lazy DataFrames with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import global_row_number


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, rename: dict | None = None,
             **options) -> DataFrame:
    """O1: CSV with a declared schema (no inference pass) and column renames."""
    df = spark.read.schema(schema).option("header", True).options(**options).csv(path)
    return df.withColumnsRenamed(rename) if rename else df


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str,
                    target: str | None = None) -> DataFrame:
    """O2: JSON lines with a declared schema; rows without the target dropped."""
    df = spark.read.schema(schema).json(path)
    return df.where(F.col(target).isNotNull()) if target else df


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int = 8) -> DataFrame:
    """O3: SQL-table scan, partitioned on a numeric column when given (not exercised offline)."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


#: Labels up to which their numbers are broadcast, so that rows (with whole texts) aren't shuffled by label; a label may have most rows.
BROADCAST_LABELS = 100_000
#: Files that Spark's text reader decompresses, by their name.
COMPRESSED = ("gz", "bz2", "deflate", "lz4", "snappy", "zst")
#: Bytes of small files that a task reads, if that leaves tasks enough for the cores.
TASK_BYTES = 32 << 20


def labelled_paths(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """File name, label = parent folder, class index = position of the label in sorted labels."""
    parts = F.split(F.col(path_col), "/")
    d = paths.select("*", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("label"))
    classes = global_row_number(d.select("label").distinct(), ["label"]).select(
        "label", (F.col("rn") - 1).cast("int").alias("class_idx"))
    return d.join(F.broadcast(classes) if classes.count() <= BROADCAST_LABELS else classes, "label")


def _whole_files(spark: SparkSession, root: str) -> DataFrame:
    """Text and path of every file.  Bytes are read as they are, at a third of the cost of the text reader, which looks for codecs and
    copies its settings for each file; it reads the compressed files, if there are any."""
    source = spark.read.option("recursiveFileLookup", "true")
    path = F.col("_metadata.file_path")
    packed = path.rlike(rf"\.({'|'.join(COMPRESSED)})$")
    files = source.format("binaryFile").load(root)
    least = spark.sparkContext.defaultParallelism * 4
    size, others = files.select("length", packed.alias("packed")).coalesce(least).agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.when(F.col("packed"), 1))).first()
    # Spark counts 4 MB for each file and so would give a task some thirty of them
    tasks = max(least, size // TASK_BYTES)
    plain = files.where(~packed).select(F.col("content").cast("string").alias("text"), path.alias("path")).coalesce(tasks)
    if not others:
        return plain
    texts = source.option("pathGlobFilter", f"*.{{{','.join(COMPRESSED)}}}").text(root, wholetext=True)
    return plain.unionByName(texts.select(F.col("value").alias("text"), path.alias("path")))


def multi_label(df: DataFrame, name: str, labels: str, sep: str = " "):
    """`name,"a b c"` -> class list (sorted), n-hot arrays, and a single index when every row has one label.

    Returns (classes, encoded) where encoded has `labels_idx` (array<int>),
    `nhot` (array<double>) and `label_idx` (int, null when any row is multi-label).
    """
    ex = df.select(name, F.explode(F.split(labels, sep)).alias("lab")).where(F.col("lab") != "")
    classes = global_row_number(ex.select("lab").distinct(), ["lab"]).select(
        "lab", (F.col("rn") - 1).cast("int").alias("idx"))
    # planning scalars (two numbers): array width and whether every row has one label
    n_cls = classes.agg(F.count(F.lit(1))).first()[0]
    idx = (ex.join(classes, "lab").groupBy(name)
           .agg(F.array_sort(F.collect_set("idx")).alias("labels_idx")))  # per row: bounded by its labels
    idx = df.select(name).distinct().join(idx, name, "left").withColumn(  # rows without a label stay
        "labels_idx", F.coalesce("labels_idx", F.array().cast("array<int>")))
    sizes = idx.agg(F.min(F.size("labels_idx")), F.max(F.size("labels_idx"))).first()
    single = sizes[0] == sizes[1] == 1
    enc = idx.withColumn("nhot", F.transform(F.sequence(F.lit(0), F.lit(n_cls - 1)),
                                             lambda k: F.when(F.array_contains("labels_idx", k), 1.0).otherwise(0.0)))
    enc = enc.withColumn("label_idx", F.element_at("labels_idx", 1) if single else F.lit(None).cast("int"))
    return classes, enc


ANNOTATION_SCHEMA = ("filename string, annotations array<struct<height:double,width:double,x:double,y:double,"
                     "class:string>>")


def flatten_annotations(json_lines: DataFrame, col: str = "value") -> DataFrame:
    """Parse annotation JSON, one row per box, base file name."""
    p = json_lines.select(F.from_json(col, ANNOTATION_SCHEMA).alias("j"))
    ex = p.select(F.col("j.filename").alias("filename"), F.explode("j.annotations").alias("a"))
    return ex.select(F.substring_index("filename", "/", -1).alias("file"), "a.*")


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Header 'n dim', then 'word v1 .. vdim' lines -> (idx, word, vector array<float>).

    The index is the line position (0-based, header excluded) from the driver-free numbering.
    """
    full = F.col("_metadata.file_path")
    lines = spark.read.text(path).select(
        "value", F.regexp_extract(full, "^(.*)/[^/]*$", 1).alias("__d"), F.length(full).alias("__l"), full.alias("__f"),
        F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    # line order = (folder, file name with part numbers by value, block offset, position inside the block)
    keys = ["__d", "__l", "__f", "__b", "__m"]
    numbered = global_row_number(lines, keys).drop(*keys)
    body = numbered.where(F.col("rn") > 1)
    parts = F.split("value", " ", 2)
    return body.select((F.col("rn") - 2).alias("idx"), parts[0].alias("word"),
                       F.transform(F.split(F.trim(parts[1]), " "), lambda x: x.cast("float")).alias("vector"))


def read_text_folders(spark: SparkSession, root: str, lines: bool = False, eos: str = "<eos>", separator: str | None = None) -> DataFrame:
    """O182: whole files with label = folder (class index = sorted position), or all lines plus `eos`.

    With `separator` a file holds many documents that end in it, and large files are split between tasks; without, a file is one
    document, which at scale means as many files as documents."""
    if not lines:
        if not separator:
            return labelled_paths(_whole_files(spark, root))
        df = spark.read.option("recursiveFileLookup", "true").option("lineSep", separator).text(root)
        return labelled_paths(df.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path")))
    df = spark.read.option("recursiveFileLookup", "true").text(root)
    return df.select(F.concat(F.col("value"), F.lit(f" {eos}")).alias("text"),
                     F.col("_metadata.file_path").alias("path"))
