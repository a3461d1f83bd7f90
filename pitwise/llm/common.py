"""Shared helpers of the training-data operators: table access, staged tables, word hashes, block pairs, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.session import checkpoint_dir, staged  # noqa: F401  (staged is for the operators)

_U = np.uint64
#: Odd multipliers of the hash mixers (fixed values: the 64-bit golden ratio and two large odd constants).
MIX_A, MIX_B, MIX_C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch on its way to a Python worker (a row is never cut).
BATCH_BYTES = 8 << 20


def limit_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to `BATCH_BYTES`, so that rows with long texts or lists go to a worker in small
    lots instead of 10,000 at once.  The setting holds when a plan runs, so it stays; a lower one of the user is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?[0-9]+)([a-z]?)[a-z]*", spark.conf.get(key).strip().lower()).groups()
    if not 0 < int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str, *order: str) -> DataFrame:
    """`df` as a table in the shared folder, bucketed by `key`: joins and groupings on `key` shuffle only their
    other side, in any number of later jobs."""
    spark = df.sparkSession
    name = f"pitwise_{uuid.uuid4().hex}"
    n = n_parts(spark)
    (df.repartition(n, key).write.format("parquet").option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}")
     .bucketBy(n, key).sortBy(key, *order).saveAsTable(name))
    return spark.table(name)


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """A never-null long that orders rows by id: the id, or for a null id a value at the top of the long range
    taken from the text's hash (so null ids come last and don't share one key)."""
    high = F.lit((1 << 63) - 1) - F.xxhash64(F.col(text_col)).bitwiseAND(F.lit((1 << 40) - 1))
    return F.coalesce(F.col(id_col).cast("long"), high)


def row_hash(id_col: str = "doc_id", text_col: str = "text"):
    """Identity of a row by its id and text; equal for fully equal rows only."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).isNull(), F.col(text_col))


def as_bytes(col: str):
    """A text column as bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word; words are the runs without ASCII white space (0x20, 0x09-0x0D)."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * MIX_B
    x = (x ^ (x >> _U(27))) * MIX_C
    return x ^ (x >> _U(31))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(mix(left) * MIX_A + right)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of `k` consecutive words; empty with fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    out = words[:n].copy()
    for i in range(1, k):
        out = out * MIX_A + (words[i : i + n] ^ (out >> _U(32)))
    return mix(out)


def shingle_set(text: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words give one shingle, none give the empty set."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(k, len(words))))


#: Every byte but a-z, A-Z, 0-9 and those beyond ASCII becomes a space.
_PARTS = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return text.lower().translate(_PARTS).split()


def lowered(text: bytes) -> bytes:
    """A-Z lower-cased (bytes.lower changes ASCII letters only)."""
    return text.lower()


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: np.ndarray, lengths) -> pa.Array:
    """A list column from flat values and the length of each row's list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


# ---------------------------------------------------------------------------------------------------
# Pairs inside groups, in blocks

def in_blocks(rows: DataFrame, keys: list[str], spread: str, block: int, quiet: str | None = None) -> DataFrame:
    """Deal rows to square blocks of their group, so that no task holds a whole large group.

    A group of n rows gets ceil(n / block) slices by the hash of `spread`; every pair of slices (i <= j) is one
    block.  A row goes to each block of its slice, marked 0 in a diagonal block, 1 as the i side, 2 as the j
    side.  Pairs of two rows marked `quiet` aren't wanted: they get slices of their own, after the others, that meet
    only the others' slices.  Groups that hold no wanted pair are dropped.  Adds block_i, block_j, side."""
    silent = F.col(quiet) if quiet else F.lit(False)
    sizes = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(silent, 1)).alias("__q"))
             .where("__n > 1 and __q < __n"))
    x = rows.join(sizes, keys).withColumn("__loud", F.ceil((F.col("__n") - F.col("__q")) / F.lit(block)).cast("int"))
    x = x.withColumn("__quiet", F.ceil(F.col("__q") / F.lit(block)).cast("int"))
    h = F.xxhash64(F.col(spread), F.lit(17))
    x = x.withColumn("__b", F.when(silent, F.col("__loud") + F.pmod(h, F.greatest("__quiet", F.lit(1)))).otherwise(F.pmod(h, F.col("__loud"))).cast("int"))
    last = F.when(silent, F.col("__loud")).otherwise(F.col("__loud") + F.col("__quiet")) - 1
    x = x.withColumn("__o", F.explode(F.sequence(F.lit(0), last)))
    return (x.withColumn("block_i", F.least("__b", "__o")).withColumn("block_j", F.greatest("__b", "__o"))
            .withColumn("side", F.when(F.col("__b") == F.col("__o"), 0).when(F.col("__b") < F.col("__o"), 1).otherwise(2))
            .drop("__n", "__q", "__loud", "__quiet", "__b", "__o"))


def segments(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of a partition that is sorted by `keys` (all non-null numbers).

    Each yielded table holds one or many complete groups; only the group that a batch cuts is carried over."""
    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if carry is not None:
            t = pa.concat_tables([carry, t]).combine_chunks()
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(change)
        if not len(at):
            carry = t
            continue
        yield t.slice(0, at[-1]).combine_chunks()
        carry = t.slice(at[-1]).combine_chunks()
    if carry is not None:
        yield carry


def group_bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows + 1, bool)
    change[0] = change[-1] = True
    for k in keys:
        v = t[k].to_numpy()
        change[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


# ---------------------------------------------------------------------------------------------------
# Connected components

def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition replaced by (node, smallest node of its tree): at most one edge a node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while up.get(r, r) != r:
            r = up[r]
        while up.get(x, x) != r:
            up[x], x = r, up[x]
        return r

    def out():
        nodes = np.fromiter(up, np.int64, len(up))
        roots = np.fromiter((root(int(x)) for x in nodes), np.int64, len(nodes))
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            up.setdefault(a, a)
            up.setdefault(b, b)
            ra, rb = root(a), root(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
        if len(up) > 500_000:  # bounded memory: hand on what is merged so far
            yield out()
            up.clear()
    if up:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of an edge (a, b): comp is the smallest node that it reaches.

    Labels start as the node itself; each round takes the smallest label among the neighbours, then follows the
    label's own label (pointer jumping), so a chain of n nodes takes about log n rounds.  The labels of each round
    are a staged table; nothing but the count of changed labels comes to the driver."""
    trees = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(spanning, "a long, b long")
    both = staged(trees.unionByName(trees.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("comp")))
    while True:
        near = (both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node"))
                .agg(F.min("comp").alias("near")))
        step = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = staged(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("comp")))
        changed = not new.where("comp <> old").isEmpty()
        label = new.select("node", "comp")
        if not changed:
            return label
