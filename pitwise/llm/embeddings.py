"""Near-duplicate embeddings by collision counting on one-dimensional projections.

Unit vectors are projected on random directions.  For a pair with cosine s the difference of a projection is normal
with variance 2 (1 - s), so near pairs stay close on most projections and others do not.  Vectors are dealt to cells
(several tables of cells, each cell a tuple of coarse projection intervals), and in a cell sorted by each of the first
`COUNTING - least_count + 1` counting projections; around each vector, as the query, a window is laid on them.  A pair with at least
`least_count` collisions over all counting projections collides on one of the sorted ones, so the windows lose none; the collisions of
the pairs found are counted over all of them, and only pairs with at least `least_count` are verified with the cosine in double precision.  Width, count and number of tables
follow from the binomial and normal distributions for the wanted recall at the similarity threshold itself; pairs
above it are found more surely.  Intervals per cell grow with the logarithm of the table, so that a cell of unrelated vectors keeps its size.

Skew: equal vectors are one class from the start.  A crowded cell is dealt to square blocks of bounded size.  A pair
is counted only in the first table whose cell both share, so links need no removal of repeats, and a block gives
one row per vector (its number of links and the smallest vector it hangs together with), never its pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components have no links; so have
vectors of different lengths with each other; repeated rows are equal vectors and link; null ids never name a component
unless it has no other id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, components, group_bounds, in_blocks, longs, mix, n_parts, segments, staged

COSINE = 0.95
TABLE_RECALL = 0.98
COUNT_RECALL = 0.995
COUNTING = 16
INTERVAL = 1.5
CROWD = 32
BLOCK = 512
_CELL = ["cell", "block_i", "block_j"]


def same_interval(spread: float, width: float) -> float:
    """Chance that two points whose difference is normal with this spread share an interval of a random grid."""
    r = width / spread
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


class Plan:
    """Projections, cells and counting threshold for `n` classes of vectors."""

    def __init__(self, n: int, cosine: float = COSINE):
        self.cosine = cosine
        self.spread = math.sqrt(2 * (1 - cosine))
        near, far = same_interval(self.spread, INTERVAL), same_interval(math.sqrt(2), INTERVAL)
        self.intervals = max(1, round(math.log(max(2, n / CROWD)) / -math.log(far)))
        self.tables = math.ceil(math.log(1 - TABLE_RECALL) / math.log(1 - near ** self.intervals))
        self.window = 2 * self.spread
        p = math.erf(2 / math.sqrt(2))
        self.least_count = max(c for c in range(COUNTING + 1) if sum(
            math.comb(COUNTING, k) * p**k * (1 - p) ** (COUNTING - k) for k in range(c, COUNTING + 1)) >= COUNT_RECALL)
        self.sorted = COUNTING - self.least_count + 1  # a pair with enough collisions has one on these

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cell of each vector in each table (rows x tables)."""
        directions, offsets, _ = _directions(unit.shape[1], self.tables, self.intervals)
        at = np.floor(unit @ directions / INTERVAL + offsets).astype(np.int64).view(_U)
        at = at.reshape(len(unit), self.tables, self.intervals)
        h = np.broadcast_to(mix(np.arange(1, self.tables + 1, dtype=_U) + _U(unit.shape[1] << 32)), at.shape[:2]).copy()
        for k in range(self.intervals):
            h = mix(h + at[:, :, k] * _U(0x9E3779B97F4A7C15))
        return h

    def counting(self, unit: np.ndarray) -> np.ndarray:
        return unit @ _directions(unit.shape[1], self.tables, self.intervals)[2]


@lru_cache(maxsize=8)
def _directions(dim: int, tables: int, intervals: int):
    rng = np.random.default_rng(20240 + dim)
    return rng.standard_normal((dim, tables * intervals)), rng.random(tables * intervals), rng.standard_normal((dim, COUNTING))


def _read(kind: str):
    """Rows (id, v) to (id, cls, vec): vec the vector's bytes, null if it can't be linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, vec = [], []
            for v in batch.column("v").to_pylist():
                x = None if not v or any(e is None for e in v) else np.asarray(v, kind) + np.asarray(0, kind)  # -0.0 is 0.0
                ok = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
                vec.append(x.tobytes() if ok else None)
                cls.append(xxhash.xxh3_128_digest(vec[-1]) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cls, pa.binary()), pa.array(vec, pa.binary())],
                                             names=["id", "cls", "vec"])
    return run


def _units(vecs: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision, one length only; scaled by the largest component first, so nothing overflows."""
    x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _deal(plan: Plan, kind: str):
    def run(batches):
        for batch in batches:
            vecs, nids = batch.column("vec").to_pylist(), batch.column("nid").to_numpy()
            sizes = np.array([len(v) for v in vecs], np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                cells = plan.cells(_units([vecs[i] for i in at], kind))
                yield pa.RecordBatch.from_arrays([longs(cells.ravel()), pa.array(np.repeat(nids[at], cells.shape[1]))], names=["cell", "nid"])
    return run


def _window_pairs(key: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions whose sorted keys are at most `window` apart."""
    order = np.argsort(key, kind="stable")
    ends = np.searchsorted(key[order], key[order] + window, side="right")
    reach = ends - np.arange(len(key)) - 1
    first = np.repeat(np.arange(len(key)), reach)
    step = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    return order[first], order[first + step + 1]


def linked_pairs(unit: np.ndarray, side: np.ndarray, cell: int, plan: Plan, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of one block that share no earlier table's cell than this one."""
    points, n = plan.counting(unit), len(unit)
    found = np.empty(0, np.int64)
    for j in range(plan.sorted):
        a, b = _window_pairs(points[:, j], plan.window)
        keep = (side[a] == 0) | (side[a] != side[b])
        found = np.union1d(found, np.minimum(a, b)[keep] * n + np.maximum(a, b)[keep])
    a, b = found // n, found % n
    count = np.zeros(len(a), np.int16)
    for j in range(COUNTING):
        count += np.abs(points[a, j] - points[b, j]) <= plan.window
    a, b = a[count >= plan.least_count], b[count >= plan.least_count]
    found_a, found_b = [], []
    for at in range(0, len(a), 65536):
        x, y = a[at : at + 65536], b[at : at + 65536]
        ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= plan.cosine
        x, y = x[ok], y[ok]
        shared = cells[x] == cells[y]
        ok = cells[x, shared.argmax(axis=1)] == cell if len(x) else np.zeros(0, bool)
        found_a.append(x[ok])
        found_b.append(y[ok])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (a[:0], b[:0])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that each position of a block reaches by links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(plan: Plan, kind: str):
    """One row per linked vector of a block: (a, b, n) with b the smallest vector of its tree there and n its links."""
    def run(batches):
        for t in segments(batches, _CELL):
            cell, nid, side, copies = (t[c].to_numpy() for c in ("cell", "nid", "side", "copies"))
            vecs, bounds = t["vec"].to_pylist(), group_bounds(t, _CELL)
            out_a, out_b, out_n = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if hi - lo < 2:
                    continue
                rank = np.argsort(nid[lo:hi], kind="stable") + lo  # smallest vector first, so positions order like ids
                unit = _units([vecs[i] for i in rank], kind)
                cells = plan.cells(unit)
                a, b = linked_pairs(unit, side[rank], cell[lo].astype(np.int64).view(_U), plan, cells)
                if not len(a):
                    continue
                n = np.bincount(a, copies[rank][b], hi - lo) + np.bincount(b, copies[rank][a], hi - lo)
                root, some = _roots(hi - lo, a, b), np.flatnonzero(n)
                out_a.append(nid[rank][some])
                out_b.append(nid[rank][root[some]])
                out_n.append(n[some].astype(np.int64))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b, out_n)], names=["a", "b", "n"])
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id (smallest id reachable, itself
    included) and kept (id = component_id)."""
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    read = staged(rows.mapInArrow(_read(kind), "id long, cls binary, vec binary"))
    classes = (read.where("cls is not null").groupBy("cls")
               .agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")))
    classes = staged(classes.withColumn("nid", F.monotonically_increasing_id()))
    plan = Plan(classes.count(), cosine)

    dealt = classes.select("nid", "vec").mapInArrow(_deal(plan, kind), "cell long, nid long")
    blocks = in_blocks(dealt, ["cell"], "nid", BLOCK).join(classes.select("nid", "copies", "vec"), "nid")
    links = staged(blocks.repartition(n_parts(spark), *_CELL).sortWithinPartitions(*_CELL)
                   .mapInArrow(_links(plan, kind), "a long, b long, n long"))

    label = components(links.where("a <> b").select("a", "b"))
    counts = links.groupBy(F.col("a").alias("nid")).agg(F.sum("n").alias("n"))
    known = (classes.select("cls", "nid", "least_id", "copies").join(counts, "nid", "left")
             .join(label, F.col("nid") == F.col("node"), "left")
             .select("cls", "least_id", F.coalesce("comp", "nid").alias("comp"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = known.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of_class = known.join(least, "comp").select("cls", "n_links", "component_id")
    return (read.select("id", "cls").join(of_class, "cls", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))
