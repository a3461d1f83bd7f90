"""MinHash near-duplicates by a multi-index Hamming join.

Each distinct shingle set gets a signature of `POSITIONS` b-bit MinHash values.  The distance of two signatures is
the number of positions that differ; sets with Jaccard similarity s differ in about (1 - s) of the positions.
All pairs of signatures within `max_distance` share, by the pigeonhole principle, at least one of the signature's
chunks with at most ``max_distance // chunks`` errors, so each chunk is indexed once for every allowed set of wrong
positions (those left out of the key) and an equi-join on the keys finds every such pair.  Pairs that share a key are confirmed on
the full sets up to `confirm_distance`, well beyond the guaranteed distance: 100 * intersection >= 75 * union.

Skew: rows with equal sets are one class from the start, so a group of exact copies costs one row.  In a key shared by
many classes each class is first compared with the smallest one alone (a star).  Classes whose keys are then still
split over components are looked at in blocks: components with two classes within the signature distance are tied to a
family, and the members of a family that are in different components are compared on full sets.  Both go block by block, the largest component of a
group against the rest only, and a block gives a spanning forest, never its pairs.

Recall: a pair at a similarity of exactly 0.75 is within distance 26 with probability 0.998; counting the pairs beyond it,
it shares no key with probability 1.1e-7 and is beyond distance 34 with 3.8e-7 (pairs of more similar sets more rarely).

Defined results: a null or empty text has no set, is linked with nothing, and is its own component; null ids never
name a component unless a component has no other id; repeated rows are equal sets, hence one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (_U, as_bytes, components, group_bounds, in_blocks, limit_batches, lists, longs, lowered, mix, n_parts, pair_hash,
                     row_hash, row_key, segments, shingle_set, staged)

POSITIONS = 64
#: A pair at exactly 0.75 differs in Binomial(64, 0.25) positions: at most 26 with probability 0.998.
MAX_DISTANCE = 26
#: Pairs that share a key are confirmed up to here: a pair at exactly 0.75 is beyond it with probability 3.8e-7.
CONFIRM_DISTANCE = 34
CHUNKS = 14
WORDS = 5
BLOCK, SET_BLOCK = 1024, 256
_SEEDS = mix(np.arange(1, POSITIONS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16-bit MinHash values of a non-empty set, one per position."""
    least = np.full(POSITIONS, np.iinfo(_U).max, _U)
    for at in range(0, len(shingles), 4096):  # bounded memory for very long texts
        least = np.minimum(least, np.multiply.outer(_SEEDS, shingles[at : at + 4096]).min(axis=1))
    return (mix(least + _SEEDS) & _U(0xFFFF)).astype(np.uint16)


def chunk_positions(positions: int = POSITIONS, chunks: int = CHUNKS) -> list[np.ndarray]:
    return [np.asarray(c) for c in np.array_split(np.arange(positions), chunks)]


def index_keys(signatures: np.ndarray, max_distance: int = MAX_DISTANCE, chunks: int = CHUNKS) -> np.ndarray:
    """Index keys of each signature (rows x keys): for each chunk and each choice of allowed errors, a hash of the
    chunk's other positions."""
    errors = max_distance // chunks
    keys = []
    for c, where in enumerate(chunk_positions(signatures.shape[1], chunks)):
        for v, out in enumerate(combinations(range(len(where)), min(errors, len(where) - 1))):
            kept = np.delete(where, out)
            h = np.full(len(signatures), _U(c * 1000 + v + 1))
            for p in kept:
                h = pair_hash(h, signatures[:, p].astype(_U))
            keys.append(h)
    return np.stack(keys, axis=1)


def _read(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (rk, row, id, text) to rows (rk, row, id, n, cls, sig) without text; cls is a 128-bit hash of the sorted set."""
    for batch in batches:
        n, cls, sig = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(lowered(text), k)
            n.append(len(s))
            cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rk"), batch.column("row"), batch.column("id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
             pa.array(sig, pa.binary())], names=["rk", "row", "id", "n", "cls", "sig"])


def _sigs(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), POSITIONS)


def _keys(max_distance: int, chunks: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = index_keys(_sigs(batch.column("sig")), max_distance, chunks)
            yield pa.RecordBatch.from_arrays(
                [longs(keys.ravel()), pa.array(np.repeat(batch.column("nid").to_numpy(), keys.shape[1]))],
                names=["key", "nid"])
    return run


def _near(max_distance: int, percent: int):
    """Keep the pairs whose signatures and set sizes allow the similarity."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = (_sigs(batch.column("sig_a")) != _sigs(batch.column("sig_b"))).sum(1)
            na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            ok = (d <= max_distance) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))],
                                             names=["a", "b"])
    return run


def _open_pairs(t: pa.Table, lo: int, hi: int, sig: np.ndarray, comp: np.ndarray, max_distance: int, percent: int):
    """For each row of a block the later rows of other components within the signature distance."""
    size, side = t["n"].to_numpy(), t["side"].to_numpy()
    right = lo + np.flatnonzero(side[lo:hi] == 2)
    for i in range(lo, hi):
        if side[i] == 2:
            continue
        js = np.arange(i + 1, hi) if side[i] == 0 else right
        js = js[comp[js] != comp[i]]
        js = js[100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])]
        if len(js):
            js = js[(sig[js] != sig[i]).sum(1) <= max_distance]
            if len(js):
                yield i, js


class _Forest:
    """Union-find over the components of one block."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(above, above)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _pairs_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.sort(np.asarray(found, np.int64).reshape(-1, 2), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


_CELL = ["block_i", "block_j"]


def _tie(key: str, max_distance: int, percent: int):
    """Components (a, b) of each block that open pairs tie, as a spanning forest: at most one row per component."""
    def run(batches):
        cell = [key, *_CELL]
        for t in segments(batches, cell):
            sig, comp, found = _sigs(t["sig"]), t["comp"].to_numpy(), []
            bounds = group_bounds(t, cell)
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                forest = _Forest()
                for i, js in _open_pairs(t, lo, hi, sig, comp, max_distance, percent):
                    x = int(comp[i])
                    found += [(x, y) for y in np.unique(comp[js]).tolist() if forest.join(x, y)]
            if found:
                yield _pairs_batch(found)
    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _link(key: str, max_distance: int, percent: int):
    """Confirmed links between components in each block, on full sets; at most one for two components."""
    def run(batches):
        cell = [key, *_CELL]
        for t in segments(batches, cell):
            sig, nid, comp, found = _sigs(t["sig"]), t["nid"].to_numpy(), t["comp"].to_numpy(), []
            sets = t["grams"].combine_chunks()
            bounds = group_bounds(t, cell)
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                forest = _Forest()
                for i, js in _open_pairs(t, lo, hi, sig, comp, max_distance, percent):
                    a = sets[i].values.to_numpy().view(_U)
                    for j in js.tolist():
                        x, y = int(comp[i]), int(comp[j])
                        if forest.root(x) != forest.root(y) and _similar(a, sets[j].values.to_numpy().view(_U), percent):
                            forest.join(x, y)
                            found.append((nid[i], nid[j]))
            if found:
                yield _pairs_batch(found)
    return run


def _blocked(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Blocks of each group, sorted for `segments`; the rows of a group's largest component needn't meet each other."""
    counts = rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("__n"))
    top = counts.groupBy(key).agg(F.max(F.struct("__n", "comp")).alias("__t")).select(key, F.col("__t.comp").alias("__top"))
    marked = rows.join(top, key).withColumn("quiet", F.col("comp") == F.col("__top")).drop("__top")
    return in_blocks(marked, [key], "nid", block, "quiet").drop("quiet")


def _dealt(blocks: DataFrame, key: str) -> DataFrame:
    cell = [key, *_CELL]
    return blocks.repartition(n_parts(blocks.sparkSession), *cell).sortWithinPartitions(*cell)


def _sets(k: int):
    """Shingle sets of the wanted classes from texts."""
    def run(batches):
        for batch in batches:
            nid, sets = [], []
            for text, want, node in zip(*(batch.column(c).to_pylist() for c in ("text", "cls", "nid"))):
                s = shingle_set(lowered(text), k)
                if xxhash.xxh3_128_digest(s.tobytes()) == want:
                    nid.append(node)
                    sets.append(s)
            flat = np.concatenate(sets) if sets else np.empty(0, _U)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nid, pa.int64()), lists(flat.view(np.int64), [len(s) for s in sets])], names=["nid", "grams"])
    return run


def _confirm(percent: int):
    """Pairs whose full sets reach the similarity; sets are sorted as unsigned numbers."""
    def run(batches):
        for batch in batches:
            x, y = batch.column("grams_a"), batch.column("grams_b")
            ok = [_similar(x[i].values.to_numpy().view(_U), y[i].values.to_numpy().view(_U), percent) for i in range(batch.num_rows)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])
    return run


def _apart(shared: DataFrame, label: DataFrame) -> DataFrame:
    """Rows (key, nid, comp) of the keys whose classes are in more than one component."""
    now = shared.join(label, shared["nid"] == label["node"], "left").select("key", "nid", F.coalesce("comp", "nid").alias("comp"))
    split = now.groupBy("key").agg(F.min("comp").alias("__lo"), F.max("comp").alias("__hi")).where("__lo < __hi").select("key")
    return now.join(split, "key")


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS,
                       percent: int = 75, max_distance: int = MAX_DISTANCE, chunks: int = CHUNKS,
                       confirm_distance: int = CONFIRM_DISTANCE) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable, itself included), kept (id =
    component_id), row_hash, and stays (true for the rows of one text of each component)."""
    spark = docs.sparkSession
    limit_batches(spark)
    confirm_distance = max(confirm_distance, max_distance)
    parts = n_parts(spark)
    rows = docs.select(row_key(id_col, text_col).alias("rk"), row_hash(id_col, text_col).alias("row"),
                       F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text"))
    read = staged(rows.mapInArrow(lambda b: _read(b, k), "rk long, row long, id long, n long, cls binary, sig binary"))

    classes = (read.where("cls is not null").groupBy("cls")
               .agg(F.min(F.struct("rk", "row")).alias("at"), F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    classes = staged(classes.select("*", "at.*").drop("at").withColumn("nid", F.monotonically_increasing_id()))
    keys = classes.select("nid", "sig").repartition(parts, "nid").mapInArrow(_keys(max_distance, chunks), "key long, nid long")

    # only keys that several classes share, and the sets of their classes, matter from here on
    shared = keys.groupBy("key").agg(F.min("nid").alias("hub"), F.max("nid").alias("__top")).where("hub < __top").drop("__top")
    shared = staged(keys.join(shared, "key"))
    # (one row of each, by id and text: the texts of one id are as many rows, not all met with all of its classes)
    want = shared.select("nid").distinct().join(classes.select("nid", "rk", "row", "cls"), "nid")
    sets = staged(rows.select("rk", "row", "text").join(want, ["rk", "row"]).mapInArrow(_sets(k), "nid long, grams array<long>")
                  .groupBy("nid").agg(F.first("grams").alias("grams")))

    def near(pairs: DataFrame) -> DataFrame:
        a, b = (classes.select(F.col("nid").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
        return staged(pairs.join(a, "a").join(b, "b").mapInArrow(_near(confirm_distance, percent), "a long, b long"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        sa, sb = (sets.select(F.col("nid").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab")
        return staged(pairs.join(sb, "b").join(sa, "a").mapInArrow(_confirm(percent), "a long, b long"))

    # first each class against the smallest class of its key
    star = shared.where("nid > hub").select(F.col("hub").alias("a"), F.col("nid").alias("b")).distinct()
    links = confirmed(near(star))
    # then the pairs of a key that are still in different components: families tied by signature distance ...
    open_rows = _apart(shared, components(links))
    slim = classes.select("nid", "sig", "n")
    ties = _dealt(_blocked(open_rows, "key", BLOCK).join(slim, "nid"), "key").mapInArrow(
        _tie("key", confirm_distance, percent), "a long, b long")
    family = components(ties).select(F.col("comp").alias("family"), F.col("node").alias("comp"))
    # ... whose members of different components are compared on full sets, block by block
    members = family.join(open_rows.select("nid", "comp").distinct(), "comp")
    met = _dealt(_blocked(members, "family", SET_BLOCK).join(slim, "nid").join(sets, "nid"), "family")
    links = links.unionByName(staged(met.mapInArrow(_link("family", confirm_distance, percent), "a long, b long")))

    label = components(links)
    known = classes.join(label, classes["nid"] == label["node"], "left").select("cls", "rk", "least_id", F.coalesce("comp", "nid").alias("comp"))
    least = known.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.min(F.struct("rk", "cls")).alias("first"))
    of_class = known.join(least, "comp").select("cls", "component_id", F.when(F.col("first.cls") == F.col("cls"), F.col("rk")).alias("keeper"))
    return (read.select("id", "rk", "row", "n", "cls").join(of_class, "cls", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
                    F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"),
                    F.col("row").alias("row_hash"), (F.col("cls").isNull() | F.coalesce(F.col("keeper") == F.col("rk"), F.lit(False))).alias("stays")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows, with their columns, without near duplicates: of each component the row with the smallest id stays (of
    rows with one id that with the smallest set hash, of equal rows one); texts without words all stay."""
    found = minhash_components(docs, **options).where("stays").groupBy(F.col("row_hash").alias("__row")).agg(F.max("n_shingles").alias("__n"))
    one = F.row_number().over(Window.partitionBy("__row").orderBy("__n"))
    return (docs.withColumn("__row", row_hash()).join(found, "__row").withColumn("__k", one)
            .where("__k = 1 or __n = 0").drop("__row", "__n", "__k"))
