"""Repeated passages across documents by level-wise doubling.

A passage of `window` words that occurs twice contains shorter passages that occur twice.  So the search starts with
runs of `base` words, drops every window none of whose runs repeats, doubles the length, and goes on with the windows
that are left until the length is `window` or no candidate survives.  At the short lengths a window is represented by
one run: the one with the smallest hash among the runs inside it.  Equal windows pick equal runs at equal offsets, so
a window whose run doesn't repeat can't repeat itself; neighbouring windows share their run, so few rows are shuffled.
At the full length every surviving window is compared by a 128-bit hash of its word sequence.

An exact copy of an earlier text is wholly covered, so it isn't searched at all.  The texts are shuffled once, into a
table bucketed by row key, which every level and the last step scan.

Rows are keyed by `row_key` (the id; for null ids a value at the top of the long range, so they count as last) and a
copy number (by text) among rows with one id.  A frequent run is counted with partial aggregation and joined as an
equi-join that Spark can split; nothing is collected per run.

Defined results: null or empty texts have no words; texts shorter than the window keep every word; of repeated rows
(equal id) the one with the smaller text counts as earlier, and of fully equal rows one keeps its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _U, as_bytes, bucketed, drop_staged, gram_hashes, limit_batches, longs, pair_hash, row_key, staged, word_hashes

WINDOW = 20
BASE = 5
#: Runs of one Arrow batch on its way from a Python worker.
LOT = 1 << 17
#: Turns the word hashes into those of a second, independent window hash.
_SECOND = _U(0x5851F42D4C957F2D)


def level_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of all runs of `length` words (`base` doubled some times), each from the two halves' hashes."""
    h, at = gram_hashes(words, base), base
    while at < length:
        h = pair_hash(h[: len(h) - at], h[at:]) if len(h) > at else np.empty(0, _U)
        at *= 2
    return h


def representatives(h: np.ndarray, per_window: int) -> np.ndarray:
    """For each window of `per_window` consecutive runs the position of its smallest hash (the first of equals)."""
    out = np.empty(max(0, len(h) - per_window + 1), np.int64)
    for at in range(0, len(out), 65536):
        part = h[at : at + 65536 + per_window - 1]
        out[at : at + 65536] = sliding_window_view(part, per_window).argmin(axis=1) + np.arange(at, at + len(part) - per_window + 1)
    return out


#: A place is one long: copy number, level and position.
_COPY, _LEVEL = 40, 32


def _mine(found: np.ndarray | None, copy: int, level: int) -> np.ndarray:
    """Positions of one row at one level."""
    if found is None or not len(found):
        return np.empty(0, np.int64)
    return found[(found >> _LEVEL) == (copy << (_COPY - _LEVEL)) + level] & ((1 << _LEVEL) - 1)


def _places(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    if "places" not in batch.schema.names:
        return [None] * batch.num_rows
    col = batch.column("places")
    return [x.values.to_numpy() if x.is_valid else None for x in col]


def _emit(level: int, lengths: list[int], window: int):
    """Runs of ``lengths[level]`` words to compare: (h, rk, place); at the full length also a second hash and
    `later`, true where the same row, or an earlier row with the same id, holds the window before."""
    length, base, last = lengths[level], lengths[0], lengths[level] >= window
    names = ["h", "rk", "place", *(["h2", "later"] if last else [])]

    def lots(found: list[list[pa.Array]]) -> Iterator[pa.RecordBatch]:
        out = pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found)], names=names)
        found.clear()
        for at in range(0, out.num_rows, LOT):
            yield out.slice(at, LOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rk_seen, seen = None, []
        for batch in batches:
            out, held = [], 0
            rows = zip(*(batch.column(c).to_pylist() for c in ("rk", "copy", "text")), _places(batch))
            for rk, copy, text, found in rows:
                words = word_hashes(text)
                n = len(words) - window + 1
                if n <= 0:
                    continue
                alive = np.ones(n, bool)
                for done, size in enumerate(lengths[:level]):
                    repeats = np.zeros(len(words), bool)
                    repeats[_mine(found, copy, done)] = True
                    alive &= repeats[representatives(level_hashes(words, size, base), window - size + 1)]
                if not alive.any():
                    continue
                h = level_hashes(words, length, base)
                at = np.flatnonzero(alive) if last else np.unique(representatives(h, window - length + 1)[alive])
                h = h[at]
                arrays = [longs(h), pa.array(np.full(len(at), rk, np.int64)), pa.array((copy << _COPY) + (level << _LEVEL) + at)]
                if last:
                    if rk != rk_seen:
                        rk_seen, seen = rk, []
                    later = np.ones(len(at), bool)
                    later[np.unique(h, return_index=True)[1]] = False
                    if copy > 1 and seen:
                        later |= np.isin(h, np.concatenate(seen))
                    seen.append(h)
                    arrays += [longs(level_hashes(words ^ _SECOND, length, base)[at]), pa.array(later)]
                out.append(arrays)
                held += len(at)
                if held >= LOT:  # bounded memory, whatever the batch holds
                    yield from lots(out)
                    held = 0
            if out:
                yield from lots(out)
    return run


def _cut(level: int, window: int):
    """Words, removed words and the hash of what stays, for each row."""
    def run(batches):
        for batch in batches:
            n_words, n_removed, digest, kept_text = [], [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("copy", "text", "copied")), _places(batch))
            for copy, text, copied, found in rows:
                words = text.split()
                kept = words
                if copied:  # an exact copy of an earlier text: all its windows start earlier
                    kept = words if len(words) < window else []
                elif len(mine := _mine(found, copy, level)):
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, mine, 1)
                    np.add.at(edge, mine + window, -1)
                    kept = [w for w, covered in zip(words, np.cumsum(edge).tolist()) if not covered]
                kept_text.append(b" ".join(kept))
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(kept_text[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(kept_text, pa.binary())],
                names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows as a table bucketed by key: rk, copy (by text, among rows with one id), id, text, and copied, true
    for an exact copy of the text of an earlier row."""
    rows = docs.select(row_key(id_col, text_col).alias("rk"), F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text"))
    digests = rows.select("rk", F.md5("text").alias("digest"))
    first = digests.groupBy("digest").agg(F.min("rk").alias("first_rk"), F.max("rk").alias("last_rk")).where("first_rk < last_rk")
    copies = (digests.join(first, "digest").where("rk > first_rk")
              .groupBy("rk").agg(F.collect_set("digest").alias("digests")))
    same_id = Window.partitionBy("rk").orderBy("text")
    keyed = (rows.join(copies, "rk", "left").withColumn("copy", F.row_number().over(same_id))
             .withColumn("copied", F.coalesce(F.array_contains("digests", F.md5("text")), F.lit(False))
                         | F.coalesce(F.lag("text").over(same_id) == F.col("text"), F.lit(False))))
    return bucketed(keyed.select("rk", "copy", "id", "text", "copied"), "rk", "copy")


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                           base: int = BASE) -> DataFrame:
    """Remove every word that a window of `window` words covers whose word sequence also starts earlier (in a row
    with a smaller id, or earlier in the same row).  `window` is `base` times a power of two.  One row per input
    row: id, n_words, n_removed, kept_sha256 and kept_text (UTF-8, the kept words joined by one space)."""
    lengths = [base]
    while lengths[-1] < window:
        lengths.append(lengths[-1] * 2)
    if lengths[-1] != window:
        raise ValueError("window must be base times a power of two")
    limit_batches(docs.sparkSession)
    keyed = keyed_texts(docs, id_col, text_col)
    searched = keyed.where("not copied").select("rk", "copy", "text")

    places = None
    for level, length in enumerate(lengths):
        source = searched if places is None else searched.join(
            places.groupBy("rk").agg(F.collect_list("place").alias("places")), "rk")
        if length < window:
            rows = staged(source.mapInArrow(_emit(level, lengths, window), "h long, rk long, place long"))
            twice = rows.groupBy("h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("h")
            found = staged(rows.join(twice, "h").select("rk", "place"))
            places = found if places is None else places.unionByName(found)
        else:
            rows = staged(source.sortWithinPartitions("rk", "copy").mapInArrow(
                _emit(level, lengths, window), "h long, rk long, place long, h2 long, later boolean"))
            first = (rows.groupBy("h", "h2").agg(F.min("rk").alias("first_rk"), F.max("rk").alias("last_rk"),
                                                 F.max("later").alias("__l")).where("first_rk < last_rk or __l").drop("last_rk", "__l"))
            found = staged(rows.join(first, ["h", "h2"]).where("rk > first_rk or later").select("rk", "place"))
        drop_staged(rows)

    gone = found.groupBy("rk").agg(F.collect_list("place").alias("places"))
    return (keyed.join(gone, "rk", "left")
            .mapInArrow(_cut(len(lengths) - 1, window),
                        "id long, n_words long, n_removed long, kept_sha256 string, kept_text binary")
            .withColumnRenamed("id", id_col))
