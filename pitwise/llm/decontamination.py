"""Benchmark decontamination: rare n-gram seeds join training texts to test items, Smith-Waterman scores the passages.

Words are lower-cased runs of letters and digits.  Every run of `SEED` words of an item is a possible seed; a
bitmap of fixed size over the seeds' hashes (two bits each) goes to all tasks and thins out the texts' runs, whatever
the size of the benchmark.  A seed is rare if at most `RARE_ITEMS` items hold it: each text that holds it, however many there
are, meets few items, in an equi-join.  A seed that more items hold (a common opening) would pair all its texts with all its items, so it
is made rare by a word: an alignment that reaches the threshold t matches at least t of the item's n words, hence one of
any n - ceil(t n) + 1 of them.  The item pairs the seed with so many of its words, those that the fewest items hold first, a text with the
words near the seed, and both meet on (seed, word).  No pair that shares a seed and can reach the threshold is left out, and
a second bitmap keeps the texts' pairs few.  Each pair found is aligned once, around all the seeds that it shares: local alignment with
match, mismatch and gap scores, so edited and paraphrased copies align as well.  The score is the alignment's share of the
item's perfect score.  A text travels to the aligner once for about `ITEMS_A_ROW` of its items.

Defined results: null or empty texts and items match nothing; items shorter than a seed use all their words as one
seed; repeated rows of the texts are matched one by one; an item is a distinct pair of id and text, so each text of a
repeated id is looked for, a repeated row of the benchmark counts once, and an item with a null id is looked for like the
others; an empty benchmark gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, gram_hashes, lists, pair_hash, row_hash, staged

SEED = 4
RARE_ITEMS = 8
ITEMS_A_ROW = 64
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
BITMAP_BITS = 24
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hashes_of(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), _U, len(words))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items to (ik, item_id, words, seeds)."""
    for batch in batches:
        keys, ids, words, seeds = [], [], [], []
        for key, item, text in zip(*(batch.column(c).to_pylist() for c in ("ik", "item_id", "text"))):
            w = hashes_of(words_of(text or ""))
            if len(w):
                keys.append(key)
                ids.append(item)
                words.append(w)
                seeds.append(gram_hashes(w, min(SEED, len(w))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), lists(_flat(words), [len(w) for w in words]),
             lists(_flat(seeds), [len(s) for s in seeds])],
            names=["ik", "item_id", "item_words", "seeds"])


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return (np.concatenate(parts) if parts else np.empty(0, _U)).view(np.int64)


def bitmap_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = _U((1 << BITMAP_BITS) - 1)
    return (h & mask).astype(np.int64), ((h >> _U(32)) & mask).astype(np.int64)


def hash_bitmap(hashes: DataFrame, col: str) -> np.ndarray:
    """Bitmap over a column of hashes (2 ** BITMAP_BITS bits whatever their number)."""
    mask = (1 << BITMAP_BITS) - 1
    places = hashes.select(F.explode(F.array(F.col(col).bitwiseAND(F.lit(mask)),
                                             F.shiftright(col, 32).bitwiseAND(F.lit(mask)))).alias("p"))
    bit = F.expr("shiftleft(cast(1 as bigint), cast(p % 64 as int))")
    cells = places.groupBy(F.floor(F.col("p") / 64).alias("cell")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bits = np.zeros((1 << BITMAP_BITS) // 64, np.int64)
    bits[cells["cell"].to_numpy().astype(np.int64)] = cells["bits"].to_numpy()
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    x, y = bitmap_places(h)
    return bitmap[x] & bitmap[y]


def _text_seeds(shared):
    """Texts with at least one run in the bitmap: (rk, id, words, seeds, pos)."""
    def run(batches):
        bitmap, lengths = shared.value
        for batch in batches:
            rks, ids, words, seeds, pos = [], [], [], [], []
            for rk, i, text in zip(*(batch.column(c).to_pylist() for c in ("rk", "id", "text"))):
                w = hashes_of(words_of(text or ""))
                hits, places = [], []
                for n in lengths:
                    h = gram_hashes(w, n)
                    at = np.flatnonzero(in_bitmap(bitmap, h))
                    hits.append(h[at])
                    places.append(at)
                found = np.concatenate(hits) if hits else np.empty(0, _U)
                if len(found):
                    rks.append(rk)
                    ids.append(i)
                    words.append(w)
                    seeds.append(found)
                    pos.append(np.concatenate(places).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rks, pa.int64()), pa.array(ids, pa.int64()), lists(_flat(words), [len(x) for x in words]),
                 lists(_flat(seeds), [len(x) for x in seeds]),
                 lists(np.concatenate(pos) if pos else np.empty(0, np.int64), [len(x) for x in pos])],
                names=["rk", "id", "words", "seeds", "pos"])
    return run


def reach_of(n: int) -> int:
    """How far from a seed the alignment of an item of `n` words is looked for."""
    return n + n // 2 + SEED


def size_class(n: int) -> int:
    """The least power of two, as its exponent, that holds `n` words."""
    return (n - 1).bit_length()


def pair_key(seed: np.ndarray, word: np.ndarray, exponent: int) -> np.ndarray:
    """Hash of a common seed and a word of an item of a size class; word 0 stands for the seed alone."""
    return pair_hash(pair_hash(seed, word), np.full(len(word), exponent, _U))


def rarest_words(words: np.ndarray, holders: dict[int, int], threshold: float) -> np.ndarray:
    """Distinct words, those with the fewest holders first, that cover so many places of an item that any `threshold` of
    its places holds one of them."""
    need = len(words) - math.ceil(threshold * len(words) - 1e-9) + 1
    distinct, count = np.unique(words, return_counts=True)
    order = np.lexsort((distinct, [holders[w] for w in distinct.view(np.int64).tolist()]))
    return distinct[order[:int(np.searchsorted(np.cumsum(count[order]), need)) + 1]]


def _item_keys(threshold: float):
    """Items (ik, item_words, common, words, holders) to (ik, exponent, key) of their common seeds with their rarest words, and with word 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                item, common, words, counts = (batch.column(c)[i].values.to_numpy() for c in ("item_words", "common", "words", "holders"))
                rare = rarest_words(item.view(_U), dict(zip(words.tolist(), counts.tolist())), threshold)
                exponent = size_class(len(item))
                keys = _flat([pair_key(np.full(len(rare) + 1, seed, _U), np.append(rare, _U(0)), exponent) for seed in common.view(_U)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), x, np.int64)) for x in (batch.column("ik")[i].as_py(), exponent)] + [pa.array(keys)],
                    names=["ik", "exponent", "key"])
    return run


def near_words(words: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """Distinct words within `reach` of the rising places `at`."""
    gaps = np.flatnonzero(np.diff(at) > 2 * reach)
    starts, ends = at[np.append(0, gaps + 1)] - reach, at[np.append(gaps, len(at) - 1)] + reach
    return np.unique(np.concatenate([words[max(0, lo):hi] for lo, hi in zip(starts.tolist(), ends.tolist())]))


def _text_keys(shared):
    """Texts with their seeds to (rk, key) of the common seeds with the words near them that are in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, exponents = shared.value
        for batch in batches:
            rks, keys = [], []
            for i in range(batch.num_rows):
                words, seeds, pos = (batch.column(c)[i].values.to_numpy() for c in ("words", "seeds", "pos"))
                order = np.lexsort((pos, seeds))
                distinct, first = np.unique(seeds.view(np.int64)[order], return_index=True)
                distinct, places = distinct.view(_U), np.split(pos[order], first[1:])
                for exponent in exponents:
                    common = in_bitmap(bitmap, pair_key(distinct, np.zeros(len(distinct), _U), exponent))
                    for k in np.flatnonzero(common).tolist():
                        near = near_words(words.view(_U), places[k], reach_of(1 << exponent))
                        key = pair_key(np.full(len(near), distinct[k], _U), near, exponent)
                        key = key[in_bitmap(bitmap, key)]
                        keys.append(key)
                        rks.append(np.full(len(key), batch.column("rk")[i].as_py(), np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rks)), pa.array(_flat(keys))], names=["rk", "key"])
    return run


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Smith-Waterman score of two word sequences, and the end of the best local alignment in `text`.

    One row of the matrix at a time; gaps along the row become a running maximum of score minus gap slope."""
    slope = GAP * np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1)
    best, end = 0.0, 0
    for w in item:
        new = np.zeros(len(text) + 1)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(text == w, MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.maximum.accumulate(new - slope) + slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


def best_alignment(item: np.ndarray, text: np.ndarray, hits: np.ndarray, threshold: float = 0.0) -> tuple[float, int]:
    """Best alignment over the stretches of `text` that lie within an item's length (and some gaps) of a seed.

    Stretches that hold too few of the item's words to reach the threshold, or to beat the best so far, are not aligned."""
    reach = reach_of(len(item))
    best, end = 0.0, 0
    spans: list[list[int]] = []
    for p in np.unique(hits).tolist():
        lo, hi = max(0, p - reach), min(len(text), p + reach)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    for lo, hi in spans:
        most = MATCH * int(np.isin(item, text[lo:hi]).sum())  # no alignment there scores more
        if most / (MATCH * len(item)) < threshold or most <= best:
            continue
        score, at = align(item, text[lo:hi])
        if score > best:
            best, end = score, lo + at
    return best, end


def _score(threshold: float):
    """Texts with some of their items to (rk, ik, score, end_word) of the pairs that reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                words, seeds, pos = (batch.column(c)[i].values.to_numpy() for c in ("words", "seeds", "pos"))
                found = batch.column("found")[i].values
                iks, items, held = (found.field(c) for c in ("ik", "item_words", "seeds"))
                for j in range(len(found)):
                    item = items[j].values.to_numpy()
                    score, end = best_alignment(item, words, pos[np.isin(seeds, held[j].values.to_numpy())], threshold)
                    score /= MATCH * len(item)
                    if score >= threshold:
                        out.append((batch.column("rk")[i].as_py(), iks[j].as_py(), score, end))
            rk, ik, scores, ends = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(rk, pa.int64()), pa.array(ik, pa.int64()), pa.array(scores, pa.float64()),
                                              pa.array(ends, pa.int64())], names=["rk", "ik", "score", "end_word"])
    return run


def candidates(items: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (rk, ik) that share a rare seed, or a common seed with one of the item's rarest words near it."""
    spark = items.sparkSession
    seeds = items.select("ik", F.explode(F.array_distinct("seeds")).alias("seed"))
    holders = staged(seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")))
    rare = seeds.join(holders.where(F.col("n") <= RARE_ITEMS), "seed")
    by_seed = (hits.select("rk", F.explode(F.array_distinct("seeds")).alias("seed")).join(rare, "seed").select("rk", "ik"))

    common = (seeds.join(holders.where(F.col("n") > RARE_ITEMS), "seed").groupBy("ik").agg(F.collect_list("seed").alias("common"))
              .join(items.select("ik", "item_words"), "ik"))
    each = common.select("ik", F.explode(F.array_distinct("item_words")).alias("word"))
    counted = each.join(each.groupBy("word").agg(F.count(F.lit(1)).alias("holders")), "word")
    counted = counted.groupBy("ik").agg(F.collect_list(F.struct("word", "holders")).alias("w"))
    keys = staged(common.join(counted, "ik").select("ik", "item_words", "common", F.col("w.word").alias("words"), F.col("w.holders").alias("holders"))
                  .mapInArrow(_item_keys(threshold), "ik long, exponent long, key long"))
    exponents = [r[0] for r in keys.select("exponent").distinct().collect()]  # logarithms of item lengths
    if not exponents:
        return by_seed.distinct()
    shared = spark.sparkContext.broadcast((hash_bitmap(keys, "key"), sorted(exponents)))  # 2 ** BITMAP_BITS bits
    near = hits.select("rk", "words", "seeds", "pos").mapInArrow(_text_keys(shared), "rk long, key long")
    return by_seed.unionByName(near.join(keys, "key").select("rk", "ik")).distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per (text, item) whose alignment reaches the threshold, an item being a distinct pair of item_id and text:
    id, rk (row hash), item_id, score (0 to 1) and end_word (where the best alignment ends in the text, in words)."""
    spark = docs.sparkSession
    items = staged(benchmark.select(row_hash("item_id").alias("ik"), F.col("item_id").cast("long").alias("item_id"), "text").distinct()
                   .mapInArrow(_item_seeds, "ik long, item_id long, item_words array<long>, seeds array<long>"))
    lengths = [r[0] for r in items.select(F.least(F.lit(SEED), F.size("item_words"))).distinct().collect()]  # 1 to SEED
    bitmap = hash_bitmap(items.select(F.explode("seeds").alias("seed")), "seed")
    shared = spark.sparkContext.broadcast((bitmap, sorted(lengths)))  # 2 ** BITMAP_BITS bits
    texts = docs.select(row_hash(id_col, text_col).alias("rk"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hits = staged(texts.mapInArrow(_text_seeds(shared), "rk long, id long, words array<long>, seeds array<long>, pos array<long>"))

    blocks = max(1, items.count() // ITEMS_A_ROW)
    found = (candidates(items, hits, threshold).join(items.select("ik", "item_words", "seeds"), "ik")
             .groupBy("rk", F.pmod("ik", F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("ik", "item_words", "seeds")).alias("found")))
    best = (found.select("rk", "found").join(hits.select("rk", "words", "seeds", "pos"), "rk")
            .mapInArrow(_score(threshold), "rk long, ik long, score double, end_word long").distinct())
    named = best.join(items.select("ik", "item_id"), "ik")
    return hits.select("rk", F.col("id").alias(id_col)).join(named, "rk").select("rk", id_col, "item_id", "score", "end_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with their columns, whose text aligns with no benchmark item."""
    leaks = find_leaks(docs, benchmark, threshold).select(F.col("rk").alias("__rk")).distinct()
    return docs.withColumn("__rk", row_hash()).join(leaks, "__rk", "left_anti").drop("__rk")
