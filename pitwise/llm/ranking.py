"""Ranked lexical search: the best documents for each item, with exact integer scores.

A document is a vector of term impacts, an item a vector of term weights, the score their product.  Documents are put in
order of the length of their vector and taken in buckets of like length.  By Cauchy-Schwarz no document of a bucket beats
an item's threshold (its k-th best score so far) if the longest vector times the item's length stays below it: such
buckets are skipped.  Inside a bucket the item's heaviest coordinates are taken until the rest of the item is too short to
reach the threshold by itself; only documents that hold one of these coordinates remain, and of these only those whose
part over these coordinates plus the bound on the rest reaches the threshold.  The survivors are scored in integers.

Lengths are weighted: the product is split as sqrt(weight) and sqrt(weight) * impact.  Items come in blocks of
bounded size, each of which meets all documents in two waves: the longest sixteenth first, whose thresholds
hold for the rest.  Documents keep only terms that a bitmap of fixed size admits (those of items and some others, which no
item asks for); terms are told apart by 64-bit hashes.

Defined results: null and empty texts have no terms and are neither found nor counted; null ids come last among equal
scores; an item is a distinct pair of id and text (null id included), and gets no rows where nothing scores above 0;
repeated rows of documents are found each; no documents or no items give an empty table; other columns are not read."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwise.operators.ordering import global_prefix_sum

from .common import as_bytes, drop_staged, limit_batches, lists, longs, n_parts, plain_words, staged

TOP = 10
SLOTS = 1 << 20  #: of the bitmap of the items' terms and of the table of their largest weights
BLOCK_TERMS = 1 << 17  #: terms of the items of one block (an item is never cut)
FIRST_WAVE = 15 / 16  #: quantile of the lengths above which the first wave lies
SLACK = 1 + 1e-9  #: on bounds in floating point, far above their rounding
_LAST = (1 << 63) - 1  # stands for a null id in the order of ids


def _vectors(admitted):
    """Arrow function: the terms of each text, their hashes and counts; with a bitmap, only the terms that it admits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = admitted.value if admitted is not None else None
        for b in batches:
            n, sizes, terms, counts = [], [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for t in b.column("text"):
                words = Counter(plain_words(t.as_py()))
                n.append(words.total())
                h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                tf = np.fromiter(words.values(), np.int64, len(words))
                if bitmap is not None:
                    keep = bitmap[h & np.uint64(SLOTS - 1)]
                    h, tf = h[keep], tf[keep]
                terms.append(h)
                counts.append(tf)
                sizes.append(len(h))
            flat, tfs = np.concatenate(terms), np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), lists(flat.view(np.int64), sizes), lists(tfs, sizes)],
                                             names=["id", "n", "terms", "tfs"])
    return run


_VECTOR = "id long, n long, terms array<long>, tfs array<long>"


def _slot():
    return F.col("term").bitwiseAND(F.lit(SLOTS - 1))


def item_vectors(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """at, id, terms of every distinct item with a term; `at` is its place in the list of all items' terms, so unique."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text")).distinct()
    found = rows.mapInArrow(_vectors(None), _VECTOR).where("n > 0").select("id", "terms", F.size("terms").alias("size"))
    found = found.withColumn("digest", F.xxhash64("terms"))
    return staged(global_prefix_sum(staged(found), ["id", "digest"], "size", out="at").select("at", "id", "terms"))


def weigh_items(items: DataFrame, vectors: DataFrame, n_docs: int) -> DataFrame:
    """at, block, terms, weights of every item (heaviest first, weights of 0 left out): rarer terms weigh more."""
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    known = items.select(F.explode("terms").alias("term")).distinct().join(df, "term").select("term", weight.alias("w")).where("w > 0")
    pairs = items.select("at", F.explode("terms").alias("term")).join(known, "term")
    ordered = F.sort_array(F.collect_list(F.struct("w", "term")), asc=False)
    return staged(pairs.groupBy("at").agg(ordered.alias("p"))
                  .select("at", F.floor(F.col("at") / F.lit(BLOCK_TERMS)).alias("block"), F.col("p.term").alias("terms"), F.col("p.w").alias("weights")))


def impacts(vectors: DataFrame, top_weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """id, row, length, terms, impacts in descending order of length, over range partitions.

    The length takes for each term the largest weight of its slot, so it bounds the true one from above."""
    shipped = vectors.sparkSession.sparkContext.broadcast(top_weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shipped.value
        for b in batches:
            terms, tfs = b.column("terms"), b.column("tfs")
            sizes = np.diff(terms.offsets.to_numpy())
            flat, tf = terms.flatten(), tfs.flatten().to_numpy()
            slow = np.array([10 + 90 * n * n_docs // n_terms for n in b.column("n").to_pylist()], np.int64)
            x = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(slow, sizes))
            parts = heavy[flat.to_numpy() & (SLOTS - 1)] * x.astype(float) ** 2
            length = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), parts, len(sizes)))
            out = pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array(length), lists(flat.to_numpy(), sizes), lists(x, sizes)],
                                             names=["id", "row", "length", "terms", "impacts"])
            yield out.filter(pa.array(length > 0))

    found = vectors.mapInArrow(run, "id long, row long, length double, terms array<long>, impacts array<long>")
    by_length = [F.col("length").desc(), F.col("row")]
    return found.repartitionByRange(n_parts(vectors.sparkSession), *by_length).sortWithinPartitions(*by_length)


# ---------------------------------------------------------------------------------------------------
# Search of one block of items

class Item(NamedTuple):
    at: int
    terms: np.ndarray  # places in the block's vocabulary, heaviest first
    weights: np.ndarray
    rest: np.ndarray  # rest[j]: length of the item without its j heaviest coordinates


class Block(NamedTuple):
    vocabulary: np.ndarray  # sorted term hashes
    items: list[Item]
    least: dict[int, int]  # at -> threshold from documents seen before


def make_block(rows: list, least: dict[int, int]) -> Block:
    vocabulary = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in rows]))
    items = []
    for r in rows:
        w = np.array(r["weights"], np.int64)
        rest = np.sqrt(np.append(np.cumsum(w[::-1])[::-1], 0).astype(float))
        items.append(Item(r["at"], np.searchsorted(vocabulary, np.array(r["terms"], np.int64)), w, rest))
    return Block(vocabulary, items, least)


class Bucket:
    """Documents of like length with their postings by term."""

    def __init__(self, b: pa.RecordBatch, vocabulary: np.ndarray):
        self.ids = b.column("id").to_numpy()
        self.length = b.column("length").to_numpy()
        terms = b.column("terms").flatten().to_numpy()
        sizes = np.diff(b.column("terms").offsets.to_numpy())
        place = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        known = np.flatnonzero(vocabulary[place] == terms)
        known = known[np.argsort(place[known], kind="stable")]
        self.docs = np.repeat(np.arange(len(sizes)), sizes)[known]
        self.x = b.column("impacts").flatten().to_numpy()[known]
        self.start = np.searchsorted(place[known], np.arange(len(vocabulary) + 1))

    def postings(self, term: int) -> slice:
        return slice(self.start[term], self.start[term + 1])


def search_bucket(bucket: Bucket, item: Item, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the bucket with at least `least` > 0 points for the item."""
    longest = bucket.length[0]
    if item.rest[0] * longest * SLACK < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    focus = int(np.argmax(item.rest * longest * SLACK < least))  # rest ends with 0, so one is found
    held = [bucket.postings(t) for t in item.terms[:focus]]
    docs = np.concatenate([bucket.docs[s] for s in held])
    if not len(docs):
        return docs, docs
    w = np.repeat(item.weights[:focus], [s.stop - s.start for s in held])
    x = np.concatenate([bucket.x[s] for s in held])
    order = np.argsort(docs, kind="stable")
    docs, part, square = docs[order], (w * x)[order], (w * x.astype(float) ** 2)[order]
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    docs, part, square = docs[first], np.add.reduceat(part, first), np.add.reduceat(square, first)
    beyond = item.rest[focus] * np.sqrt(np.maximum(bucket.length[docs] ** 2 * SLACK - square, 0))
    alive = (part + beyond) * SLACK >= least
    docs, score = docs[alive], part[alive]
    for t, weight in zip(item.terms[focus:], item.weights[focus:]):
        s = bucket.postings(t)
        mine = bucket.docs[s]
        if len(mine) and len(docs):
            at = np.minimum(np.searchsorted(mine, docs), len(mine) - 1)
            score += np.where(mine[at] == docs, weight * bucket.x[s][at], 0)
    alive = score >= least
    return docs[alive], score[alive]


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, items, least = block.value
        best = {i.at: (np.empty(0, np.int64), np.empty(0, np.int64)) for i in items}
        least = {i.at: max(least.get(i.at, 0), 1) for i in items}
        for b in batches:
            if not b.num_rows:
                continue
            bucket = Bucket(b, vocabulary)
            for item in items:
                docs, score = search_bucket(bucket, item, least[item.at])
                if not len(docs):
                    continue
                ids, points = (np.concatenate(p) for p in zip(best[item.at], (bucket.ids[docs], score)))
                order = np.lexsort((ids, -points))[:k]
                best[item.at] = ids[order], points[order]
                if len(order) == k:
                    least[item.at] = max(least[item.at], int(points[order[-1]]))
        sizes = [len(best[i.at][0]) for i in items]
        ids, points = (np.concatenate([best[i.at][c] for i in items]) for c in (0, 1))
        yield pa.RecordBatch.from_arrays([longs(np.repeat(np.array([i.at for i in items], np.int64), sizes)), longs(ids), longs(points)],
                                         names=["at", "id", "score"])
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank; first among a part of the tasks' rows, so that no item's rows meet whole."""
    best_first = [F.col("score").desc(), F.col("id")]
    part = Window.partitionBy("at", "part").orderBy(*best_first)
    x = found.withColumn("part", F.spark_partition_id() % 64).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(*best_first))).where(F.col("rank") <= k).drop("part")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    limit_batches(spark)
    asked = item_vectors(items, item_id_col, item_text_col)
    bitmap = np.zeros(SLOTS, bool)
    bitmap[[r[0] for r in asked.select(F.explode("terms").alias("term")).select(_slot()).distinct().collect()]] = True  # at most SLOTS rows
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), as_bytes(text_col).alias("text"))
    vectors = staged(rows.mapInArrow(_vectors(spark.sparkContext.broadcast(bitmap)), _VECTOR).withColumn("row", F.monotonically_increasing_id()))
    n_docs, n_terms = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weighed = weigh_items(asked, vectors, n_docs)
    heavy = np.zeros(SLOTS)
    pairs = weighed.select(F.explode(F.arrays_zip("terms", "weights")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.weights").alias("w"))
    for r in pairs.groupBy(_slot().alias("slot")).agg(F.max("w").alias("w")).collect():  # at most SLOTS rows
        heavy[r["slot"]] = r["w"]
    documents = staged(impacts(vectors.where(F.size("terms") > 0), heavy, n_docs, n_terms))
    drop_staged(vectors)
    cut = documents.approxQuantile("length", [FIRST_WAVE], 0.01)
    results = None
    for block in [r["block"] for r in weighed.select("block").distinct().orderBy("block").collect()] if cut else []:
        rows = weighed.where(F.col("block") == block).collect()  # at most BLOCK_TERMS terms and one item

        def wave(part: DataFrame, least: dict[int, int]) -> DataFrame:
            return part.mapInArrow(_search(spark.sparkContext.broadcast(make_block(rows, least)), k), "at long, id long, score long")

        first = staged(_best(wave(documents.where(F.col("length") >= cut[0]), {}), k))
        least = {r["at"]: r["score"] for r in first.where(F.col("rank") == k).collect()}  # one row per item of the block
        both = staged(_best(first.drop("rank").unionByName(wave(documents.where(F.col("length") < cut[0]), least)), k))
        results = both if results is None else results.unionByName(both)
    if results is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    doc_id = F.when(F.col("r.id") != _LAST, F.col("r.id"))
    return (results.alias("r").join(asked.alias("i"), F.col("r.at") == F.col("i.at"))
            .select(F.col("i.id").alias("item_id"), F.col("rank").cast("int").alias("rank"), doc_id.alias("doc_id"), "score"))


#: The same in DuckDB.
ORACLE = """
with d as (
  select row_number() over () as r, doc_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from documents),
tf as (select r, doc_id, term, count(*) as tf from d group by r, doc_id, term),
sizes as (select r, sum(tf)::bigint as n from tf group by r),
whole as (select count(*) as n_docs, sum(n)::bigint as n_terms from sizes),
df as (select term, count(*) as df from tf group by term),
q as (
  select distinct item_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from benchmark),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w from df, whole),
scores as (
  select item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint as score
  from q join w using (term) join tf using (term) join sizes using (r), whole
  group by item_id, r, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
