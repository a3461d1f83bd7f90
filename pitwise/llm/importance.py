"""Importance resampling towards a target text collection.

Every run of one to three words falls into a bucket by its CRC; the buckets' counts in the documents and in the target
give each bucket a gain, and a document's weight is the sum of its runs' gains, looked up in one array of fixed size.
With a Gumbel draw per document added, the highest scores are a sample without replacement by weight.

The cut-off is found by weighted median selection, without sorting all documents: each round every partition reports
the median of the keys still open and how many they are (batches report theirs to their partition first), the median of
these medians, weighted by those counts, is the pivot; it has at least an eighth of the open keys on either side, so
the side that can't hold the cut-off goes, until the pivot is the cut-off.  Only the winners are then sorted.

Defined results: null and empty texts have no features and weight 0; a null id draws with the hash of "42:"; equal
keys (score and id) at the cut-off are ordered by a hash of the text, and equal rows share out the ranks that are left;
null ids come last among equal scores; an empty target or no documents give gains from the smoothing alone; other
columns are not read."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.operators.ordering import global_row_number

from .common import as_bytes, drop_staged, limit_batches, plain_words, staged

BUCKETS, LONGEST, SEED, SHARE, MIN_WORDS = 10_000, 3, 42, 5, 20
_LAST = (1 << 63) - 1  # stands for a null id in the order of keys


def feature_buckets(text: bytes) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to `LONGEST` consecutive words joined by one space."""
    words = plain_words(text)
    if not words:
        return 0, np.empty(0, np.int64)
    spaced = [b" " + w for w in words[1:]]
    runs = [list(map(zlib.crc32, words))]
    for k in range(1, LONGEST):  # the CRC of a run goes on from that of the run one word shorter
        runs.append(list(map(zlib.crc32, spaced[k - 1:], runs[-1])))
    total = sum(map(len, runs))
    return len(words), np.fromiter(itertools.chain(*runs), np.int64, total) % BUCKETS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for t in b.column("text"):
            total += np.bincount(feature_buckets(t.as_py())[1], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): features per bucket over all texts; every task sends at most `BUCKETS` rows."""
    limit_batches(rows.sparkSession)
    return (rows.select(as_bytes(text_col).alias("text")).mapInArrow(_counts, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket: 1000 times the log of its smoothed share in the target over that in the documents."""
    have, want = ({r["bucket"]: r["n"] for r in bucket_counts(x).collect()} for x in (docs, target))
    s_all, t_all = sum(have.values()), sum(want.values())
    return np.array([math.floor(1000 * math.log((want.get(b, 0) + 1) * (s_all + BUCKETS) / ((have.get(b, 0) + 1) * (t_all + BUCKETS))))
                     for b in range(BUCKETS)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight and score of every row."""
    limit_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.value
        for b in batches:
            found = np.zeros((3, b.num_rows), np.int64)
            for i, t in enumerate(b.column("text")):
                n, at = feature_buckets(t.as_py())
                found[:, i] = n, len(at), gain[at].sum()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *map(pa.array, found)],
                                             names=["doc_id", "text_hash", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).isNull(), F.col(text_col)).alias("text_hash"), as_bytes(text_col).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, text_hash long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return out.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(u))).cast("long"))


# ---------------------------------------------------------------------------------------------------
# Selection

def _middle(keys: np.ndarray, weights: np.ndarray) -> tuple:
    """The weighted median of `keys` (rows of (-score, id)): the first key with half the weight up to it."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    run = np.cumsum(weights[order])
    return tuple(int(x) for x in keys[order[np.searchsorted(run, (run[-1] + 1) // 2)]])


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, sizes = [], []
    for b in batches:
        if b.num_rows:
            rows = np.stack([b.column("down").to_numpy(), b.column("id").to_numpy()], axis=1)
            keys.append(_middle(rows, np.ones(len(rows), np.int64)))
            sizes.append(len(rows))
    if keys:
        down, key = _middle(np.array(keys), np.array(sizes))
        yield pa.RecordBatch.from_pydict({"down": [down], "id": [key], "n": [sum(sizes)]})


def _until(pivot: tuple, strictly: bool):
    down, key = pivot
    last = F.col("id") < F.lit(key) if strictly else F.col("id") <= F.lit(key)
    return (F.col("down") < F.lit(down)) | ((F.col("down") == F.lit(down)) & last)


def cutoff(keys: DataFrame, k: int) -> tuple:
    """The k-th key, from 1, of `keys` (down, id; both never null) in ascending order.

    Rounds read the staged keys that are open; these are written anew each time they have shrunk to a quarter, so all
    rounds together read a small multiple of the first."""
    table, written, open_keys, left = keys, None, keys, k
    while True:
        medians = open_keys.mapInArrow(_medians, "down long, id long, n long").collect()  # one row per partition
        total = sum(m["n"] for m in medians)
        if written is None:
            written = total
        pivot = _middle(np.array([(m["down"], m["id"]) for m in medians]), np.array([m["n"] for m in medians]))
        before, upto = open_keys.agg(F.count(F.when(_until(pivot, True), 1)), F.count(F.when(_until(pivot, False), 1))).first()
        if before < left <= upto:
            if table is not keys:
                drop_staged(table)
            return pivot
        if left <= before:
            open_keys, total = open_keys.where(_until(pivot, True)), before
        else:
            open_keys, total, left = open_keys.where(~_until(pivot, False)), total - upto, left - upto
        if 4 * total <= written:
            smaller = staged(open_keys.coalesce(max(1, min(open_keys.rdd.getNumPartitions(), total // 100_000))))
            if table is not keys:
                drop_staged(table)
            table, open_keys, written = smaller, smaller, total


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; `share` percent of those with `min_words` words are drawn."""
    scored = staged(weigh(docs, gains(docs, target)).withColumns(
        {"down": -F.col("score"), "id": F.coalesce("doc_id", F.lit(_LAST)), "row": F.monotonically_increasing_id()}))
    # `row`, once written, tells equal rows apart, so that they don't meet in one range when the winners are sorted
    able = F.col("n_words") >= F.lit(min_words)
    k = share * scored.where(able).count() // 100
    if not k:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    first = able & _until(cutoff(scored.where(able).select("down", "id"), k), False)
    ranked = global_row_number(scored.where(first), ["down", "id", "text_hash", "row"], out="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    rest = scored.where(~first).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


#: The same in DuckDB.  CRC-32 byte by byte, over a table made from its polynomial (a fixed value).
ORACLE = """
with crc as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from (select unnest(range(256)) as i)),
texts as (
  select false as wanted, row_number() over () as r, doc_id, coalesce(text, '') as text from documents
  union all select true, row_number() over (), null, coalesce(text, '') from benchmark),
words as (
  select wanted, r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from texts),
word as (select wanted, r, unnest(w) as a, unnest(range(len(w))) as i from words),
runs as (
  select wanted, r, a, a || ' ' || lead(a) over line as b, a || ' ' || lead(a) over line || ' ' || lead(a, 2) over line as c
  from word window line as (partition by wanted, r order by i)),
features as (
  select wanted, r, f, count(*) as n
  from (select wanted, r, a as f from runs union all select wanted, r, b from runs where b is not null
        union all select wanted, r, c from runs where c is not null)
  group by wanted, r, f),
spelled as (select f, hex(encode(f)) as h from (select distinct f from features)),
buckets as (
  select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda j: ('0x' || substr(h, j * 2 + 1, 2))::bigint)),
                            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket
  from spelled, crc),
placed as (select wanted, r, bucket, sum(n)::bigint as n from features join buckets using (f) group by wanted, r, bucket),
sides as (
  select bucket, sum(n) filter (not wanted) as s, sum(n) filter (wanted) as t from placed group by bucket),
gains as (
  select bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (sum(s) over () + 10000))::double
                                 / ((coalesce(s, 0) + 1) * (sum(t) over () + 10000))::double))::bigint as gain
  from sides),
weights as (select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from placed join gains using (bucket) where not wanted group by r),
scored as (
  select d.doc_id, len(d.w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from words d left join weights using (r) where not d.wanted),
ranked as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place,
         count(*) filter (n_words >= 20) over () as able
  from scored)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score,
       case when n_words >= 20 and place <= 5 * able // 100 then place end::bigint as rank
from ranked
"""
