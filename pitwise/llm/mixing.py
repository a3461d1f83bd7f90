"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target number of words: its weight's share of all words, at most `MAX_REPEAT` times its own size,
what is above shared anew by weight.  A document is taken floor(target / size) times for sure and once more with
the fraction left as inclusion probability.  The cube method decides the fractions: in the flight phase probabilities
move along the null space of the balancing constraints (document total, word total) until they reach 0 or 1, so both
totals stay at their expected values.  Flights run in blocks of at most about `BLOCK` documents of one source; each leaves at
most two fractions, which meet in the blocks of the next round, until one block per source is left.  It
leaves a landing problem of at most ten documents, solved by trying all choices for the nearest word total.

Directions are drawn from a hash of source, round and block, and documents are ordered by a hash of their id, so reruns
agree.  A hot source is many blocks.  Only the per-source table (one row a source) passes through one task.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of its own, last in order;
null ids are keyed by their text's hash; repeated rows are sampled one by one; an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import group_bounds, n_parts, row_hash, row_key, segments, staged

#: Weights of the sources in order, repeating (a parameter of the registered query).
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK = 1000
#: Documents of a source's last block that wait for the landing problem (besides at most two left by the flight).
LANDING = 8
_SURE = 1e-9


def flight(pi: list[float], sizes: list[float], rng: random.Random) -> list[float]:
    """Move probabilities to 0 or 1 with sum(pi) and sum(pi * size) unchanged; at most two stay fractional."""
    pi = list(pi)
    open_: list[int] = []
    for i in range(len(pi)):
        if not _SURE < pi[i] < 1 - _SURE:
            pi[i] = round(pi[i])
            continue
        open_.append(i)
        if len(open_) == 3:
            a, b, c = open_
            u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])  # orthogonal to (1, 1, 1) and the sizes
            _move(pi, open_, u if any(u) else (1.0, -1.0, 0.0), rng)
            open_ = [k for k in open_ if _SURE < pi[k] < 1 - _SURE]
    return pi


def _move(pi: list[float], units: list[int], u, rng: random.Random) -> None:
    """One martingale step along u: as far as the cube allows to either side, with mean zero."""
    up = min((1 - pi[k]) / d if d > 0 else -pi[k] / d for k, d in zip(units, u) if d)
    down = min(pi[k] / d if d > 0 else (pi[k] - 1) / d for k, d in zip(units, u) if d)
    step = up if rng.random() * (up + down) < down else -down
    for k, d in zip(units, u):
        pi[k] += step * d
        if pi[k] < _SURE or pi[k] > 1 - _SURE:
            pi[k] = float(round(pi[k]))


def landing(pi: list[float], sizes: list[float]) -> list[float]:
    """Decide the few fractions left: of all choices the one whose word total is nearest to the expected one, with
    the document total at most one off where that is possible."""
    pi = list(pi)
    left = [k for k, p in enumerate(pi) if _SURE < p < 1 - _SURE]
    if left:
        take = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        off = take - np.array([pi[k] for k in left])
        words, docs = np.abs(off @ np.array([sizes[k] for k in left])), np.abs(off.sum(1))
        for k, t in zip(left, take[np.lexsort((words, docs > 1))[0]]):
            pi[k] = float(t)
    return pi


_KEYS = ["sno", "block"]


def _fly(turn: int, land: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in segments(batches, _KEYS):
            pi, sizes = t["pi"].to_numpy().tolist(), t["size"].to_numpy().astype(float).tolist()
            sno, block = t["sno"].to_numpy(), t["block"].to_numpy()
            bounds, out = group_bounds(t, _KEYS), []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                rng = random.Random(f"{sno[lo]}:{turn}:{block[lo]}")
                fly_to = max(lo, hi - LANDING) if land else hi
                part = flight(pi[lo:fly_to], sizes[lo:fly_to], rng) + pi[fly_to:hi]
                out += landing(part, sizes[lo:hi]) if land else part
            at = t.schema.get_field_index("pi")
            yield from t.set_column(at, "pi", pa.array(out, pa.float64())).to_batches()
    return run


def sizes_of(docs: DataFrame, text_col: str = "text"):
    """Number of words (runs without ASCII white space) of each text."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, sno, n_docs, source_size, target), one row per source.

    With sources by rising cap per weight, the share per weight if the first k - 1 are capped is
    (total - their caps) / (weights left); the final share is the largest of these, each target at most its cap."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sno", F.row_number().over(order) - 1)
    per = per.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("sno") % len(weights) + 1))
    per = per.withColumn("cap", F.col("source_size") * float(max_repeat))
    rising = Window.orderBy(F.col("cap") / F.col("w"), "sno")
    everything = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("share", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                         / F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    share = F.max("share").over(everything)
    return per.select("source", "sno", "n_docs", "source_size", F.least(F.col("cap"), F.col("w") * share).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, row_hash, size, source_size, target, copies (how often it is taken) and taken
    (words, repeats counted)."""
    spark = docs.sparkSession
    sized = staged(docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"), row_hash(id_col, text_col).alias("row_hash"),
                               F.col(source_col).alias("source"), sizes_of(docs, text_col).alias("size")))
    targets = source_targets(sized, weights, max_repeat)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + _SURE)
    targets = staged(targets.withColumn("whole", whole).withColumn("pi", F.greatest(ratio - whole, F.lit(0.0))))
    units = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(
        "id", "rk", "row_hash", "size", "sno", "source_size", "target", "whole", "pi")

    done, turn = None, 0
    counts = targets.select("sno", F.col("n_docs").alias("__n"))
    while True:
        land = counts.agg(F.max("__n")).first()[0] or 0
        land = land <= block
        slices = F.ceil(F.col("__n") / F.lit(block))
        dealt = units.join(counts, "sno").withColumn("block", F.pmod(F.xxhash64("rk", "size", F.lit(turn)), slices)).drop("__n")
        flown = staged(dealt.repartition(n_parts(spark), *_KEYS).sortWithinPartitions(*_KEYS, F.xxhash64("rk"), "rk", "size")
                       .mapInArrow(_fly(turn, land), dealt.schema).drop("block"))
        if land:
            done = flown if done is None else done.unionByName(flown)
            break
        settled = flown.where((F.col("pi") == 0) | (F.col("pi") == 1))
        done = settled if done is None else done.unionByName(settled)
        units = flown.where((F.col("pi") > 0) & (F.col("pi") < 1))
        counts = units.groupBy("sno").agg(F.count(F.lit(1)).alias("__n"))
        turn += 1
    copies = (F.col("whole") + F.col("pi")).cast("long")
    return done.select(F.col("id").alias(id_col), "row_hash", "size", "source_size", "target", copies.alias("copies"),
                       (F.col("size") * copies).alias("taken"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows that the mix takes, with their columns and copies (how often), size, source_size, target and taken;
    fully equal rows come once, their copies added."""
    mix = (mix_sources(docs, **options).where("copies > 0").groupBy(F.col("row_hash").alias("__row"))
           .agg(F.sum("copies").alias("copies"), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
                F.first("target").alias("target"), F.sum("taken").alias("taken")))
    added = ["copies", "size", "source_size", "target", "taken"]
    one = F.row_number().over(Window.partitionBy("__row").orderBy(F.lit(0)))
    return (docs.drop(*added).withColumn("__row", row_hash()).withColumn("__k", one).where("__k = 1").drop("__k")
            .join(mix, "__row").drop("__row"))
