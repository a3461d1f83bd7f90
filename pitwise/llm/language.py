"""Language identification by multilingual mixture inference.

Each language is a distribution of character trigrams (hashed to `BUCKETS`), counted over all usable labelled rows.  A text is a mixture of languages:
expectation-maximisation estimates the proportions from the likelihoods of its trigrams, and the set of languages
grows from the best single one as long as another one lowers the penalised likelihood (BIC).  The prediction is the
language with the largest proportion, its score that proportion.

Defined results: null or letterless texts are `und` with score 0; null ids are predicted, never learned from and
not held out; rows with a null lang are not learned from; repeated rows get equal predictions; without any learned
language all are `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SMOOTHING = 0.5
EM_STEPS = 25
PENALTY = 4.0
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Bucket of every trigram of the lower-cased letters, words apart by one blank; empty without a letter."""
    line = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not line.replace(" ", "").isalpha():  # numerals like ½ or ② are words to the pattern, but no letters
        line = " ".join("".join(c if c.isalpha() else " " for c in line).split())
    if not line:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {line} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA6B) + c[2:]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def mixture(counts: np.ndarray, likelihood: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, float]:
    """Proportions by EM and the log-likelihood; likelihood: trigrams x languages."""
    share = np.full(likelihood.shape[1], 1.0 / likelihood.shape[1])
    total = counts.sum()
    for _ in range(steps if likelihood.shape[1] > 1 else 0):
        joint = likelihood * share
        new = (counts / joint.sum(1)) @ joint / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(counts @ np.log(likelihood @ share))


class Languages:
    """Fitted trigram models: `predict(text)` gives (language, score, proportions)."""

    def __init__(self, names: list[str], logp: np.ndarray):
        self.names, self.logp = names, logp

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        grams = trigrams(text) if text else np.empty(0, np.int64)
        if not len(grams) or not self.names:
            return "und", 0.0, {}
        kinds, counts = np.unique(grams, return_counts=True)
        counts = counts.astype(float)
        logp = self.logp[kinds]
        likelihood = np.exp(logp - logp.max(1, keepdims=True))  # a common factor per trigram changes no comparison
        alone = counts @ np.log(likelihood + 1e-300)
        chosen = [int(alone.argmax())]
        share, best = np.ones(1), float(alone.max())
        penalty = PENALTY * np.log(counts.sum() + 1)
        while len(chosen) < len(self.names):
            tries = []
            for extra in range(len(self.names)):
                if extra not in chosen:
                    s, ll = mixture(counts, likelihood[:, chosen + [extra]] + 1e-12)
                    tries.append((ll, extra, s))
            ll, extra, s = max(tries, key=lambda t: t[0])
            if ll - best <= penalty:
                break
            chosen, share, best = chosen + [extra], s, ll
        top = int(share.argmax())
        return self.names[chosen[top]], float(min(1.0, share[top])), {self.names[c]: float(p) for c, p in zip(chosen, share)}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            g = trigrams(text or "")
            if len(g):
                into = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                into += np.bincount(g, minlength=BUCKETS)
    for lang, c in totals.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame) -> Languages:
    """Count trigrams of the rows with a lang whose crc32(id as text) mod 5 is not 0.  What comes to the driver is
    one number per language and bucket in use, at most BUCKETS a language."""
    usable = docs.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null").where(
        F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    counts = (usable.select("text", "lang").mapInArrow(_count, "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    got = counts.toPandas()
    names = sorted(got["lang"].unique())
    table = np.full((BUCKETS, len(names)), SMOOTHING)
    for j, name in enumerate(names):
        part = got[got["lang"] == name]
        table[part["bucket"].to_numpy(), j] += part["n"].to_numpy()
    return Languages(names, np.log(table / table.sum(0)) if names else table)


def _predict(model):
    def run(batches):
        for batch in batches:
            rows = [model.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([list(r[2].items()) for r in rows], pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "proportions"])
    return run


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score and proportions (map of the languages found)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, proportions map<string,double>"
    out = docs.select("doc_id", "text").mapInArrow(_predict(shared), schema)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "proportions")
