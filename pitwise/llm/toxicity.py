"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: I an insult (an acceptor of learned word forms and word beginnings, each with a weight),
H a threat verb, T a person who is spoken of or to, N a negation, R a verb of reported speech, and - for the rest.
Transducers rewrite the symbols of one clause in turn: negation marks the next few insults and threats, reported
speech marks those that follow it, and the target transducer adds weight to those with a person nearby.  A document's
evidence is that of its strongest clauses, and the score is the posterior probability with the labelled sample's odds
as prior.

The acceptor is fitted on a bounded sample of labelled rows (`FIT_ROWS`, ordered by a hash of the id).  Word
beginnings of at least four letters compete with whole words, so compounds of one insulting stem are learned from
their stem.  Near copies would make any of their words look telling: each row of the sample weighs
one over the number of rows with its MinHash value.

Defined results: a null or empty text has no clause and gets the score of a text without a match; null ids are scored, never learned from
and not held out; repeated rows get equal scores; null labels are not used.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import limit_batches, shingle_set, staged

FIT_ROWS = 20_000
ROWS_PER_ID = 4
#: Tasks that work on the sample, and word forms that one of them counts at a time.
FIT_TASKS = 32
FORMS = 100_000
MAX_PATTERNS = 2_000
#: A pattern occurs in at least this many toxic rows of the sample, and in this share of them.
MIN_SUPPORT, MIN_SHARE = 3.0, 0.02
MIN_PRECISION = 0.9
STEM = (4, 12)
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+|[.!?;:\n]")

# Closed word lists of the grammar's symbols in English, German, French and Spanish.
THREAT = "kill hurt destroy beat shoot stab strangle töten schlagen vernichten tuer frapper détruire matar golpear destruir"
TARGET = ("you your he him she her they them this that these those these du dich dein er sie ihr euch dieser "
          "tu te toi vous il elle ils elles ce cet cette usted tú él ella ellos este esta ese esa")
NEGATION = "not no never neither nor without nicht kein keine nie ohne ne pas jamais sans nunca jamás sin tampoco"
REPORT = ("said says say wrote writes told tells quoted called calls claimed sagte sagt schrieb nannte dit disait écrit "
          "appelle dijo dice escribió llamó")
SYMBOLS = {w: s for s, words in (("H", THREAT), ("T", TARGET), ("N", NEGATION), ("R", REPORT)) for w in words.split()}

NEGATION_SCOPE = 3
NEGATED, REPORTED, TARGETED, THREATENED = 0.5, 0.7, 0.5, 2.0


def negation(symbols: list[str], weights: list[float]) -> list[float]:
    """States count down the words since a negation; insults and threats in its scope lose weight."""
    state, out = 0, []
    for s, w in zip(symbols, weights):
        out.append(w * NEGATED if state and w else w)
        state = NEGATION_SCOPE if s == "N" else max(0, state - 1)
    return out


def reported(symbols: list[str], weights: list[float]) -> list[float]:
    """One state until a reporting verb, another up to the clause's end: what is quoted weighs less."""
    state, out = False, []
    for s, w in zip(symbols, weights):
        out.append(w * REPORTED if state and w else w)
        state = state or s == "R"
    return out


def targeted(symbols: list[str], weights: list[float]) -> list[float]:
    """A threat needs a person in its clause to count in full; an insult gains from one."""
    near = "T" in symbols
    return [w + TARGETED if w and s == "I" and near else w * (1.0 if near else 0.5) if s == "H" else w
            for s, w in zip(symbols, weights)]


def clause_weight(words: list[str], insults: dict[int, float]) -> float:
    """Weight of the strongest match of the composed transducers in one clause; insults: weight by word number."""
    symbols = ["I" if i in insults else SYMBOLS.get(w, "-") for i, w in enumerate(words)]
    weights = [insults.get(i, THREATENED if s == "H" else 0.0) for i, s in enumerate(symbols)]
    return max(targeted(symbols, reported(symbols, negation(symbols, weights))), default=0.0)


class Grammar:
    """The fitted acceptor with the grammar around it: `score(text)` in 0..1."""

    def __init__(self, patterns: dict[str, float], coefficients: list[float]):
        self.patterns, self.coefficients = patterns, coefficients
        self._machine = None

    def __getstate__(self):
        return {"patterns": self.patterns, "coefficients": self.coefficients, "_machine": None}

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            a = ahocorasick.Automaton()
            for p, w in self.patterns.items():  # "stem" accepts a word's beginning, "word " the whole word
                a.add_word(" " + p, (len(p) + 1, w))
            for w, s in SYMBOLS.items():
                if s == "H":
                    a.add_word(f" {w} ", (len(w) + 2, 0.0))
            a.make_automaton()
            self._machine = a
        return self._machine

    def clauses(self, text: str) -> list[float]:
        """Weights of the matched clauses, strongest first.  One pass over the text, whatever the number of matches."""
        words = ["." if t in ".!?;:\n" else t for t in WORD.findall(text.lower())]
        matches = [(end - length + 1, w) for end, (length, w) in self.machine().iter(" " + " ".join(words) + " ")]
        if not matches:
            return []
        begins = list(accumulate((len(t) + 1 for t in words), initial=0))  # a match begins at the blank before its word
        stops = [i for i, t in enumerate(words) if t == "."] + [len(words)]
        found: dict[int, dict[int, float]] = {}
        for start, w in matches:
            word = bisect_left(begins, start)
            insults = found.setdefault(bisect_left(stops, word), {})
            if w:
                insults[word] = max(insults.get(word, 0.0), w)
        out = []
        for c, insults in found.items():
            lo = stops[c - 1] + 1 if c else 0
            out.append(clause_weight(words[lo:stops[c]], {i - lo: w for i, w in insults.items()}))
        return sorted(out, reverse=True)

    def evidence(self, text: str) -> list[float]:
        """1, the strongest clause, the next two together, how many match, and the length of the text."""
        c = self.clauses(text) if text else []
        return [1.0, c[0] if c else 0.0, sum(c[1:3]), math.log1p(len(c)), math.log1p(len(text or "")) / 10 * (len(c) > 0)]

    def score(self, text: str) -> float:
        x = sum(a * b for a, b in zip(self.coefficients, self.evidence(text)))
        return 1.0 / (1.0 + math.exp(-min(max(x, -30.0), 30.0)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the first column, the intercept, has hardly any penalty."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + penalty @ beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        beta = beta - np.clip(np.linalg.solve(hess, grad), -3, 3)
    return beta


def _forms(text: str) -> set[str]:
    """Word forms ("word ") and beginnings ("stem") of a text."""
    out = set()
    for w in {t for t in WORD.findall(text.lower()) if t.isalpha()}:
        out.add(w + " ")
        for n in range(STEM[0], min(STEM[1], len(w)) + 1):
            out.add(w[:n])
    return out


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m1, m2 = [], []
        for t in batch.column("text").to_pylist():
            s = shingle_set(t.lower().encode()) if t else np.empty(0, np.uint64)
            m1.append(int(s[0]) >> 1 if len(s) else None)
            m2.append(int((s * np.uint64(0x9E3779B97F4A7C15)).min()) >> 1 if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(m1, pa.int64()), pa.array(m2, pa.int64())],
                                         names=["text", "toxic", "m1", "m2"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out():
        forms = list({*pos, *neg})
        return pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array([pos[f] for f in forms], pa.float64()),
                                           pa.array([neg[f] for f in forms], pa.float64())], names=["form", "pos", "neg"])
    pos, neg = Counter(), Counter()
    for batch in batches:
        for text, toxic, w in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "w"))):
            into = pos if toxic else neg
            for f in _forms(text or ""):
                into[f] += w
            if len(pos) + len(neg) > FORMS:  # bounded memory
                yield out()
                pos, neg = Counter(), Counter()
    yield out()


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Grammar:
    """Learn the insult acceptor from labelled rows whose crc32(id as text) mod 3 is not 1.

    The sample holds at most `fit_rows` ids with at most `ROWS_PER_ID` rows each."""
    limit_batches(docs.sparkSession)
    usable = (labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    sample = usable.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(fit_rows)
    # at most fit_rows ids; of an id with many texts a few, so the sample is bounded in rows
    one_id = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("k", F.row_number().over(one_id))
            .where(F.col("k") <= ROWS_PER_ID).select("text", "toxic"))
    # the sample is bounded, so few tasks hold it, and the counts of its MinHash values go to each of them
    texts = staged(rows.coalesce(FIT_TASKS).mapInArrow(_copies, "text string, toxic int, m1 long, m2 long"))
    n1, n2 = (F.broadcast(texts.groupBy(m).agg(F.count(F.lit(1)).alias(f"c_{m}"))) for m in ("m1", "m2"))
    weighed = staged(texts.join(n1, "m1").join(n2, "m2").select("text", "toxic", (1.0 / F.greatest("c_m1", "c_m2")).alias("w")))
    total = weighed.agg(F.sum(F.when(F.col("toxic") == 1, F.col("w"))).alias("pos"),
                        F.sum(F.when(F.col("toxic") == 0, F.col("w"))).alias("neg")).first()
    p, n = total["pos"] or 0.0, total["neg"] or 0.0
    counts = weighed.mapInArrow(_count, "form string, pos double, neg double").groupBy("form").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    weight = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (n + 1))
    best = (counts.where((F.col("pos") >= max(MIN_SUPPORT, MIN_SHARE * p)) & (F.col("pos") >= MIN_PRECISION * (F.col("pos") + F.col("neg"))))
            .withColumn("weight", weight).where("weight > 0")
            .orderBy(F.desc(F.round(F.col("weight") * F.col("pos"), 6)), "form").limit(MAX_PATTERNS))
    patterns = {r["form"]: round(r["weight"], 6) for r in best.collect()}
    grammar = Grammar(patterns, [])
    rows = np.asarray([list(r) for r in weighed.mapInArrow(_evidence(grammar), _EVIDENCE).collect()])  # at most fit_rows * ROWS_PER_ID
    rows = rows if len(rows) else np.array([[1.0, 0, 0, 0, 0, 0, 1]])
    grammar.coefficients = [round(float(v), 6) for v in logistic(rows[:, :5], rows[:, 5], rows[:, 6])]
    return grammar


_EVIDENCE = "one double, top double, next double, clauses double, length double, toxic double, w double"


def _evidence(grammar: Grammar):
    def run(batches):
        for batch in batches:
            x = [grammar.evidence(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array([r[i] for r in x], pa.float64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, batch.column("toxic").cast(pa.float64()), batch.column("w").cast(pa.float64())],
                                             names=[c.split()[0] for c in _EVIDENCE.split(", ")])
    return run


def _score(grammar: Grammar):
    def run(batches):
        for batch in batches:
            scores = [grammar.score(t) if t else grammar.score("") for t in batch.column("text").to_pylist()]
            names = [*batch.schema.names[:-1], "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=names)
    return run


def score_toxicity(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (higher: more likely toxic), predicted (1 from the threshold on)."""
    scored = docs.select("doc_id", "text").mapInArrow(_score(grammar), docs.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
                         "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with their columns, that score below the threshold."""
    def run(batches):
        for batch in batches:
            stay = [grammar.score(t or "") < threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(stay, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
