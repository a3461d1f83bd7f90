"""Token counts by heap-and-linked-list byte-pair merging, for SentencePiece BPE models and byte-level rank files.

A text is a list of symbols linked to their neighbours.  A heap holds every adjacent pair whose joined piece is in the
vocabulary, lowest rank first and leftmost among equals; popping a pair joins it and offers the two pairs that it now
forms.  The count is the number of initial symbols minus the number of merges (plus, for a character outside the
vocabulary that no merge took, its further UTF-8 bytes: models with byte fallback spell it in bytes).  No ids are made.

Texts are cut into units where no piece of the vocabulary can reach across, so merging each unit on its own gives the
same count, and a worker keeps the counts of units it met (a bounded memo; a miss merges anew).

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids come out as they are; any
length is merged whole, n symbols in n log n steps; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches

SPACE = "▁"  #: SentencePiece's mark of a space
MEMO_UNITS, MEMO_LENGTH = 1 << 18, 64  #: of one half of a worker's memo; longer units are merged each time
TOKEN_LIMIT = 4096


@dataclass(frozen=True)
class Vocabulary:
    """What a task needs to count: the file's bytes (their size bounds what is shipped) and how to read them.

    `kind` is "model" (a SentencePiece BPE model with byte fallback) or "ranks" (lines of base64 piece and rank, with
    the pattern that cuts a text into units)."""
    kind: str
    data: bytes
    pattern: str = ""


def load_model(path: str) -> Vocabulary:
    """A SentencePiece model; BPE with byte fallback and without pieces that the user defined or that are unused."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    with open(path, "rb") as f:
        data = f.read()
    model = pb.ModelProto.FromString(data)
    kinds = {p.type for p in model.pieces}
    piece = pb.ModelProto.SentencePiece
    if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or kinds & {piece.USER_DEFINED, piece.UNUSED}:
        raise ValueError(f"{path}: needs a BPE model with byte fallback, without user-defined or unused pieces")
    return Vocabulary("model", data)


def load_ranks(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary("ranks", f.read(), pattern)


def count_merges(unit, rank: dict) -> tuple[int, list[int]]:
    """Merges that byte-pair encoding does in `unit` (str or bytes), and for each position the end of the symbol that
    starts there (0 where none does)."""
    n = len(unit)
    end = list(range(1, n + 1))
    before = list(range(-1, n))
    heap = [(rank[p], i, i + 2) for i in range(n - 1) if (p := unit[i:i + 2]) in rank]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not i < mid < stop or end[mid] != stop:
            continue  # one of the two has been merged since
        end[i], end[mid] = stop, 0
        merges += 1
        if stop < n:
            before[stop] = i
            r = rank.get(unit[i:end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0:
            r = rank.get(unit[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    return merges, end


def unit_pattern(pieces) -> str:
    """Units of a normalised text: leading spaces and a run of characters that pieces tie together.

    Two characters are tied if they stand side by side in a piece; no piece, so no merge, joins characters of different
    classes of ties.  With a space behind another character in some piece, the whole text is one unit."""
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return "(?s).+"
    up: dict[str, str] = {}

    def root(c: str) -> str:
        while up.setdefault(c, c) != c:
            up[c] = c = up[up[c]]
        return c

    for p in pieces:
        p = p.lstrip(SPACE)
        for a, b in zip(p, p[1:]):
            up[root(a)] = root(b)
    classes: dict[str, list[str]] = {}
    for c in sorted(up):
        classes.setdefault(root(c), []).append(re.escape(c))
    runs = [f"[{''.join(cs)}]+" for cs in sorted(classes.values(), key=len, reverse=True)]
    return f"(?s){SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+"


class Counter(dict):
    """Counts tokens of texts; as a dict, the younger half of a bounded memo of unit -> tokens."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        if vocabulary.kind == "model":
            sp = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.data)
            ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
            places = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in ids}, reverse=True))}
            self.rank = {sp.id_to_piece(i): places[sp.get_score(i)] for i in ids}
            find = re.compile(unit_pattern(self.rank)).findall
            self.units = lambda text: find(sp.normalize(text))
        else:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.data.splitlines())}
            find = regex.compile(vocabulary.pattern).findall
            self.units = lambda text: [u.encode() for u in find(text)]

        self.older: dict = {}
        self.known = {p for p in self.rank if len(p) == 1}

    def __missing__(self, unit) -> int:
        tokens = self.older.get(unit)
        if tokens is None:
            tokens = self.merged(unit)
        if len(unit) <= MEMO_LENGTH:
            if len(self) >= MEMO_UNITS:
                self.older = dict(self)
                self.clear()
            self[unit] = tokens
        return tokens

    def merged(self, unit) -> int:
        merges, end = count_merges(unit, self.rank)
        tokens = len(unit) - merges
        if isinstance(unit, str) and not self.known.issuperset(unit):
            tokens += sum(len(c.encode()) - 1 for i, c in enumerate(unit) if end[i] == i + 1 and c not in self.rank)
        return tokens

    def tokens(self, text: str) -> int:
        return sum(map(self.__getitem__, self.units(text))) if text else 0


@functools.lru_cache(maxsize=2)
def counter(vocabulary: Vocabulary) -> Counter:
    """A worker's counter, kept from task to task."""
    return Counter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row."""
    limit_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(shipped.value)
        for b in batches:
            tokens = pa.array((c.tokens(t.as_py()) for t in b.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), tokens], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return (rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
