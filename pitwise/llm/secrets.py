"""Secret scans over a trigram inverted index, in DataFrame functions only.

For each rule a Boolean trigram query is derived from its regex: literal stretches give the trigrams that any match
must hold, alternatives give an OR.  The index holds, for each of these trigrams and each block of document keys, the
keys of the documents with that trigram (letters in lower case).  A rule's postings are intersected and united block by block; only the
documents left are verified with the regex.  A rule without mandatory trigrams scans every text.

Spans come from the regex itself: the matches, leftmost first and not overlapping, and the stretches between them
give each match's place in code points; matches that fail the rule's length are then dropped.

A posting holds at most 2 ** BLOCK_BITS keys and a block at most that many per trigram, so no group grows with a hot key.

Defined results: a null or empty text has no span; null ids are keyed by their text's hash; repeated rows are scanned
alike, one row each.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key

BLOCK_BITS = 12
MAX_ALTERNATIVES = 64
MAX_CLASS = 8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1
    base: bool = False


#: The three base rules of the contract, then the rules the library adds.
#: A maximal run of 16 or more hexadecimal digits equals a longest run with the shorter ones dropped.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def _choices(op, arg) -> set[str] | None:
    """The strings that a piece of a regex can be, in lower case, if they are few."""
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN:
        out: set[str] = set()
        for o, a in arg:
            if o is rc.LITERAL:
                out.add(chr(a).lower())
            elif o is rc.RANGE and a[1] - a[0] < MAX_CLASS:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= MAX_CLASS else None
    if op is rc.SUBPATTERN:
        return _sequence_choices(arg[-1])
    if op is rc.BRANCH:
        parts = [_sequence_choices(b) for b in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op is rc.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
        inner = _sequence_choices(arg[2])
        return inner | {""} if inner is not None else None
    return None


def _sequence_choices(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        c = _choices(op, arg)
        if c is None or len(out) * len(c) > MAX_ALTERNATIVES:
            return None
        out = {x + y for x in out for y in c}
    return out


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _any_of(choices: set[str]) -> set[frozenset[str]]:
    """OR of ANDs for a stretch that is one of `choices`; the empty set of conditions if one is too short to tell."""
    sets = {_trigrams(c) for c in choices}
    if frozenset() in sets:
        return {frozenset()}
    return {s for s in sets if not any(o < s for o in sets)}


def trigram_query(pattern: str) -> list[set[frozenset[str]]]:
    """AND of (OR of (AND of trigrams)) that every match's text fulfils in lower case; empty: nothing is mandatory."""
    clauses: list[set[frozenset[str]]] = []
    run = {""}

    def flush():
        c = _any_of(run)
        if frozenset() not in c and c not in clauses:
            clauses.append(c)

    for op, arg in rp.parse(pattern):
        c = _choices(op, arg)
        if c is not None and len(run) * len(c) <= MAX_ALTERNATIVES:
            run = {x + y for x in run for y in c}
            continue
        flush()
        run = {""}
        if c is not None:
            run = c
        elif op is rc.BRANCH:
            clauses += [set().union(*(set().union(*trigram_query_of(b)) for b in arg[1]))] if all(trigram_query_of(b) for b in arg[1]) else []
    flush()
    return clauses


def trigram_query_of(items) -> list[set[frozenset[str]]]:
    """Query of one branch of an alternative that isn't a plain list of strings."""
    c = _sequence_choices(items)
    if c is None:
        return []
    q = _any_of(c)
    return [] if frozenset() in q else [q]


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(block, index): for each block of keys a map from trigram to the sorted-out keys of the texts that hold it."""
    here = F.filter(F.array(*(F.lit(t) for t in trigrams)), lambda t: F.contains(F.col("low"), t))
    pairs = rows.select("rk", F.lower("text").alias("low")).select("rk", F.explode(here).alias("trigram"))
    lists = (pairs.withColumn("block", F.shiftright("rk", BLOCK_BITS)).groupBy("block", "trigram")
             .agg(F.collect_set("rk").alias("keys")))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("index"))


def candidates(index: DataFrame, queries: dict[str, list[set[frozenset[str]]]]) -> DataFrame:
    """(rk, kinds): the rules that a document can match, from intersected and united postings."""
    none = F.array().cast("array<long>")

    def keys_of(t: str) -> Column:
        return F.coalesce(F.col("index")[t], none)

    def both(parts: list[Column], join) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = join(out, p)
        return out

    def marked(keys: Column, kind: str) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("rk"), F.lit(kind).alias("kind")))

    found = []
    for kind, query in queries.items():
        ors = [both([both([keys_of(t) for t in sorted(grams)], F.array_intersect) for grams in sorted(clause, key=sorted)], F.array_union)
               for clause in query]
        found.append(marked(both(ors, F.array_intersect), kind))
    return (index.select(F.explode(F.concat(*found)).alias("c")).select("c.rk", "c.kind")
            .groupBy("rk").agg(F.collect_set("kind").alias("kinds")))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's kept matches, in code points, the end exclusive."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)

    def piece(m: Column, gap: Column) -> Column:
        checked = F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m
        return F.struct(F.length(gap).alias("gap"), F.length(m).alias("length"), (F.length(checked) >= rule.min_length).alias("ok"))

    pieces = F.zip_with(matches, F.slice(between, F.lit(1), F.size(matches)), piece)
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), nothing.alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + p["length"]
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["ok"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(rule.pattern), F.aggregate(pieces, start, step)["spans"]).otherwise(nothing)


def _joined(columns: list[tuple[int, Rule]]) -> Column:
    """kind:start:end of several span columns, by start, then kind, comma-joined."""
    def named(no: int, kind: str) -> Column:
        return F.transform(F.col(f"s_{kind}"), lambda s: F.struct(
            s["start"].alias("start"), F.lit(no).alias("no"),
            F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("span")))

    parts = F.concat(*(named(i, r.kind) for i, r in columns))
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["span"]), ",")


def with_spans(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """The input's rows as a struct `row`, their text (null: empty), and s_<kind> for each rule."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       row_key(id_col, text_col).alias("rk"))
    if queries:
        trigrams = sorted({t for q in queries.values() for clause in q for grams in clause for t in grams})
        rows = rows.join(candidates(postings(rows.select("rk", "text"), trigrams), queries), "rk", "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    spans = {f"s_{r.kind}": spans_of(F.col("text"), r) if r.kind not in queries
             else F.when(F.array_contains("kinds", r.kind), spans_of(F.col("text"), r)).otherwise(nothing) for r in rules}
    return rows.select("row", "text", *(c.alias(n) for n, c in spans.items()))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, text, s_<kind> (array of start, end) for each rule, n_<kind> for the base rules,
    base_sha256 and spans."""
    found = with_spans(docs.select(id_col, text_col), id_col, text_col, rules).withColumn(id_col, F.col(f"row.`{id_col}`")).drop("row")
    numbered = list(enumerate(rules))
    counts = {f"n_{r.kind}": F.size(f"s_{r.kind}").cast("long") for r in rules if r.base}
    return (found.withColumns(counts)
            .withColumn("base_sha256", F.sha2(_joined([(i, r) for i, r in numbered if r.base]), 256))
            .withColumn("spans", _joined(numbered)))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                   mask: str = "[SECRET]") -> DataFrame:
    """The rows, with their columns, with each stretch that spans cover replaced by `mask`; n_chars, where it is a
    column, follows the new text.  Null texts stay null."""
    found = with_spans(docs, id_col, text_col, rules)
    spans = F.array_sort(F.concat(*(F.col(f"s_{r.kind}") for r in rules)))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate("all_spans", start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    found = found.select("row", "text", spans.alias("all_spans")).select(
        "row", F.when(F.size("all_spans") > 0, cut).alias("clean"))
    new = []
    for c in docs.columns:
        old = F.col(f"row.`{c}`")
        if c == text_col:
            old = F.coalesce("clean", old)
        elif c == "n_chars":
            old = F.coalesce(F.length("clean").cast(docs.schema[c].dataType), old)
        new.append(old.alias(c))
    return found.select(*new)


def _sql_kind(no: int, rule: Rule) -> str:
    """Spans of one rule in DuckDB; (?i) is spelled out in classes, since there it would also fold letters beyond ASCII."""
    pattern = rule.pattern
    if pattern.startswith("(?i)"):
        head, tail = pattern[4:].split(")", 1)
        head = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head)
        pattern = f"{head}){tail}"
    p = "'" + pattern.replace("'", "''") + "'"
    checked = f"regexp_extract(m, {p}, {rule.group})" if rule.group else "m"
    return f"""
  SELECT rn, {no} AS no, '{rule.kind}' AS kind, start, start + length(m) AS stop
  FROM (SELECT rn, m, sum(length(g) + length(m)) OVER (PARTITION BY rn ORDER BY k) - length(m) AS start
        FROM (SELECT rn, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS k
              FROM (SELECT rn, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gs FROM d)))
  WHERE length({checked}) >= {rule.min_length}"""


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    union = "\n  UNION ALL".join(_sql_kind(i, r) for i, r in enumerate(rules))
    base = ", ".join(f"'{r.kind}'" for r in rules if r.base)
    one = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rn FROM documents),
s AS ({union}),
j AS (SELECT rn, {counts}, string_agg({one}, ',' ORDER BY start, no) FILTER (kind IN ({base})) AS b,
             string_agg({one}, ',' ORDER BY start, no) AS a FROM s GROUP BY rn)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)},
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN j USING (rn)"""
