"""Registered text queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as TX
from ..sources import adapters as A
from ..session import cut_lineage, ensure_parallelism, staged
from ..sources.tables import table
from .canonical_sql import with_ctes
from .common import DIGITS, r, rounded

Q: dict = {}
SQL: dict = {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _sql_tok(col: str, lower: bool = False) -> str:
    t = f"lower({col})" if lower else col
    cls = TX.PUNCT_CLASS.replace("'", "''")
    return (f"list_filter(regexp_split_to_array(regexp_replace({t}, '{cls}', ' \\1 ', 'g'), '{TX.WS}'), "
            f"lambda x: x <> '')")


def _docs(spark, sf, lower=False, materialize=False, only_labelled=False):
    d = table(spark, sf, "documents")
    if only_labelled:
        d = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    d = ensure_parallelism(d, "doc_id")
    t = d.select("doc_id", "source", TX.tokenize("text", lower=lower).alias("tokens"))
    return cut_lineage(t) if materialize else t


TOK_L = f"(SELECT doc_id, source, {_sql_tok('text', True)} AS tokens FROM documents)"
VOCAB_SQL = f"""(SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token) + 1 AS BIGINT) AS id, freq
  FROM (SELECT token, count(*) AS freq FROM (SELECT unnest(tokens) AS token FROM {TOK_L}) GROUP BY token
        HAVING count(*) >= 10)
  UNION ALL SELECT '<unk>', 0, NULL UNION ALL SELECT '<pad>', 1, NULL)"""
LONG_IDS = f"""(SELECT t.doc_id, t.pos, CAST(coalesce(v.id, 0) AS BIGINT) AS id FROM
  (SELECT doc_id, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS pos FROM {TOK_L}) t
  LEFT JOIN {VOCAB_SQL} v ON t.token = v.token)"""
IDS_SQL = f"""(SELECT d.doc_id, coalesce(i.ids, CAST([] AS BIGINT[])) AS ids FROM documents d LEFT JOIN
  (SELECT doc_id, list(id ORDER BY pos) AS ids FROM {LONG_IDS} GROUP BY doc_id) i ON d.doc_id = i.doc_id)"""


def _ids(spark, sf):
    toks = _docs(spark, sf, lower=True)  # tokenised anew by each step: cheaper than all tokens on disk
    return TX.numericalize(toks, TX.vocabulary(toks))


@reg("text_tokenize", f"SELECT doc_id, {_sql_tok('text')} AS tokens FROM documents")
def q_tok(spark, sf):
    return table(spark, sf, "documents").select("doc_id", TX.tokenize("text").alias("tokens"))


@reg("text_marked_tokens")
def q_marked(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", TX.marked_tokens("text").alias("tokens"))


@reg("text_vocabulary", f"SELECT * FROM {VOCAB_SQL}")
def q_vocab(spark, sf):
    return TX.vocabulary(_docs(spark, sf, lower=True))


@reg("text_numericalize", f"SELECT * FROM {IDS_SQL}")
def q_num(spark, sf):
    return _ids(spark, sf)


WORDS_SQL = f"""(SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS idx FROM
  (SELECT DISTINCT unnest({_sql_tok('text', True)}) AS word FROM benchmark))"""


def _words(spark, sf):
    b = table(spark, sf, "benchmark").select(F.explode(TX.tokenize("text", lower=True)).alias("word")).distinct()
    from ..operators.ordering import global_row_number
    return global_row_number(b, ["word"]).select("word", (F.col("rn") - 1).cast("int").alias("idx"))


@reg("text_word_vector_ids", f"""
SELECT t.doc_id, t.pos, CAST(CASE WHEN t.word = '' THEN -1 ELSE coalesce(w.idx, -1) END AS INTEGER) AS idx FROM
  (SELECT doc_id, pos, CASE WHEN regexp_full_match(token, '[A-Z]*') THEN lower(token) ELSE token END AS word FROM
    (SELECT doc_id, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS pos FROM
      (SELECT doc_id, {_sql_tok('text')} AS tokens FROM documents))) t
LEFT JOIN {WORDS_SQL} w ON t.word = w.word
UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE coalesce(len({_sql_tok('text')}), 0) = 0""")
def q_wv(spark, sf):
    d = _docs(spark, sf, materialize=True)
    return TX.word_vector_ids(d, _words(spark, sf))


def _part_sql(at: int) -> str:
    return f"(CAST('0x' || substr(md5(CAST(v.id AS VARCHAR) || ':' || CAST(i AS VARCHAR)), {at}, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


@reg("text_vocab_vectors", f"""
WITH v AS (SELECT id, CASE WHEN regexp_full_match(token, '[A-Z]*') THEN lower(token) ELSE token END AS word FROM {VOCAB_SQL}),
k AS (SELECT w.word, e.embedding FROM {WORDS_SQL} w JOIN embeddings e ON w.idx = e.vec_id)
SELECT v.id, CASE WHEN k.word IS NULL OR v.id = (SELECT max(id) FROM v)
  THEN list_transform(range(0, 64), lambda i: {r(f"sqrt(-2 * ln({_part_sql(1)})) * cos(2 * 3.141592653589793::DOUBLE * {_part_sql(9)}) * 0.6::DOUBLE / 3")})
  ELSE list_transform(k.embedding, lambda x: {r("CAST(x AS DOUBLE) / 3")}) END AS vector
FROM v LEFT JOIN k ON v.word = k.word""")
def q_vocab_vec(spark, sf):
    toks = _docs(spark, sf, lower=True, materialize=True)
    vocab = TX.vocabulary(toks)
    words = _words(spark, sf)
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("idx"),
                                                 F.col("embedding").alias("vector"))
    out = TX.vocab_vectors(vocab, words, vecs, dim=64)
    return out.select("id", F.transform("vector", lambda x: F.round(x, DIGITS)).alias("vector"))


@reg("text_pad_truncate", f"""
SELECT doc_id, CASE WHEN len(ids) >= 80 THEN list_slice(ids, len(ids) - 79, len(ids))
                    ELSE list_concat(list_resize([]::BIGINT[], 80 - len(ids), 0), ids) END AS ids
FROM {IDS_SQL}""")
def q_pad(spark, sf):
    return _ids(spark, sf).select("doc_id", TX.pad_truncate("ids", 80).alias("ids"))


@reg("text_pad_to_max", f"""
SELECT doc_id, list_concat(ids, list_resize([]::BIGINT[], max(len(ids)) OVER () - len(ids), 0)) AS ids
FROM {IDS_SQL}""")
def q_padmax(spark, sf):
    return TX.pad_to_max(_ids(spark, sf), "ids")


@reg("text_seq_wrap", f"""
SELECT doc_id, list_concat([CAST(-2 AS BIGINT)], list_reverse(ids), [CAST(-3 AS BIGINT)]) AS ids FROM {IDS_SQL}""")
def q_wrap(spark, sf):
    return _ids(spark, sf).select("doc_id", TX.seq_wrap(F.col("ids"), sos=-2, eos=-3, backwards=True).alias("ids"))


STREAM_SQL = f"""(SELECT source, doc_id, CAST(off + pos AS BIGINT) AS idx, token FROM (
  SELECT source, doc_id, off, unnest(list_append(tokens, '<eos>')) AS token, unnest(range(0, len(tokens) + 1)) AS pos
  FROM (SELECT source, doc_id, tokens, coalesce(sum(len(tokens) + 1) OVER (PARTITION BY source ORDER BY doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM {TOK_L})))"""


@reg("text_token_stream", f"SELECT * FROM {STREAM_SQL}")
def q_stream(spark, sf):
    return TX.token_stream(_docs(spark, sf, lower=True, materialize=True), group_cols=["source"])


BS, BPTT = 16, 70
GSTREAM_SQL = f"""(SELECT CAST(off + pos AS BIGINT) AS idx, token FROM (
  SELECT off, unnest(list_append(tokens, '<eos>')) AS token, unnest(range(0, len(tokens) + 1)) AS pos
  FROM (SELECT doc_id, tokens, coalesce(sum(len(tokens) + 1) OVER (ORDER BY doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM {TOK_L})))"""


@reg("text_lm_batches", f"""
WITH s0 AS (SELECT g.idx, CAST(coalesce(v.id, 0) AS BIGINT) AS id FROM {GSTREAM_SQL} g
            LEFT JOIN {VOCAB_SQL} v ON g.token = v.token),
nb AS (SELECT CAST(floor((max(idx) + 1) / {BS}) AS BIGINT) AS nb FROM s0),
s AS (SELECT CAST(idx // nb AS BIGINT) AS stream, CAST(idx % nb AS BIGINT) AS t, id, nb FROM s0, nb WHERE idx < nb * {BS}),
x AS (SELECT t // {BPTT} AS chunk, stream, list(id ORDER BY t) AS x FROM s
      WHERE t < nb - 1 AND t // {BPTT} < nb // {BPTT} - 1 GROUP BY 1, 2),
y AS (SELECT (t - 1) // {BPTT} AS chunk, stream, list(id ORDER BY t) AS y FROM s
      WHERE t >= 1 AND (t - 1) // {BPTT} < nb // {BPTT} - 1 GROUP BY 1, 2)
SELECT CAST(x.chunk AS BIGINT) AS chunk, x.stream, x.x, y.y FROM x JOIN y ON x.chunk = y.chunk AND x.stream = y.stream""")
def q_lm(spark, sf):
    # the texts, not their tokens, are kept, with a number for each row: a doc_id may come more than once
    docs = ensure_parallelism(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    docs = cut_lineage(docs.withColumn("row", F.monotonically_increasing_id()))
    toks = docs.select("doc_id", "row", TX.tokenize("text", lower=True).alias("tokens"))
    vocab = TX.vocabulary(toks)
    ended = toks.select("row", F.concat("tokens", F.array(F.lit(TX.EOS))).alias("tokens"))
    ids = cut_lineage(docs.select("doc_id", "row").join(TX.numericalize(ended, vocab, key="row"), "row"))
    st = TX.token_stream(ids, tokens_col="ids", eos=None, pieces=True)
    return TX.lm_batches(st, BS, BPTT, id_col="tokens")


BOW_SQL = f"""(SELECT doc_id, term, count(*) AS n, 1 AS x FROM
  (SELECT doc_id, unnest(tokens) AS term FROM {TOK_L}) GROUP BY 1, 2)"""


@reg("text_bag_of_words", f"SELECT * FROM {BOW_SQL}")
def q_bow(spark, sf):
    return TX.bag_of_words(_docs(spark, sf, lower=True))


LAB_SQL = "(SELECT doc_id, toxic AS y FROM labels)"
NB_SQL = f"""(SELECT term, c AS class, ln(((s_c + 1) / n_c) / ((s - s_c + 1) / (n - n_c))) AS r FROM (
  SELECT s.term, c.c, CASE c.c WHEN 0 THEN s.s0 ELSE s.s1 END AS s_c, s.s,
         CASE c.c WHEN 0 THEN z.n0 ELSE z.n1 END AS n_c, z.n
  FROM (SELECT b.term, sum(CASE WHEN l.y = 0 THEN b.x ELSE 0 END) AS s0, sum(CASE WHEN l.y = 1 THEN b.x ELSE 0 END)
               AS s1, sum(b.x) AS s FROM {BOW_SQL} b JOIN {LAB_SQL} l ON b.doc_id = l.doc_id GROUP BY b.term) s,
       (SELECT count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1, count(*) AS n
        FROM {LAB_SQL}) z, (SELECT unnest([0, 1]) AS c) c))"""


def _nb(spark, sf):
    # the ratios only use labelled documents: tokenise just those (semi-join before the explode)
    bow = TX.bag_of_words(_docs(spark, sf, lower=True, only_labelled=True))
    lab = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"))
    return bow, lab, TX.nb_ratios(bow, lab)


@reg("text_nb_ratio", f"SELECT term, CAST(class AS INTEGER) AS class, {r('r')} AS r FROM {NB_SQL}")
def q_nb(spark, sf):
    return rounded(_nb(spark, sf)[2])


@reg("text_nb_score", f"""
SELECT doc_id, class, {r('score')} AS score, {r('e / sum(e) OVER (PARTITION BY doc_id)')} AS prob FROM (
SELECT doc_id, CAST(class AS INTEGER) AS class, score, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e
FROM (SELECT doc_id, class, sum(r) AS score FROM
       (SELECT doc_id, term FROM {BOW_SQL}) t
       JOIN {NB_SQL} n ON t.term = n.term GROUP BY 1, 2))""")
def q_nbscore(spark, sf):
    # written once: the ratios and each step of the scores read bags, not texts to tokenise
    bow_all = staged(TX.bag_of_words(_docs(spark, sf, lower=True)))
    lab = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"))
    return rounded(TX.nb_scores(bow_all, TX.nb_ratios(bow_all, lab)))


CHARV_SQL = """(SELECT ch, CAST(row_number() OVER (ORDER BY ch) AS BIGINT) AS id FROM
  (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark))"""


@reg("text_char_vocab", f"SELECT * FROM {CHARV_SQL}")
def q_charv(spark, sf):
    return TX.char_vocabulary(table(spark, sf, "benchmark"))


@reg("text_char_windows", f"""
WITH ids AS (SELECT item_id, list(v.id ORDER BY pos) AS idx FROM
  (SELECT item_id, unnest(string_split(text, '')) AS ch, unnest(range(0, length(text))) AS pos FROM benchmark) c
  JOIN {CHARV_SQL} v ON c.ch = v.ch GROUP BY item_id)
SELECT item_id, CAST(i AS INTEGER) AS i, list_slice(idx, i + 1, i + 40) AS x, list_slice(idx, i + 2, i + 41) AS y
FROM (SELECT item_id, idx, unnest(range(0, len(idx) - 41)) AS i FROM ids)""")
def q_charw(spark, sf):
    b = table(spark, sf, "benchmark")
    return TX.char_windows(b, TX.char_vocabulary(b), "item_id")


@reg("text_sortish_batches", """
WITH h AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
           FROM documents),
c AS (SELECT doc_id, n_chars, CAST(floor((rn - 1) / 800) AS BIGINT) AS chunk FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY n_chars DESC, doc_id) AS rn FROM c)
SELECT doc_id, n_chars, chunk, rn, CAST(chunk * 50 + floor((rn - 1) / 16) AS BIGINT) AS batch,
       md5('42:b:' || CAST(CAST(chunk * 50 + floor((rn - 1) / 16) AS BIGINT) AS VARCHAR)) AS batch_order FROM k""")
def q_sortish(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return TX.sortish_batches(d, "doc_id", "n_chars", bs=16)


QUERIES = Q


def oracle() -> dict[str, str]:
    return dict(SQL)
