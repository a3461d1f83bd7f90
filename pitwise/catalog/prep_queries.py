"""Registered encoding / scaling / split queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as EN
from ..operators import split as SP
from ..sources import adapters as A
from ..sources.tables import table
from .canonical_sql import with_ctes
from .common import q, r, rounded

Q: dict = {}
SQL: dict = {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ encoding
DICT_SQL = """SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT c_mktsegment FROM customer)"""


@reg("encode_label_fit", DICT_SQL)
def q_label_fit(spark, sf):
    return EN.fit_dictionary(table(spark, sf, "customer"), "c_mktsegment")


@reg("encode_label_apply", f"""
SELECT c.c_custkey, CAST(d.code AS INTEGER) AS c_mktsegment FROM customer c JOIN ({DICT_SQL}) d
ON c.c_mktsegment = d.c_mktsegment""")
def q_label_apply(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return EN.apply_label_encoding(c, EN.fit_dictionary(c, "c_mktsegment"), "c_mktsegment")


@reg("encode_category_codes", """
SELECT p.p_partkey, CAST(coalesce(d.code + 1, 0) AS INTEGER) AS p_name FROM part p
LEFT JOIN (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code
           FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey % 10 = 0)) d ON p.p_name = d.p_name""")
def q_codes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    d = EN.fit_dictionary(p.where(F.col("p_partkey") % 10 == 0), "p_name")
    return EN.apply_category_codes(p, d, "p_name")


@reg("encode_category_codes_unseen", """
SELECT o.o_orderkey, CAST(coalesce(d.code + 1, 0) AS INTEGER) AS o_custkey FROM orders o
LEFT JOIN (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS code
           FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-07-01')) d ON o.o_custkey = d.o_custkey""")
def q_codes_unseen(spark, sf):
    """The customers of the first half-year are known; those who order later only get the unseen code."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    d = EN.fit_dictionary(o.where(F.col("o_orderdate") < F.lit("1995-07-01").cast("timestamp")), "o_custkey")
    return EN.apply_category_codes(o.drop("o_orderdate"), d, "o_custkey")


@reg("encode_first_appearance", """
SELECT user_id, CAST(row_number() OVER (ORDER BY min(event_id), user_id) - 1 AS BIGINT) AS code
FROM events GROUP BY user_id""")
def q_first(spark, sf):
    return EN.fit_dictionary(table(spark, sf, "events"), "user_id", order_by="event_id")


PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@reg("encode_one_hot", "SELECT o_orderkey, " + ", ".join(
    f"CAST(coalesce(o_orderpriority = '{v}', false) AS INTEGER) AS {q('o_orderpriority_' + v)}" for v in PRIOS)
    + ", CAST(o_orderpriority IS NULL AS INTEGER) AS o_orderpriority_nan FROM orders")
def q_onehot(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    lv = EN.fit_levels(o, "o_orderpriority", 10)
    return o.select("o_orderkey", *EN.one_hot("o_orderpriority", lv))


@reg("encode_one_hot_array", with_ctes("""
SELECT user_id, list_transform(range(0, 5), lambda k: CASE WHEN k = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS onehot
FROM class_probs""", "class_probs"))
def q_onehot_arr(spark, sf):
    return A.class_probs(spark, sf).select("user_id", EN.one_hot_array("actual", 5).alias("onehot"))


@reg("encode_n_hot", """
SELECT user_id, list_transform(range(0, 5), lambda k: CASE WHEN list_contains(idx, k) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS nhot
FROM (SELECT user_id, list(DISTINCT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                                     WHEN 'signup' THEN 3 ELSE 4 END) AS idx
      FROM events GROUP BY user_id)""")
def q_nhot(spark, sf):
    e = table(spark, sf, "events")
    idx = F.array_position(F.array(*[F.lit(t) for t in A.EVENT_TYPES]), F.col("event_type")) - 1
    g = e.groupBy("user_id").agg(F.collect_set(idx.cast("int")).alias("idx"))
    return g.select("user_id", EN.n_hot_array("idx", 5).alias("nhot"))


@reg("encode_standard_scale", f"""
SELECT o_orderkey, {r('(o_totalprice - m1) / s1')} AS o_totalprice, {r('(CAST(o_custkey AS DOUBLE) - m2) / s2')}
  AS o_custkey
FROM orders, (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(o_custkey) AS m2,
                     stddev_pop(o_custkey) AS s2 FROM orders WHERE o_orderkey % 5 <> 0) st""")
def q_scale(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double"))
    st = EN.fit_scaler(o.where(F.col("o_orderkey") % 5 != 0), ["o_totalprice", "o_custkey"])
    return rounded(EN.apply_scaler(o, st, ["o_totalprice", "o_custkey"]))


@reg("encode_nn_fill", with_ctes(f"""
SELECT _id, {r('coalesce(TRANS_RBC, max(TRANS_RBC) OVER () + 100)')} AS TRANS_RBC,
       coalesce(OP_CODE, max(OP_CODE) OVER () + 100) AS OP_CODE, coalesce(prio, '#NA#') AS prio
FROM (SELECT _id, TRANS_RBC, OP_CODE, CASE WHEN _id % 4 = 0 THEN NULL ELSE BE_PRIORITY END AS prio FROM clinical)""",
                                 "clinical"))
def q_nnfill(spark, sf):
    c = A.clinical(spark, sf).select("_id", "TRANS_RBC", "OP_CODE",
                                     F.when(F.col("_id") % 4 == 0, None).otherwise(F.col("BE_PRIORITY")).alias("prio"))
    return rounded(EN.nn_fill(c, ["TRANS_RBC", "OP_CODE"], ["prio"]))


@reg("encode_scaled_one_hot", "SELECT p_partkey, " + ", ".join(
    f"{r(f'(b{i} - avg(b{i}) OVER ()) / stddev_pop(b{i}) OVER ()')} AS size_{i}" for i in range(6))
    + " FROM (SELECT p_partkey, " + ", ".join(
    f"CAST(p_size // 10 = {i} AS INTEGER) AS b{i}" for i in range(6)) + " FROM part)")
def q_scaled_onehot(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10).cast("int").alias("bucket"))
    p = p.select("p_partkey", *[(F.col("bucket") == i).cast("int").alias(f"size_{i}") for i in range(6)])
    cols = [f"size_{i}" for i in range(6)]
    return rounded(EN.apply_scaler(p, EN.fit_scaler(p, cols), cols))


PACK_SQL = """SELECT [CAST(coalesce(OP_CODE, 0) AS INTEGER), CAST(BE_FLAG AS INTEGER)] AS cats,
  [CAST(AF_PRICE_K AS FLOAT), CAST(coalesce(TRANS_RBC, 0) AS FLOAT)] AS contins, _id FROM clinical"""


def _packed(spark, sf):
    c = A.clinical(spark, sf).select("_id", F.coalesce("OP_CODE", F.lit(0)).alias("OP_CODE"), "BE_FLAG",
                                     "AF_PRICE_K", F.coalesce("TRANS_RBC", F.lit(0.0)).alias("TRANS_RBC"))
    return EN.pack_roles(c, ["OP_CODE", "BE_FLAG"], ["AF_PRICE_K", "TRANS_RBC"], target="_id")


@reg("encode_pack_roles", with_ctes(PACK_SQL, "clinical"))
def q_pack(spark, sf):
    return _packed(spark, sf)


@reg("encode_unpack_roles", with_ctes(f"""
SELECT cats[1] AS OP_CODE, cats[2] AS BE_FLAG, contins[1] AS AF_PRICE_K, contins[2] AS TRANS_RBC, _id
FROM ({PACK_SQL})""", "clinical"))
def q_unpack(spark, sf):
    return EN.unpack_roles(_packed(spark, sf), ["OP_CODE", "BE_FLAG"], ["AF_PRICE_K", "TRANS_RBC"])


@reg("encode_cardinality_width", """
SELECT "column", cardinality, CAST(least(50, floor((cardinality + 1) / 2)) AS BIGINT) AS width FROM (
  SELECT 'lang' AS "column", count(DISTINCT lang) + 1 AS cardinality FROM documents
  UNION ALL SELECT 'source', count(DISTINCT source) + 1 FROM documents)""")
def q_card(spark, sf):
    return EN.cardinality_width(table(spark, sf, "documents"), ["lang", "source"])


@reg("encode_proc_df", with_ctes(f"""
SELECT _id, BE_CUSTKEY, AF_PRICE_K, {r('coalesce(CAST(OP_CODE AS DOUBLE), m)')} AS OP_CODE, OP_CODE IS NULL AS OP_CODE_na,
       CAST(coalesce(d.code + 1, 0) AS INTEGER) AS BE_PRIORITY,
       CAST(coalesce(BE_STATUS = 'F', false) AS INTEGER) AS BE_STATUS_F,
       CAST(coalesce(BE_STATUS = 'O', false) AS INTEGER) AS BE_STATUS_O,
       CAST(coalesce(BE_STATUS = 'P', false) AS INTEGER) AS BE_STATUS_P,
       CAST(BE_STATUS IS NULL AS INTEGER) AS BE_STATUS_nan
FROM (SELECT * FROM clinical WHERE TRANS_RBC IS NOT NULL) c
CROSS JOIN (SELECT median(OP_CODE) AS m FROM clinical WHERE TRANS_RBC IS NOT NULL) md
LEFT JOIN (SELECT BE_PRIORITY AS v, row_number() OVER (ORDER BY BE_PRIORITY) - 1 AS code
           FROM (SELECT DISTINCT BE_PRIORITY FROM clinical WHERE TRANS_RBC IS NOT NULL)) d ON c.BE_PRIORITY = d.v""",
                                 "clinical"))
def q_procdf(spark, sf):
    c = A.clinical(spark, sf).where(F.col("TRANS_RBC").isNotNull()).select(
        "_id", "BE_CUSTKEY", "AF_PRICE_K", "OP_CODE", "BE_PRIORITY", "BE_STATUS", "TRANS_RBC")
    x, y, state = EN.proc_df(c, "TRANS_RBC", max_n_cat=3)
    return rounded(x)


# ------------------------------------------------------------------ splits
@reg("split_ordered_group", with_ctes("""
SELECT store_id, visit_date, visitors,
  CAST(CASE WHEN row_number() OVER (PARTITION BY store_id ORDER BY visit_date)
             <= floor(count(*) OVER (PARTITION BY store_id) * 0.9) THEN 0 ELSE 1 END AS INTEGER) AS type
FROM visits_nation""", "visits_nation"))
def q_ordered(spark, sf):
    v = A.visits_nation(spark, sf).select("store_id", "visit_date", "visitors")
    return SP.ordered_group_split(v, ["store_id"], ["visit_date"]).drop("rn")


@reg("split_sample_n", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100""")
def q_sample(spark, sf):
    return SP.sample_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@reg("split_kfold", """
SELECT doc_id, rn > 1 * nv AND rn <= 2 * nv AS is_valid FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
         floor(count(*) OVER () * 0.2) AS nv FROM documents)""")
def q_kfold(spark, sf):
    return SP.kfold(table(spark, sf, "documents").select("doc_id"), "doc_id", 1, 0.2)


@reg("split_stratified", """
SELECT vec_id, label, CASE WHEN rn <= 20 THEN 'valid' WHEN rn <= 40 THEN 'test' ELSE 'train' END AS part FROM (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id)
         AS rn FROM embeddings)""")
def q_strat(spark, sf):
    return SP.stratified_split(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id")


@reg("split_head_tail", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.95) AS is_train FROM documents""")
def q_headtail(spark, sf):
    return SP.head_tail(table(spark, sf, "documents").select("doc_id"), ["doc_id"], train_frac=0.95)


@reg("split_tail_n", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) <= count(*) OVER () - 1200 AS is_train FROM orders""")
def q_tailn(spark, sf):
    return SP.head_tail(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], n_tail=1200)


@reg("split_date_holdout", with_ctes("""
SELECT store_id, visit_date, visit_date >= DATE '2001-01-01' AND visit_date < DATE '2001-03-01' AS is_valid
FROM visits_nation""", "visits_nation"))
def q_dateho(spark, sf):
    v = A.visits_nation(spark, sf).select("store_id", "visit_date")
    return SP.date_holdout(v, "visit_date", "2001-01-01", "2001-03-01")


HO_KEYS = """(SELECT store_id, visit_date FROM visits_nation
  WHERE store_id % 2 = 0 AND visit_date > (SELECT max(visit_date) - 39 FROM visits_nation))"""


def _ho(spark, sf):
    v = A.visits_nation(spark, sf).select("store_id", "visit_date", "visitors")
    last = v.agg(F.max("visit_date")).scalar()
    keys = v.where((F.col("store_id") % 2 == 0) & (F.col("visit_date") > F.date_sub(last, 39)))
    return SP.holdout_test_set(v, keys.select("store_id", "visit_date"), "store_id", "visit_date")


@reg("split_holdout_train", with_ctes(f"""
SELECT store_id, visit_date, visitors FROM visits_nation
WHERE visit_date NOT IN (SELECT visit_date FROM {HO_KEYS}) AND store_id IN (SELECT store_id FROM {HO_KEYS})""",
                                      "visits_nation"))
def q_ho_train(spark, sf):
    return _ho(spark, sf)[0]


@reg("split_holdout_test", with_ctes(f"""
SELECT store_id, visit_date, visitors FROM visits_nation WHERE visit_date IN (SELECT visit_date FROM {HO_KEYS})""",
                                     "visits_nation"))
def q_ho_test(spark, sf):
    return _ho(spark, sf)[1]


QUERIES = Q


def oracle() -> dict[str, str]:
    return dict(SQL)
