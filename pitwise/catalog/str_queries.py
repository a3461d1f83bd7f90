"""Registered string / box queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as ST
from ..operators import boxes as B
from ..sources import adapters as A
from ..sources.tables import table
from .canonical_sql import with_ctes
from .common import r, rounded

Q: dict = {}
SQL: dict = {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@reg("strings_id_split", with_ctes("""
SELECT id, substr(id, 1, length(id) - 11) AS store, CAST(right(id, 10) AS DATE) AS visit_date FROM submission""",
                                   "submission"))
def q_split(spark, sf):
    s = A.submission(spark, sf)
    return s.select("id", ST.id_store("id").alias("store"), ST.id_date("id").alias("visit_date"))


@reg("strings_id_build", with_ctes("""
SELECT CAST(store_id AS VARCHAR) || '_' || strftime(visit_date, '%Y-%m-%d') AS id, visitors FROM visits_customer""",
                                   "visits_customer"))
def q_build(spark, sf):
    v = A.visits_customer(spark, sf)
    return v.select(ST.id_build("store_id", "visit_date").alias("id"), "visitors")


@reg("strings_positional_tokens", "SELECT p_partkey, " + ", ".join(
    f"coalesce(string_split(replace(p_name, '-', ' '), ' ')[{i + 1}], '') AS p_name{i}" for i in range(10))
    + " FROM part")
def q_pos(spark, sf):
    p = table(spark, sf, "part")
    toks = ST.positional_tokens("p_name", 10, " ", replace="-")
    return p.select("p_partkey", *[t.alias(f"p_name{i}") for i, t in enumerate(toks)])


@reg("strings_first_token", with_ctes(
    "SELECT store_id, split_part(air_area_name, ' ', 1) AS air_area_name0 FROM stores", "stores"))
def q_first(spark, sf):
    return A.stores(spark, sf).select("store_id", ST.first_token("air_area_name").alias("air_area_name0"))


@reg("strings_location_key", with_ctes("""
SELECT store_id, CASE WHEN lat IS NULL OR lon IS NULL THEN NULL
                      ELSE CAST(lat AS VARCHAR) || '_' || CAST(lon AS VARCHAR) END AS air_loc
FROM (SELECT store_id, CASE WHEN store_id % 5 = 0 THEN NULL ELSE latitude END AS lat, longitude AS lon FROM stores)""",
                                       "stores"))
def q_loc(spark, sf):
    s = A.stores(spark, sf).select("store_id", F.when(F.col("store_id") % 5 == 0, None)
                                   .otherwise(F.col("latitude")).alias("lat"), F.col("longitude").alias("lon"))
    return s.select("store_id", ST.location_key("lat", "lon").alias("air_loc"))


@reg("strings_strip_replace", """
SELECT conv_id, turn, trim(replace(text, chr(10), chr(9)), '"'' ' || chr(9)) AS text FROM conversations""")
def q_strip(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", ST.strip_chars(ST.newline_to_tab("text")).alias("text"))


@reg("strings_base_name", """
SELECT page_id, regexp_extract(url, '[^/]*$') AS base, split_part(regexp_extract(url, '[^/]*$'), '.', 1) AS stem
FROM pages""")
def q_base(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", ST.base_name("url").alias("base"), ST.stem("url").alias("stem"))


# ------------------------------------------------------------------ boxes
ANN_SQL = """(SELECT 'img/' || CAST(l_orderkey AS VARCHAR) || '.jpg' AS filename, l_orderkey,
  l_quantity AS height, CAST(l_linenumber AS DOUBLE) AS width, l_discount * 100 AS x, l_tax * 100 AS y
  FROM lineitem)"""
LARGEST_SQL = f"""(SELECT filename, arg_max({{'height': height, 'width': width, 'x': x, 'y': y}},
                          (height * width, height, width, x, y)) AS box FROM {ANN_SQL} GROUP BY filename)"""


@reg("boxes_largest", f"""
SELECT filename, {r('box.height')} AS height, {r('box.width')} AS width, {r('box.x')} AS x, {r('box.y')} AS y
FROM {LARGEST_SQL}""")
def q_largest(spark, sf):
    a = A.annotations(spark, sf)
    b = a.select("filename", B.largest_box("annotations").alias("box"))
    return rounded(b.select("filename", *[F.col("box")[f].alias(f) for f in B.BOX_FIELDS]))


@reg("boxes_shape", f"""
SELECT image_id, {r('h')} AS height, {r('w')} AS width, {r('x')} AS x, {r('y')} AS y FROM (
SELECT image_id,
  CASE WHEN shape_type IN (1, 2) THEN CAST(p[4] AS DOUBLE)
       WHEN shape_type = 4 THEN list_max(ys) - list_min(ys) END AS h,
  CASE WHEN shape_type IN (1, 2) THEN CAST(p[3] AS DOUBLE)
       WHEN shape_type = 4 THEN list_max(xs) - list_min(xs) END AS w,
  CASE WHEN shape_type IN (1, 2) THEN CAST(p[1] AS DOUBLE) WHEN shape_type = 4 THEN list_min(xs) END AS x,
  CASE WHEN shape_type IN (1, 2) THEN CAST(p[2] AS DOUBLE) WHEN shape_type = 4 THEN list_min(ys) END AS y
FROM (SELECT image_id, shape_type, p,
        list_transform(p, lambda s: CAST(TRY_CAST(string_split(s, ',')[1] AS FLOAT) AS DOUBLE)) AS xs,
        list_transform(p, lambda s: CAST(TRY_CAST(string_split(s, ',')[2] AS FLOAT) AS DOUBLE)) AS ys
      FROM (SELECT image_id, shape_type, string_split(shape_desc, ' ') AS p FROM
        (SELECT p_partkey AS image_id,
                CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 3 END AS shape_type,
                CASE WHEN p_partkey % 4 IN (0, 1) THEN concat_ws(' ', CAST(p_partkey % 97 AS VARCHAR),
                       CAST(p_partkey % 53 AS VARCHAR), CAST(p_size AS VARCHAR), CAST(p_size + 3 AS VARCHAR))
                     WHEN p_partkey % 4 = 2 THEN concat_ws(' ',
                       CAST(p_partkey % 97 AS VARCHAR) || ',' || CAST(p_partkey % 53 AS VARCHAR),
                       CAST(p_partkey % 53 AS VARCHAR) || ',' || CAST(p_size AS VARCHAR),
                       CAST(p_size AS VARCHAR) || ',' || CAST(p_partkey % 97 AS VARCHAR))
                     ELSE '?' END AS shape_desc FROM part))))""")
def q_shape(spark, sf):
    s = A.shapes(spark, sf)
    b = s.select("image_id", B.shape_to_box("shape_type", "shape_desc").alias("box"))
    return rounded(b.select("image_id", *[F.col("box")[f].alias(f) for f in B.BOX_FIELDS]))


SIZE_W = "(640 + (l_orderkey % 7) * 32)"
SIZE_H = "(480 + (l_orderkey % 5) * 16)"


@reg("boxes_rescaled_with_default", f"""
SELECT f.filename, {r('coalesce(box.height * 224.0 / sh, 0.0)')} AS height,
       {r('coalesce(box.width * 224.0 / sw, 0.0)')} AS width,
       {r('coalesce(greatest(box.x * 224.0 / sw, 0.0), 0.0)')} AS x,
       {r('coalesce(greatest(box.y * 224.0 / sh, 0.0), 0.0)')} AS y
FROM (SELECT 'img/' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS filename FROM orders) f
LEFT JOIN (SELECT b.filename, b.box, CAST(640 + (k % 7) * 32 AS DOUBLE) AS sw, CAST(480 + (k % 5) * 16 AS DOUBLE) AS sh
           FROM (SELECT filename, box, CAST(split_part(split_part(filename, '/', 2), '.', 1) AS BIGINT) AS k
                 FROM {LARGEST_SQL}) b) x ON f.filename = x.filename""")
def q_rescale(spark, sf):
    a = A.annotations(spark, sf)
    k = ST.stem("filename").cast("long")
    b = a.select("filename", B.rescale_box(B.largest_box("annotations"), (F.lit(640) + (k % 7) * 32).cast("double"),
                                           (F.lit(480) + (k % 5) * 16).cast("double")).alias("box"))
    files = table(spark, sf, "orders").select(
        F.concat(F.lit("img/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("filename"))
    out = B.with_default_box(files, b)
    return rounded(out.select("filename", *[F.col("box")[f].alias(f) for f in B.BOX_FIELDS]))


QUERIES = Q


def oracle() -> dict[str, str]:
    return dict(SQL)
