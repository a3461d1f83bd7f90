"""Registered source / sink / plug-in queries.

Source tests write a Spark-derived fixture into the shared scratch folder
(under spark.checkpoint.dir), then read it back with the operator under test.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import plugins as PL
from ..plans import pit
from ..session import scratch_path
from ..sources import adapters as A
from ..sources import readers as RD
from ..sources import sinks as SK
from ..sources.tables import TABLE_NAMES, glob_bundle, table
from .canonical_sql import with_ctes
from .common import r, rounded

Q: dict = {}
SQL: dict = {}
#: Ends a document in a file of many: a control character that the texts don't hold.
RECORD_END = "\x1e\n"


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@reg("io_csv_scan", with_ctes("""
SELECT store_id AS air_store_id, visit_date, visitors, sales FROM visits_nation""", "visits_nation"))
def q_csv(spark, sf):
    path = _scratch(spark, "csv")
    A.visits_nation(spark, sf).write.option("header", True).csv(path)
    return RD.read_csv(spark, path, "store_id int, visit_date date, visitors bigint, sales double",
                       {"store_id": "air_store_id"})


CLIN_SCHEMA = ("_id bigint, BE_PRIORITY string, BE_STATUS string, BE_CUSTKEY bigint, BE_FLAG boolean, "
               "TRANS_RBC double, AF_PRICE_K double, dt_data bigint, DEPT_CODE string, RBC_LOSS double, OP_CODE bigint")


@reg("io_json_lines", with_ctes("SELECT * FROM clinical WHERE TRANS_RBC IS NOT NULL", "clinical"))
def q_json(spark, sf):
    path = _scratch(spark, "json")
    A.clinical(spark, sf).write.json(path)
    return RD.read_json_lines(spark, path, CLIN_SCHEMA, target="TRANS_RBC")


@reg("io_parquet_partitioned", with_ctes("""
SELECT store_id, visit_date, visitors, sales, CAST(year(visit_date) AS INTEGER) AS year FROM visits_nation""",
                                         "visits_nation"))
def q_parquet(spark, sf):
    path = _scratch(spark, "parquet")
    v = A.visits_nation(spark, sf).withColumn("year", F.year("visit_date"))
    SK.write_intermediate(v, path, ["year"])
    return SK.read_intermediate(spark, path)


@reg("io_csv_fixed_float", with_ctes("""
SELECT CAST(store_id AS VARCHAR) || '_' || strftime(visit_date, '%Y-%m-%d') AS id, printf('%.4f', sales) AS sales
FROM visits_nation""", "visits_nation"))
def q_csv_fixed(spark, sf):
    path = _scratch(spark, "sub")
    v = A.visits_nation(spark, sf)
    out = v.select(F.concat_ws("_", F.col("store_id").cast("string"), F.date_format("visit_date", "yyyy-MM-dd"))
                   .alias("id"), "sales")
    SK.write_submission_csv(out, path, 4, gzip=True)
    return spark.read.schema("id string, sales string").option("header", True).csv(path)


@reg("io_labelled_paths", """
SELECT path, name, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS class_idx FROM (
  SELECT path, string_split(path, '/')[-1] AS name, string_split(path, '/')[-2] AS label FROM (
    SELECT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages))""")
def q_paths(spark, sf):
    p = table(spark, sf, "pages").select(F.parse_url("url", F.lit("PATH")).alias("path"))
    return RD.labelled_paths(p)


@reg("io_multi_label", """
WITH ex AS (SELECT doc_id, unnest(string_split(lang || ' ' || source, ' ')) AS lab FROM documents),
cl AS (SELECT lab, CAST(row_number() OVER (ORDER BY lab) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT lab FROM ex)),
g AS (SELECT doc_id, list_sort(list(DISTINCT idx)) AS labels_idx FROM ex JOIN cl USING (lab) GROUP BY doc_id)
SELECT doc_id, labels_idx,
  list_transform(range(0, (SELECT count(*) FROM cl)),
                 lambda k: CASE WHEN list_contains(labels_idx, CAST(k AS INTEGER)) THEN 1.0::DOUBLE
                                ELSE 0.0::DOUBLE END) AS nhot,
  NULL::INTEGER AS label_idx FROM g""")
def q_ml(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "lang", "source").alias("labels"))
    return RD.multi_label(d, "doc_id", "labels")[1]


@reg("io_annotation_json", """
SELECT CAST(l_orderkey AS VARCHAR) || '.jpg' AS file, l_quantity AS height, CAST(l_linenumber AS DOUBLE) AS width,
       l_discount * 100 AS x, l_tax * 100 AS y, NULL::VARCHAR AS class FROM lineitem""")
def q_annjson(spark, sf):
    a = A.annotations(spark, sf)
    js = a.select(F.to_json(F.struct("filename", "annotations")).alias("value"))
    return RD.flatten_annotations(js)


@reg("io_word_vectors", """
SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS idx, 'w' || CAST(vec_id AS VARCHAR) AS word,
       embedding AS vector FROM embeddings""")
def q_wv(spark, sf):
    path = _scratch(spark, "vec")
    e = table(spark, sf, "embeddings")
    dim = 64
    n = e.agg(F.count(F.lit(1))).scalar()
    body = e.select(F.col("vec_id").alias("k"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")),
                                                            F.array_join(F.transform("embedding",
                                                                                     lambda x: x.cast("string")), " "))
                    .alias("value"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit(f"{n} {dim}").alias("value"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # files in key order: part-00000 starts with the header line
    head.unionByName(body).repartitionByRange(parts, "k").sortWithinPartitions("k").select("value").write.text(path)
    return RD.read_word_vectors(spark, path)


@reg("io_glob_bundle", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TABLE_NAMES))
def q_glob(spark, sf):
    bundle = glob_bundle(spark, sf)
    frames = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
              for name, df in sorted(bundle.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@reg("io_text_folders", """
SELECT 'lang=' || lang AS label, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS class_idx,
       text || chr(10) AS text FROM documents""")
def q_textdirs(spark, sf):
    path = _scratch(spark, "txt")
    docs = table(spark, sf, "documents").select("lang", "text")
    # a file per document
    docs = docs.repartition(max(spark.sparkContext.defaultParallelism * 8, docs.rdd.getNumPartitions()))
    # where Spark's writer makes the files, tasks move their own
    SK.write_text_folders(docs, path, "lang", **{"mapreduce.fileoutputcommitter.algorithm.version": "2"})
    return RD.read_text_folders(spark, path).select("label", "class_idx", "text")


@reg("io_text_folder_records", """
SELECT 'lang=' || lang AS label, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS class_idx, text FROM documents""")
def q_textrecords(spark, sf):
    path = _scratch(spark, "txtr")
    table(spark, sf, "documents").select("lang", "text").write.option("lineSep", RECORD_END).partitionBy("lang").text(path)
    return RD.read_text_folders(spark, path, separator=RECORD_END).select("label", "class_idx", "text")


@reg("io_text_folder_lines", r"""
SELECT role, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) || ' <eos>' AS text FROM conversations""")
def q_textlines(spark, sf):
    path = _scratch(spark, "txtl")
    table(spark, sf, "conversations").select("role", "text").write.partitionBy("role").text(path)
    lines = RD.read_text_folders(spark, path, lines=True)
    return lines.select(F.regexp_extract("path", "role=([^/]+)/", 1).alias("role"), "text")


# ------------------------------------------------------------------ plug-ins
def _store_dow_family(ctx):
    return pit.store_week_feat(ctx)


@reg("plugins_feature_families")
def q_families(spark, sf):
    from .pit_queries import context
    ctx = context(spark, sf)
    fams = [PL.FeatureFamily(_store_dow_family, ["store_id", "dow"], labelled=True),
            PL.FeatureFamily(pit.store_exp_feat, ["store_id"], labelled=True)]
    out = PL.build_with_families(ctx, fams, high_eng=pit.second_feat)
    return rounded(out.select("end_date", "store_id", "visit_date", "dow", "store_dow_mean14", "store_dow_median28",
                              "store_dow_count56", "store_dow_std1000", "store_exp_mean1000"))


def _families_sql():
    from .pit_queries import exp_sql, pit_sql, summary_sql
    extra = {
        "fd": summary_sql(["store_id", "dow"], "store_dow", pit.STORE_HORIZONS, raw=True),
        "fe": exp_sql(["store_id"], "store", raw=True),
        "lab": """SELECT d.*, w.end_date FROM pit_data d JOIN windows w
                  ON d.visit_date >= w.end_date AND d.visit_date < w.end_date + w.days_in_label""",
    }
    body = f"""SELECT lab.end_date, lab.store_id, lab.visit_date, lab.dow,
      {r('coalesce(store_dow_mean14, 0)')} AS store_dow_mean14, {r('coalesce(store_dow_median28, 0)')} AS store_dow_median28,
      coalesce(store_dow_count56, 0) AS store_dow_count56, {r('coalesce(store_dow_std1000, 0)')} AS store_dow_std1000,
      {r('coalesce(store_exp_mean1000, 0)')} AS store_exp_mean1000
    FROM lab LEFT JOIN fd USING (end_date, store_id, dow) LEFT JOIN fe USING (end_date, store_id)"""
    return pit_sql(body, extra)


SQL["plugins_feature_families"] = _families_sql()


@reg("plugins_hook", with_ctes(f"SELECT _id, AF_PRICE_K, {r('ln(1 + AF_PRICE_K)')} AS log_price FROM clinical",
                               "clinical"))
def q_hook(spark, sf):
    c = A.clinical(spark, sf).select("_id", "AF_PRICE_K")
    return rounded(PL.apply_hook(c, lambda d: d.withColumn("log_price", F.log1p("AF_PRICE_K"))))


def _rank_pct(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("visit_date")
    pdf["visitors_pct"] = pdf["visitors"].rank(pct=True)
    return pdf[["store_id", "visit_date", "visitors", "visitors_pct"]]


@reg("plugins_group_apply", with_ctes("""
SELECT store_id, visit_date, visitors, (rank() OVER (PARTITION BY store_id ORDER BY visitors)
       + (count(*) OVER (PARTITION BY store_id, visitors) - 1) / 2) / count(*) OVER (PARTITION BY store_id) AS visitors_pct
FROM visits_nation""", "visits_nation"))
def q_gapply(spark, sf):
    v = A.visits_nation(spark, sf).select("store_id", "visit_date", "visitors")
    return PL.group_apply(v, ["store_id"], _rank_pct,
                          "store_id int, visit_date date, visitors long, visitors_pct double")


@reg("plugins_custom_aggregate", with_ctes(f"""
SELECT store_id, {r('sum((isodow(visit_date)) * visitors) / sum(isodow(visit_date))')} AS wmean,
       CAST(DATE '2001-08-01' - min(visit_date) AS INTEGER) AS first_time,
       CAST(DATE '2001-08-01' - max(visit_date) AS INTEGER) AS last_time
FROM visits_nation GROUP BY store_id""", "visits_nation"))
def q_cagg(spark, sf):
    v = A.visits_nation(spark, sf)
    pivot_d = F.lit("2001-08-01").cast("date")
    return rounded(v.groupBy("store_id").agg(
        PL.custom_aggregate("weighted_mean")((F.weekday("visit_date") + 1).cast("double"), F.col("visitors"))
        .alias("wmean"),
        PL.custom_aggregate("first_time")(pivot_d, F.col("visit_date")).alias("first_time"),
        PL.custom_aggregate("last_time")(pivot_d, F.col("visit_date")).alias("last_time")))


@reg("plugins_mergeable_aggregate", with_ctes(f"""
SELECT store_id, {r('sum((isodow(visit_date)) * visitors) / sum(isodow(visit_date))')} AS wmean FROM visits_customer GROUP BY store_id""", "visits_customer"))
def q_magg(spark, sf):
    v = A.visits_customer(spark, sf).withColumn("w", (F.weekday("visit_date") + 1).cast("double"))
    v = v.withColumn("visitors", F.col("visitors").cast("double"))
    return rounded(PL.mergeable_aggregate(v, ["store_id"], ["w", "visitors"], PL.WEIGHTED_MEAN, "wmean"))


@reg("plugins_custom_metric", with_ctes(f"""
SELECT {r('sqrt(avg(pow(ln(1 + (exp(pred_a) - 1)) - ln(1 + (exp(actual) - 1)), 2)))')} AS rmsle FROM regressions""",
                                        "regressions"))
def q_cmetric(spark, sf):
    g = A.regressions(spark, sf).select(F.expm1("actual").alias("actual"), F.expm1("pred_a").alias("pred"))
    return rounded(PL.METRICS["rmsle"](g))


QUERIES = Q


def oracle() -> dict[str, str]:
    return dict(SQL)
