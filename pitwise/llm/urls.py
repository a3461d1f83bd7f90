"""URL filters by host-suffix and path-prefix expressions, matched on short hash prefixes.

Each URL is cut into host and path, and expanded into expressions: suffixes of the host at a dot, joined with
folders of the path (the path up to and with one of its slashes; the empty folder too), of the lengths that rules have.  A rule (host, path) has the key
expression host + folder of its path.  Expressions and rules meet in an equi-join on the first 4 bytes of the
expression's SHA-256; a match then needs the whole digest and the rule's path at the start of the url's path.  Of a
url's matches the longest host + path wins, of equal ones the longer host, then block over allow.

Only distinct (host, path) pairs are expanded and joined, so a hot host costs its distinct paths.  Verdicts go back to
the pages by an equi-join on (host, path), which Spark splits where one pair is very common.

Defined results: a null url, or one without "://", has empty host and path and gets the default verdict; repeated pages
are judged alike; without rules every page gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the registered query: (action, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEFAULT_VERDICT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first "://" (A-Z lower-cased) and the path up to "?" or "#"; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^[^?#]*", 0), F.lit(""))
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substr(rest, F.lit(1), slash - 1)).otherwise(rest)
    path = F.when(slash > 0, F.substr(rest, slash)).otherwise(F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def folder(path: Column) -> Column:
    """The path up to and with its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def expressions(host: Column, path: Column, lengths: list[int], depths: list[int]) -> Column:
    """Array of (suffix, folder) of a url: suffixes of as many labels, and folders of as many slashes, as rules have, so
    a url costs its length times the kinds of rules, however many dots and slashes it has."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda i: i <= F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))
    parts = F.split(path, "/", -1)
    folders = F.transform(F.filter(F.array(*map(F.lit, depths)), lambda i: i < F.size(parts)),
                          lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(folders, lambda f: F.struct(s.alias("suffix"), f.alias("folder")))))


def with_digest(df: DataFrame, suffix: str, folder_: str) -> DataFrame:
    """Adds the digest of "suffix folder" and its first 4 bytes."""
    return (df.withColumn("digest", F.sha2(F.concat(F.col(suffix), F.lit(" "), F.col(folder_)), 256))
            .withColumn("prefix", F.substring("digest", 1, 8)))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, rule_host string, rule_path string")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """The input's columns other than the five added ones, with host, path, rule (host + path of the winning rule, else
    null) and verdict (the rule's action, else `default`)."""
    host, path = host_and_path(F.col(url_col))
    cut = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    keyed = with_digest(rules.withColumn("rule_folder", folder(F.col("rule_path"))), "rule_host", "rule_folder").withColumnsRenamed(
        {"digest": "rule_digest"})
    shapes = keyed.select(F.size(F.split("rule_host", r"\.", -1)).alias("n"), (F.size(F.split("rule_folder", "/", -1)) - 1).alias("d"))
    lengths, depths = ([r[0] for r in shapes.select(c).distinct().orderBy(c).collect()] for c in ("n", "d"))  # small numbers, distinct
    if not lengths:
        return cut.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    urls = cut.select("host", "path").where("host <> ''").distinct()
    expanded = with_digest(urls.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths, depths)).alias("e"))
                           .select("host", "path", "e.suffix", "e.folder"), "suffix", "folder")
    hits = (expanded.join(keyed, "prefix")
            .where((F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host"))
                   & F.expr("startswith(path, rule_path)"))
            .withColumn("rule", F.concat("rule_host", "rule_path")))
    rank = F.struct(F.length("rule"), F.length("rule_host"), F.when(F.col("action") == "block", 1).otherwise(0))
    won = (hits.groupBy("host", "path").agg(F.max(F.struct(rank.alias("rank"), "rule", "action")).alias("w"))
           .select("host", "path", "w.rule", F.col("w.action").alias("verdict")))
    return cut.join(won, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '(?s)^[^?#]*') ELSE '' END AS rest
  FROM pages),
hp AS (
  SELECT page_id, translate(CASE WHEN instr(rest, '/') > 0 THEN substr(rest, 1, instr(rest, '/') - 1) ELSE coalesce(rest, '') END,
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path
  FROM cut),
rules(action, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                 ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hit AS (
  SELECT host, path, rh || rp AS rule, action,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC, action DESC) AS k
  FROM (SELECT DISTINCT host, path FROM hp) u JOIN rules
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, hp.host, hp.path, rule, coalesce(action, 'allow') AS verdict
FROM hp LEFT JOIN hit ON hp.host = hit.host AND hp.path = hit.path AND k = 1
"""
