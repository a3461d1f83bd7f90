"""Registered queries of the training-data operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import importance, language, licenses, mixing, ranking, secrets, tokens, toxicity, urls
from .common import table
from .decontamination import find_leaks
from .embeddings import near_vectors
from .minhash import minhash_components
from .substrings import drop_repeated_passages


def op8_licenses(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op9_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("row_hash", "copies")


def op10_minhash(spark, sf_dir):
    return minhash_components(table(spark, sf_dir, "documents")).drop("row_hash", "stays")


def op4_substrings(spark, sf_dir):
    return drop_repeated_passages(table(spark, sf_dir, "documents")).drop("kept_text")


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).drop("proportions")


def op5_decontamination(spark, sf_dir):
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", F.round("score", 6).alias("score"), "end_word")


def op6_embeddings(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_urls(spark, sf_dir):
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rules_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_importance(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ranking(spark, sf_dir):
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_tokens(spark, sf_dir):
    import public_tokenizers
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokens.load_model(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_language": op3_language,
    "op5_decontamination": op5_decontamination,
    "op6_embeddings": op6_embeddings,
    "op7_urls": op7_urls,
    "op8_licenses": op8_licenses,
    "op9_mixing": op9_mixing,
    "op4_substrings": op4_substrings,
    "op10_minhash": op10_minhash,
    "op11_importance": op11_importance,
    "op12_ranking": op12_ranking,
    "op13_tokens": op13_tokens,
}

ORACLES: dict[str, str] = {
    "op2_secrets": secrets.oracle_sql(),
    "op7_urls": urls.ORACLE,
    "op11_importance": importance.ORACLE,
    "op12_ranking": ranking.ORACLE,
}
