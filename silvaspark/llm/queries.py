"""The operators as queries over the given tables, with the columns of their contracts, and SQL for those that it can express.

Nulls, ties, repeated rows, empty tables and extra columns are as the operators' modules define them; a query adds columns but neither drops nor adds rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from silvaspark.common import table
from silvaspark.llm import collocation, decontaminate, fingerprint, language_id, license_scan, merkle, mixing, sharding, simhash, substring_dedup, topk, toxicity, url_filter


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: what the mix of all sources takes of it. A null text has size 0 and is taken 0 times; a null source is the last of the sources."""
    return mixing.mix_decisions(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that it holds, repeated documents as often as they are there; null and empty texts hold none, and empty tables give no row."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null and empty texts have the score of an empty window, a null id counts as held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~language_id.held_out(F.col("doc_id")))
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null and empty texts have no words and the digest of an empty text; rows of one id follow each other by text, null ids come last."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return kept.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; a null id has the slot of the text "null"; equal ids meet."""
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; `und` with score 0 for a null text or one without letters; ties go to the first language by name; without training rows all are `und`."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.train_and_identify(docs, ~language_id.held_out(F.col("doc_id")))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; texts without words have fingerprint zero and are linked like others; repeated rows are equal documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page; a null url or one without "://" has empty host and path, no rule and the default verdict."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark, url_filter.RULES))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null and empty texts have no words, empty labels and score 0."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return found.select("doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"), joined("base_labels"), joined("labels"), "score")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null texts are empty; null ids come first, and rows of one id follow each other by a digest of their text."""
    found = fingerprint.edited_likeness(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint.as_string(F.col("choices")).alias("fingerprint"), fingerprint.as_string(F.col("edited_choices")).alias("edited_fingerprint"), "near_edited", "near_next")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; rows without a source come first, rows without an id are first in their source and not tampered with; equal rows are leaves of their own."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 20 rows for each embedding whose id is divisible by 20; null, incomplete and non-finite vectors take no part; ties go to the smaller id."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 2000 rows for each language; null texts have no words, null languages are `und`; repeated rows count as often as they are there."""
    return collocation.mine(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_decontamination, op3_toxicity, op4_substring_dedup, op5_sharding, op6_language_id, op7_simhash, op8_url_filter, op9_license_scan, op10_fingerprint, op11_merkle, op12_topk, op13_collocation)
} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op1_mixing": mixing.ORACLE, "op5_sharding": sharding.oracle(), "op8_url_filter": url_filter.ORACLE, "op11_merkle": merkle.ORACLE, "op12_topk": topk.ORACLE, "op13_collocation": collocation.ORACLE}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
