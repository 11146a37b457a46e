"""Registered queries of the corpus operators: thin digests of what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import decontaminate, embedding_tiles, language_cnn, license_scan, ngram_kn, packing, pii_votes, prefix_trie, quality_fm, secrets_link, simhash_golay, token_align, toxicity
from vigil.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_pii_votes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii_votes.digest(pii_votes.find(table(spark, sf_dir, "documents")))


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op3_secrets_link")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, weak parts only where linked."""
    return secrets_link.digest(secrets_link.find(table(spark, sf_dir, "documents")))


@query("op4_embedding_tiles", embedding_tiles.ORACLE_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine >= 0.9."""
    return embedding_tiles.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_language_cnn")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    return language_cnn.identify(table(spark, sf_dir, "documents"))


@query("op6_simhash_golay")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word shingles, at most 2 bits."""
    return simhash_golay.digest(simhash_golay.near_duplicates(table(spark, sf_dir, "documents")))


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, by path source/doc_id."""
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


@query("op8_quality_fm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels outside the held-out fold."""
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_ngram_kn")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents, learned outside the held-out fold."""
    return ngram_kn.cross_score(table(spark, sf_dir, "documents"))


@query("op10_decontaminate", decontaminate.ORACLE_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op11_token_align")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links of two tokenizers over all documents."""
    return token_align.digest(table(spark, sf_dir, "documents"))


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels outside the held-out fold."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_prefix_trie")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
