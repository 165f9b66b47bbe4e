"""Queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, conversations, fingerprints, languages, licenses, merkle, mixing, packed_ids, quality_rules, simhash, substrings, url_filters
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(read(spark, sf_dir, "documents"))


#: Rules of op2: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: A domain whose first label has one of these is on op2's block list.
BLOCK_TERMS = ["adult", "ads", "bets", "casino", "pills", "spam"]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filters.judge(pages, URL_RULES, url_filters.domains_with(pages, BLOCK_TERMS))


OP2_SQL = rf"""
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, regexp_matches(host, '(^|\.)([^.]*-)?({"|".join(BLOCK_TERMS)})(-[^.]*)?(\.|$)') AS listed, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""


def vocabulary_path() -> str:
    """The word-end BPE file of the installed public tokenizers, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), vocabulary_path())


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classifier.rate(docs, classifier.fit(docs, classifier.graded(read(spark, sf_dir, "labels"))))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return languages.predict(docs, languages.fit(docs))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, quality_rules.trusted_ids(read(spark, sf_dir, "labels")))
    judged = quality_rules.judge(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.passages(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "n_words", "other_doc_id", "other_start", "n_equal")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return conversations.report(conversations.damage(rows), rows)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    checked = merkle.verify(merkle.manifest(docs, {"tampered": merkle.without_newlines(docs)}), "tampered")
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: The id that ends a document in op13's files.
END_ID = 2


def op13_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = packed_ids.save(read(spark, sf_dir, "documents"), vocabulary_path(), END_ID)
    return packed_ids.digests(packed_ids.read(spark, folder))


QUERIES: dict[str, Query] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_url_filters": op2_url_filters,
    "op3_bpe_encoding": op3_bpe_encoding,
    "op4_license_scans": op4_license_scans,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_source_mixing": op7_source_mixing,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_id_output": op13_token_id_output,
}

#: DuckDB SQL for those that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": OP2_SQL,
    "op4_license_scans": licenses.oracle_sql(),
    "op11_conversation_repair": conversations.oracle_sql(),
    "op12_merkle_manifest": merkle.oracle_sql(),
}
