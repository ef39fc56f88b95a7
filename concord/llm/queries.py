"""The registered queries of this subpackage: each applies one operator, with its
production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from concord.llm import (
    chat_tree,
    conversation_repair,
    decontam_lsa,
    importance_resampling,
    oracle,
    packing,
    quality_llr,
    quality_mil,
    repair,
    secret_scan,
    simhash_vptree,
    toxicity_cnn,
    trie_counts,
    warc,
)
from concord.llm.common import table, with_code


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(table(spark, sf_dir, "pages"))


def op2_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return quality_llr.quality_verdicts(table(spark, sf_dir, "documents"), quality_llr.trusted_from_labels(labels))


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_cnn.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.near_duplicates(table(spark, sf_dir, "documents"))


def op7_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (repair.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
            .select("doc_id", "start", "n_tokens", "ids_crc32"))


def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.round_trip(chat_tree.injected(table(spark, sf_dir, "conversations")), public_tokenizers.path("byte_bpe_50k.json"))


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam_lsa.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_reports(conversation_repair.damaged(table(spark, sf_dir, "conversations")), present="present")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = importance_resampling.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return importance_resampling.ranked(scored).select("doc_id", "n_features", "weight", "score", "rank")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return secret_scan.digest(found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: with_code(f) for f in (
    op1_warc_derivatives,
    op2_quality_llr,
    op3_quality_mil,
    op4_toxicity_cnn,
    op5_best_fit_packing,
    op6_simhash_vptree,
    op7_repair_token_files,
    op8_latent_decontamination,
    op9_trie_token_counts,
    op10_chat_prefix_tree,
    op11_conversation_repair,
    op12_importance_resampling,
    op13_secret_scan,
)}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_llr": oracle.OP2,
    "op10_chat_prefix_tree": oracle.OP10,
    "op11_conversation_repair": oracle.OP11,
    "op12_importance_resampling": oracle.OP12,
}
