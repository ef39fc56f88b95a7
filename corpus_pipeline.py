"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet in the shared folder and reread as the next stage's docs.  The first four
keep the columns of ``documents``: quality rules, toxicity and benchmark leaks
drop the documents that they reject, near-duplicates leave one document of each
group.  The last one packs the tokens of what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from concord.llm import decontam_lsa, packing, quality_llr, simhash_vptree, toxicity_cnn
from concord.llm.common import run_folder, table, with_code


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_llr.keep_likely(docs, quality_llr.trusted_from_labels(table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_cnn.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_vptree.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam_lsa.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [(f.__name__, with_code(f)) for f in (
    quality_rules, toxicity, near_duplicates, decontamination, best_fit_packing)]

#: No SQL: three stages are trained or approximate models over text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs, folder = table(spark, sf_dir, "documents"), run_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
