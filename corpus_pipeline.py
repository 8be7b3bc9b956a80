"""A training corpus from documents: five stages, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession

from pairwell.llm import bpe_tree, decontaminate, near_duplicates, private_data, quality, runtime


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the outlier test keep."""
    return quality.kept_documents(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean_documents(docs, runtime.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return private_data.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes and ids of all documents."""
    return bpe_tree.encode_decode(docs, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, keep_ids=True)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", ngram_jaccard), ("benchmark decontamination", decontamination), ("personal data", personal_data), ("byte-level BPE", tokens)]

#: The robust estimates of the first stage and the tokenizer of the last are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents."""
    docs, before = runtime.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = runtime.save(stage(spark, docs, sf_dir))
        if before is not None:
            runtime.drop(before)
        before = docs
    return docs
