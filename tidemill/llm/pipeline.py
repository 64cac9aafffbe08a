"""From raw documents to packed sequences: classifier, rules, near-duplicates, packing.

Each stage works on all its predecessor kept, and is written before the next one reads it. A stage takes null and empty
texts, null and repeated doc_ids and empty tables as its operator does, which says so; all but the last return the columns
of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import common, nbsvm, packing, quality_rules, simhash

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. See nbsvm.keep_good."""
    common.workers_import_this(spark)
    return nbsvm.keep_good(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not anomalous. See quality_rules.keep_by_rules."""
    common.workers_import_this(spark)
    return quality_rules.keep_by_rules(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies the document with the least doc_id. See simhash.drop_near_duplicates."""
    common.workers_import_this(spark)
    return simhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids. See packing.pack_online."""
    common.workers_import_this(spark)
    return packing.pack_online(docs, BYTE_BPE)


STAGES = [("quality classifier", quality_classifier), ("quality rules", rules), ("simhash near-dedup", near_duplicates), ("packing", pack)]

#: The classifier, the forest and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
