"""From raw documents to token ids in five stages. Each stage takes all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuelgrid.llm import classifier, mixing, pieces, quality_rules, shingles, simhash
from fuelgrid.llm.common import written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of being good is a half or more, and that pass the base rule."""
    return quality_rules.keep_good(docs)


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.7 or more. It learns from all labelled documents, but
    for the rows held out (crc32 of the id, modulo 4, is 2)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    teach = labels.filter(classifier.remainder(F.col("doc_id"), 4) != 2)
    return classifier.keep_good(docs, classifier.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), teach))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near-duplicates. Links are those of SimHash, three-word shingles
    within two bits, and, since it finds few pairs of lower similarity, of five-word shingles whose similarity is 0.8."""
    return simhash.keep_one(docs, classes=simhash.merged(simhash.near_duplicates, shingles.near_duplicates))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source nears its target."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip."""
    return pieces.encode(docs)


STAGES = [("quality_rules", rules), ("quality_classifier", classified), ("simhash_near_dedup", deduplicated), ("mixing", mixed), ("sentencepiece", encoded)]
#: EM, the classifier, fingerprints' classes and the tokenizer aren't expressed in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
