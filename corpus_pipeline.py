"""Corpus pipeline: quality classifier, quality rules, SimHash near-dedup, benchmark
decontamination, BPE encoding.  Each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm import bpe, crf, decontaminate, rules, simhash
from heronlake.llm.common import scratch, store, table
from heronlake.llm.queries import quality_model, vocabulary_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field finds good."""
    return crf.keep(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the current policy."""
    return rules.keep(docs, "v1")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids``, ``n_tokens`` and whether decoding gives the text back, by digest of both."""
    both = bpe.round_trip(docs, vocabulary_path())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality classifier", classify), ("quality rules", apply_rules), ("SimHash near-dedup", deduplicate), ("benchmark decontamination", decontaminated), ("BPE encoding", tokenize)]
#: Training a classifier and tokenizing can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages.  A stage's result is stored; what it stored on the way is deleted then, and so is its input.

    Documents may hold nulls in any column, empty and very long texts, repeated rows, and columns of
    any names; an empty table gives an empty table.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as paths:
            docs = store(stage(spark, docs, sf_dir), f"stage-{i}-{name.split()[-1]}")
            kept = paths.pop()
            paths += [before] if before else []
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
