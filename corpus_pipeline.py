"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token files.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, and works on everything its predecessor kept. All but
the last return the columns of ``documents``. ``run`` writes each stage's rows as
Parquet in the shared checkpoint folder and reads them again for the next.

Nulls, empty texts, repeated rows and empty tables are treated as each
operator's docstring says. A document that mixing takes in several epochs comes
as several rows, and each gets its tokens in the files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortflow.llm import decontam, mixing, quality, simhash, token_output
from cohortflow.llm.common import materialize, table
from cohortflow.llm.queries import byte_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the boosted trees accept."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.drop_near_duplicates(docs, width=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the corpus weights, once per epoch, as many tokens as come in.

    Documents of leaves that weigh less than their share of the corpus are left out, those of others come again.
    """
    return mixing.mix_documents(docs, mixing.PIPELINE_SPEC, mixing.corpus_levels())


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, per document."""
    return token_output.token_documents(docs, byte_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination),
    ("mixing", mixing_weights), ("token_output", token_files)]

#: Trees, XXH64 fingerprints and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
