"""Registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import (clustering, decontam, exact_dedup, hard_negatives, line_dedup, mixing, pii, quality,
                            sharding, simhash, token_output, toxicity, warc)
from cohortflow.llm.common import table


def byte_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without their hosts' boilerplate lines."""
    pages = table(spark, sf_dir, "pages")
    return line_dedup.site_line_dedup(pages, "page_id", line_dedup.host_of(F.col("url")),
                                      line_dedup.html_lines(F.col("html")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document statistics, base rule and boosted-tree verdict."""
    docs = table(spark, sf_dir, "documents")
    found = quality.verdicts(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.drop("text_key")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    return decontam.digest(decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
                           ).drop("longest_words", "longest_item", "longest_start")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token files, read back."""
    return token_output.token_documents(table(spark, sf_dir, "documents"), byte_bpe())


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 runs of the Hilbert order over language, source and length."""
    docs = table(spark, sf_dir, "documents")
    dims = {"lang": F.col("lang"), "source": F.col("source"),
            "length": F.log1p(F.coalesce(F.length("text"), F.lit(0)))}
    return sharding.hilbert_shards(docs, dims).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen per epoch under the corpus weights, shortages handed to siblings, then ancestors."""
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.CORPUS_SPEC, mixing.corpus_levels()).select(
        "doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back through the chunk table."""
    chunks = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return warc.records(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and offending spans of every document."""
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's centroid after three rounds of k-means."""
    found, centres = clustering.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding",
                                        dims=64, scale=64, k=16, rounds=3, seed="1")
    return clustering.digest(found, centres).select(
        F.col("own_id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of every document's group of equal texts."""
    return exact_dedup.groups(table(spark, sf_dir, "documents")).select(
        F.col("own_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors' positives; every seventh row has a shifted label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        hard_negatives.integer_rows(rows, "vec_id", label, "embedding", 256), F.col("id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline, stage after stage."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_decontamination, op4_token_output, op5_sharding,
                            op6_mixing, op7_warc, op8_personal_data, op9_simhash, op10_toxicity,
                            op11_centroid_clustering, op12_exact_dedup, op13_hard_negatives, pipeline)}

ORACLES: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE, "op3_decontamination": decontam.ORACLE,
                           "op6_mixing": mixing.ORACLE, "op7_warc": warc.ORACLE,
                           "op11_centroid_clustering": clustering.ORACLE, "op12_exact_dedup": exact_dedup.ORACLE,
                           "op13_hard_negatives": hard_negatives.ORACLE}
