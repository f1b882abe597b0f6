"""The registered queries of this subpackage, with their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incident_analytics.llm import (align_tokens, collocations, language_mix, license_scan, minmax_dedup, mixing,
                                    nn_descent, packing, quality_lines, simhash_dedup, token_planes, toxicity,
                                    warc_bundle)
from incident_analytics.llm.rows import crc_of_id, spread, table
from incident_analytics.session import materialize


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_bundle.write_bundles(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    records = materialize(warc_bundle.read_records(manifest), "warc-records")
    return warc_bundle.resolve_revisits(records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(crc_of_id() % 5 != 0)
    return (toxicity.score(docs, toxicity.learn(docs, labels))
            .withColumn("held_out", F.coalesce(crc_of_id() % 5 == 0, F.lit(False))))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    return quality_lines.line_quality(docs, with_text=False)


def byte_bpe() -> str:
    """Default place of the public byte-level tokenizer; every operator takes the path as a parameter."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    return packing.best_fit_packing(docs, byte_bpe())


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id")
    model = language_mix.learn(docs.where(crc_of_id() % 4 != 2))
    return (language_mix.identify(docs, model)
            .withColumn("held_out", F.coalesce(crc_of_id() % 4 == 2, F.lit(False))))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nn_descent.nearest_neighbours(rows, F.col("id") % 50 == 0)


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    manifest = token_planes.write_token_files(docs, byte_bpe())
    return token_planes.read_token_files(manifest).drop("file_row")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    return minmax_dedup.near_duplicates(docs, k=3, percent=85)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id")
    return collocations.collocations(docs)


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    return simhash_dedup.simhash_duplicates(docs)


def piece_bpe() -> str:
    """Default place of the public piece tokenizer; every operator takes the path as a parameter."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    return align_tokens.align_tokenizers(docs, byte_bpe(), piece_bpe())


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_warc_bundles": op2_warc_bundles,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scans": op5_license_scans,
    "op6_language_id": op6_language_id,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_token_planes": op8_token_planes,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_collocations": op11_collocations,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES = {
    "op2_warc_bundles": warc_bundle.SQL,
    "op4_quality_rules": quality_lines.SQL,
    "op5_license_scans": license_scan.SQL,
    "op10_source_mixing": mixing.SQL,
    "op11_collocations": collocations.SQL,
}
