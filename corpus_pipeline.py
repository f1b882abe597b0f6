"""From raw documents to packed training sequences, one stage after the other.

Every stage takes the documents its predecessor kept and returns documents of
the same columns (the last one returns pieces); :func:`run` writes each stage's
result as Parquet to the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incident_analytics.llm import language_mix, minmax_dedup, mixing, packing, quality_lines
from incident_analytics.llm.queries import byte_bpe
from incident_analytics.llm.rows import CARRIED, crc_of_id, spread
from incident_analytics.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; a missing ``lang`` takes the predicted one."""
    docs = spread(docs, "doc_id")
    model = language_mix.learn(docs.where(crc_of_id() % 4 != 2))
    found = language_mix.identify(docs, model, with_row=True).where(F.col("lang_pred") != language_mix.UNKNOWN)
    return found.select(*(F.coalesce(f"{CARRIED}.lang", "lang_pred").alias(c) if c == "lang"
                          else F.col(f"{CARRIED}.{c}").alias(c) for c in docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with the text of their surviving lines."""
    judged = quality_lines.line_quality(spread(docs, "doc_id"), with_row=True).where("kept")
    changed = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType)}
    return judged.select(*(changed.get(c, F.col(f"{CARRIED}.{c}")).alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more)."""
    docs = spread(docs, "doc_id")
    return minmax_dedup.one_per_group(docs, minmax_dedup.near_duplicates(docs))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights follow the raked shares of source, language and topic."""
    return mixing.mix_sources(docs, with_row=True).where("sampled").select(f"{CARRIED}.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    return packing.best_fit_packing(spread(docs, "doc_id"), byte_bpe())


STAGES = [
    ("language ID", known_language),
    ("quality rules", good_quality),
    ("MinHash near-dedup", one_of_each_group),
    ("mixing sources to target weights", target_mix),
    ("best-fit packing", packed),
]
#: The tokenizer and the learned language model are beyond SQL; tests run the stages on small documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
