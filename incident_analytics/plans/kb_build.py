"""Raw exports to knowledge base, splits and vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DATASET_LANGUAGE, KB_ROWS, SEED, TEST_FRACTION, TOP_QUEUES
from ..operators.curation import curate
from ..operators.leakage import without_leaked
from ..operators.retrieval import build_vector_table, embed_corpus
from ..operators.sampling import kb_sample, stratified_split
from ..functions.text import embed_text
from ..sources.tickets import read_kb, read_raw_tickets, write_kb, write_splits


def build_kb(spark: SparkSession, raw_path: str, out: str, lang: str = DATASET_LANGUAGE,
             queues: int = TOP_QUEUES, kb_rows: int = KB_ROWS, fraction: float = TEST_FRACTION,
             seed: int = SEED, exclude_test: bool = False, split_files: bool = False) -> DataFrame:
    """Curate the exports below ``raw_path`` and write kb, splits and vectors below ``out``.

    The curated table is written once and read back for each later step, so the
    exports are parsed once.  With ``exclude_test`` tickets of the test split, and
    tickets with the text of one, are left out of the knowledge base.
    """
    raw = read_raw_tickets(spark, raw_path, split_files=split_files)
    if raw is None:
        raise FileNotFoundError(f"no CSV export below {raw_path}")
    write_kb(curate(raw, "src_ord", lang, queues), f"{out}/curated")
    curated = read_kb(spark, f"{out}/curated")
    write_splits(stratified_split(curated, fraction, seed=seed), f"{out}/splits")
    if exclude_test:
        curated = without_leaked(curated, read_kb(spark, f"{out}/splits", split="test"))
    write_kb(kb_sample(curated, kb_rows, seed=seed), f"{out}/kb")
    kb = read_kb(spark, f"{out}/kb")
    write_kb(build_kb_vectors(kb), f"{out}/vectors")
    return read_kb(spark, f"{out}/vectors")


def build_kb_vectors(kb: DataFrame, **kwargs: object) -> DataFrame:
    """Embed title and description of every ticket and normalise the vectors."""
    texts = kb.withColumn("__embed", embed_text(F.col("title"), F.col("description")))
    return build_vector_table(embed_corpus(texts, "__embed", **kwargs)).drop("__embed")
