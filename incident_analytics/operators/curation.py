"""From raw ticket exports to a clean, de-duplicated knowledge base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DATASET_LANGUAGE, RAW_TICKET_COLUMNS, TOP_QUEUES
from ..functions.text import is_filled, joined_tags, strip_all, stripped
from ..session import materialize
from .scale import BROADCAST_ROWS, sequence_numbers

TEXT_COLUMNS = ("subject", "body", "answer", "queue")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case and trim the column names; name the required ones that are missing."""
    renamed = df.withColumnsRenamed({c: c.lower().strip() for c in df.columns})
    missing = sorted(set(RAW_TICKET_COLUMNS) - set(renamed.columns))
    if missing:
        raise ValueError(f"raw tickets lack the columns {missing}; found {df.columns}")
    return renamed


def union_raw(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate exports by column name; columns a part lacks become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def tickets_lang_filter(df: DataFrame, lang: str = DATASET_LANGUAGE) -> DataFrame:
    """Keep one language, ignoring case; NULL never matches."""
    return df.where(F.lower("language") == lang.lower())


def tickets_nonempty(df: DataFrame) -> DataFrame:
    """Strip subject, body, answer and queue and drop rows where one is empty or 'nan'."""
    out = df.withColumns({c: stripped(F.col(c)) for c in TEXT_COLUMNS})
    for c in TEXT_COLUMNS:
        out = out.where(is_filled(F.col(c)))
    return out


def dedup_by_body(df: DataFrame, order_col: str, body: str = "body") -> DataFrame:
    """Keep the first row, in ``order_col`` order, of every distinct body.

    The first position per body is a map-side combined minimum over narrow rows,
    so a body copied into a third of the table costs one row per task; the wide
    rows move only in the semi-join, on (body hash, position), which is unique.
    """
    # A NULL body is a body of its own; no sha-256 equals the marker.
    keyed = df.withColumn("__body", F.coalesce(F.sha2(F.col(body), 256), F.lit("null")))
    first = keyed.groupBy("__body").agg(F.min(order_col).alias(order_col))
    return keyed.join(first, ["__body", order_col], "left_semi").drop("__body")


def queue_distribution(df: DataFrame, column: str = "category") -> DataFrame:
    """Rows per queue, largest first."""
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy(F.desc("n_rows"), column))


def top_queues(df: DataFrame, n: int = TOP_QUEUES, column: str = "queue") -> DataFrame:
    """Keep the rows of the ``n`` most frequent queues; ties go to the smaller name."""
    best = (df.where(F.col(column).isNotNull())
            .groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
            .orderBy(F.desc("__n"), column).limit(n).select(column))
    # At most n rows by construction.
    side = F.broadcast(best) if n <= BROADCAST_ROWS else best
    return df.join(side, column, "left_semi")


def ticket_tags(df: DataFrame) -> DataFrame:
    """Add the pipe-joined ``tags`` of whichever of tag_1..tag_8 exist."""
    return df.withColumn("tags", joined_tags(df.columns))


def kb_projection(df: DataFrame, order_col: str, prefix: str = "TKT-") -> DataFrame:
    """Rename to the knowledge-base schema and number tickets in source order.

    NULL type and priority stay NULL.
    """
    tagged = df if "tags" in df.columns else ticket_tags(df)
    return _kb_columns(sequence_numbers(tagged, order_col, out="__seq"), prefix)


def _kb_columns(numbered: DataFrame, prefix: str) -> DataFrame:
    return numbered.select(
        F.format_string(f"{prefix}%05d", F.col("__seq")).alias("ticket_id"),
        F.col("subject").alias("title"), F.col("body").alias("description"),
        F.col("answer").alias("resolution"), F.col("queue").alias("category"),
        strip_all(F.col("type")).alias("type"), strip_all(F.col("priority")).alias("priority"),
        "tags")


def curate(df: DataFrame, order_col: str, lang: str = DATASET_LANGUAGE,
           queues: int = TOP_QUEUES, prefix: str = "TKT-") -> DataFrame:
    """The whole curation: language, filled text, first copy, top queues, schema.

    The exports are parsed and cleaned once and written to the shared folder.
    Which rows survive, and their numbers, is then decided on three narrow columns
    (position, body hash, queue); the text moves once, in the final join on the
    unique position.
    """
    clean = ticket_tags(tickets_nonempty(tickets_lang_filter(normalize_columns(df), lang)))
    clean = materialize(clean.withColumn("__body", F.sha2("body", 256)), "curate-clean")
    firsts = clean.groupBy("__body").agg(F.min(order_col).alias(order_col),
                                         F.min_by("queue", order_col).alias("queue"))
    kept = materialize(top_queues(firsts, queues).select(order_col), "curate-kept")
    numbers = sequence_numbers(kept, order_col, out="__seq")
    return _kb_columns(clean.join(numbers, order_col), prefix)
