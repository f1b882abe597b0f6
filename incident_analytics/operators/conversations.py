"""Threads and messages: indexes, recency lists, ordered threads, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_TITLE
from ..functions.logs import day_bucket
from ..functions.text import thread_title
from .scale import sequence_numbers

BUCKETS = ("Today", "Yesterday", "Previous 7 days", "Older")


def conversation_index(messages: DataFrame) -> DataFrame:
    """One row per thread: title of its first user message, first and last time.

    Titles are cut to their final length before the aggregation, so the partial
    aggregates stay narrow and a very long thread costs one row per task.
    """
    user = F.col("role") == "user"
    narrow = messages.select(
        "conversation_id", "ts", F.when(user, F.col("id")).alias("__uid"),
        F.when(user, thread_title(F.col("content"))).alias("__title"))
    return narrow.groupBy("conversation_id").agg(
        F.coalesce(F.min_by("__title", "__uid"), F.lit(DEFAULT_TITLE)).alias("title"),
        F.min("ts").alias("created_ts"), F.max("ts").alias("updated_ts"))


def recent_conversations(conversations: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` threads by last update; ties by id."""
    return conversations.orderBy(F.desc("updated_ts"), "conversation_id").limit(n)


def conversations_grouped(conversations: DataFrame, as_of: Column, n: int = 50) -> DataFrame:
    """The newest ``n`` threads with their day bucket, buckets in fixed order."""
    bucket = day_bucket(F.col("updated_ts"), as_of)
    order = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket"))
    return (recent_conversations(conversations, n).withColumn("bucket", bucket)
            .withColumn("bucket_no", order.cast("int"))
            .orderBy("bucket_no", F.desc("updated_ts"), "conversation_id"))


def messages_in_order(messages: DataFrame, conversation_id: object | None = None) -> DataFrame:
    """Messages with their position in the thread (from 1), of one thread or of all."""
    rows = messages if conversation_id is None else messages.where(
        F.col("conversation_id") == conversation_id)
    return sequence_numbers(rows, "id", ["conversation_id"], out="position")


def thread_messages(messages: DataFrame, page_size: int = 1000) -> DataFrame:
    """Threads as ordered arrays of messages, in pages of at most ``page_size``.

    A thread of ordinary length is one row (page 0); a huge one becomes several,
    so that no row or task ever holds a whole huge thread.
    """
    placed = messages_in_order(messages).withColumn(
        "page", F.floor((F.col("position") - 1) / page_size))
    meta = F.col("meta_json") if "meta_json" in messages.columns else F.lit(None).cast("string")
    entry = F.struct("position", "role", "content", F.try_parse_json(meta).alias("meta"), "ts")
    # A message's position is unique in its page, so sorting by it never compares the rest.
    ordered = F.array_sort(F.collect_list(entry), lambda a, b: (a["position"] - b["position"]).cast("int"))
    return placed.groupBy("conversation_id", "page").agg(ordered.alias("messages"))


def delete_threads(conversations: DataFrame, messages: DataFrame,
                   ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given threads."""
    gone = ids.select("conversation_id").distinct()
    return (conversations.join(gone, "conversation_id", "left_anti"),
            messages.join(gone, "conversation_id", "left_anti"))
