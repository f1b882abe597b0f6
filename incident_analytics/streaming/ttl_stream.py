"""TTL cache decisions on a stream: one small state per key, or whole micro-batches replayed as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import CACHE_TTL_SECONDS
from ..operators.cache_ttl import MAX_KEY_ROWS, entry_key, ttl_requests
from ..session import materialize

#: Stands for the live entry among the requests of a batch; smaller than any id.
_ENTRY_ID = -(1 << 63)


def ttl_requests_stream(stream: DataFrame, keys: Sequence[str], ttl_seconds: int = CACHE_TTL_SECONDS,
                        ts: str = "ts", id_col: str = "id", delay: str = "2 minutes") -> DataFrame:
    """(id, hit) per request: the streaming twin of ``ttl_requests``.

    State per key: creation time of the live entry and the hits so far.  It times
    out when the watermark passes the end of the entry, so idle keys cost nothing.
    Rows are taken in time order inside a micro-batch (its size bounds what one
    task holds); a row that arrives after a later one was decided does not change
    that decision.  A row older than the creation of the live entry is a miss, as
    the entry did not exist yet, and leaves the entry as it is.
    """
    ttl = int(ttl_seconds * 1_000_000)

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        created, hits = state.get if state.exists else (None, 0)
        parts = [(b["__us"].to_numpy(dtype=np.int64), b["__id"].to_numpy(dtype=np.int64)) for b in batches]
        us, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, us))
        us, ids = us[order], ids[order]
        hit = np.ones(len(us), dtype=bool)
        at = 0
        if created is not None:
            hit[:np.searchsorted(us, created)] = False
            at = int(np.searchsorted(us, created + ttl, side="right"))
        while at < len(us):
            hit[at], created = False, int(us[at])
            at = int(np.searchsorted(us, created + ttl, side="right"))
        state.update((created, hits + int(hit.sum())))
        ends_ms = (created + ttl) // 1000 + 1
        state.setTimeoutTimestamp(max(ends_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({id_col: ids, "hit": hit})

    keyed = (stream.withWatermark(ts, delay)
             .withColumn("__key", entry_key(keys))
             .select("__key", F.col(id_col).cast("bigint").alias("__id"), ts,
                     F.unix_micros(ts).alias("__us")))
    return keyed.groupBy("__key").applyInPandasWithState(
        decide, f"{id_col} bigint, hit boolean", "created bigint, hits bigint", "append",
        GroupStateTimeout.EventTimeTimeout)


def ttl_requests_batches(stream: DataFrame, keys: Sequence[str], path: str, ttl_seconds: int = CACHE_TTL_SECONDS,
                         ts: str = "ts", id_col: str = "id", delay: str = "2 minutes",
                         max_key_rows: int = MAX_KEY_ROWS) -> DataFrame:
    """(id, hit) per request, for streams in which one key can fill a micro-batch.

    Every micro-batch is replayed by the batch operator, with the live entry of a
    key as its first request, so a key of any size is cut into blocks and no task
    holds all its rows.  ``path`` (a folder all executors reach) keeps the
    decisions, the live entries and the checkpoint; a later call continues there.
    A batch writes under its number, so one that is run again replaces what it
    wrote.  A row older than the live entry, or without a time, is a miss and
    leaves the entry as it is.  An entry is dropped once it ended ``delay`` before
    the latest time seen.  Processes what is available.
    """
    spark = stream.sparkSession
    decided, live = f"{path}/decided", f"{path}/live"
    latest_schema, live_schema = "latest timestamp", "entry string, created timestamp"

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession

        def before(folder: str, schema: str) -> DataFrame:
            if number == 0:
                return session.createDataFrame([], schema)
            return session.read.schema(schema).parquet(f"{path}/{folder}/batch={number - 1}")

        rows = materialize(batch.select(entry_key(keys).alias("entry"), F.col(id_col).cast("bigint").alias("id"),
                                        F.col(ts).cast("timestamp").alias("ts")), "ttl-batch")
        entries = before("live", live_schema)
        known = rows.join(entries, "entry", "left")
        early = F.col("ts").isNull() | F.coalesce(F.col("ts") < F.col("created"), F.lit(False))
        present = rows.select("entry").distinct()
        first = entries.join(present, "entry", "left_semi").select(
            "entry", F.lit(_ENTRY_ID).alias("id"), F.col("created").alias("ts"))
        events = known.where(~early).select("entry", "id", "ts").unionByName(first)
        replayed = materialize(ttl_requests(events, ["entry"], ttl_seconds, max_key_rows=max_key_rows), "ttl-replayed")
        (replayed.where(F.col("id") != _ENTRY_ID).select("id", "hit")
         .unionByName(known.where(early).select("id", F.lit(False).alias("hit")))
         .write.mode("overwrite").parquet(f"{decided}/batch={number}"))

        latest = materialize(rows.agg(F.max("ts").alias("latest")).unionByName(before("latest", latest_schema))
                             .agg(F.max("latest").alias("latest")), "ttl-latest")
        created = replayed.groupBy("entry").agg(F.max(F.when(~F.col("hit"), F.col("ts"))).alias("created"))
        kept = created.unionByName(entries.join(present, "entry", "left_anti"))
        ends = F.col("created") + F.make_dt_interval(secs=F.lit(ttl_seconds)) + F.expr(f"INTERVAL {delay}")
        (kept.join(F.broadcast(latest)).where(ends >= F.col("latest")).select("entry", "created")
         .write.mode("overwrite").parquet(f"{live}/batch={number}"))
        latest.write.mode("overwrite").parquet(f"{path}/latest/batch={number}")

    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    try:
        return spark.read.schema("id bigint, hit boolean").parquet(decided).select(F.col("id").alias(id_col), "hit")
    except AnalysisException:  # never a batch
        return spark.createDataFrame([], f"{id_col} bigint, hit boolean")
