"""Incremental versions of the log reports (Structured Streaming, append mode).

``ts`` must be a TIMESTAMP (cast TIMESTAMP_NTZ first; pin the session time zone).
A window is emitted once the watermark has passed its end; later rows are dropped
by the watermark and show up in the query's progress metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.opslog import no_feedback, total_cost
from ..session import scratch_path

DELAY = "2 minutes"


def window_bounds(df: DataFrame) -> DataFrame:
    """The column ``window`` as plain ``window_start`` and ``window_end``."""
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("window.end").cast("timestamp_ntz").alias("window_end"), *rest)


def _rates() -> list[Column]:
    n = F.count(F.lit(1))
    return [
        n.alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        total_cost().alias("cost_usd"),
        F.round(F.count_if(F.col("status") == "error") / n, 4).alias("error_rate"),
        F.round(F.count_if(F.col("cache_hit") == 1) / n, 4).alias("cache_hit_rate")]


def request_volume_stream(stream: DataFrame, bucket: str = "1 minute", delay: str = DELAY) -> DataFrame:
    """Calls per tumbling window and subtask, without feedback."""
    return window_bounds(no_feedback(stream).withWatermark("ts", delay)
                   .groupBy(F.window("ts", bucket), "subtask").agg(F.count(F.lit(1)).alias("calls")))


def ops_summary_stream(stream: DataFrame, bucket: str = "1 hour", delay: str = DELAY,
                       accuracy: int = 1000) -> DataFrame:
    """Rates and totals per tumbling window and subtask.

    Percentiles come from a mergeable sketch, so the state per group is bounded
    (rank error at most 1/accuracy); the batch report is exact.
    """
    tails = [F.percentile_approx("latency_ms", p, accuracy).alias(name)
             for name, p in (("latency_p50_ms", 0.5), ("latency_p95_ms", 0.95))]
    return window_bounds(stream.withWatermark("ts", delay)
                   .groupBy(F.window("ts", bucket), "subtask").agg(*_rates(), *tails))


def trailing_summary_stream(stream: DataFrame, span: str = "6 hours", slide: str = "1 hour",
                            delay: str = DELAY) -> DataFrame:
    """The totals of the last ``span``, renewed every ``slide``."""
    return window_bounds(stream.withWatermark("ts", delay).groupBy(F.window("ts", span, slide)).agg(*_rates()))


def run_available(stream: DataFrame, name: str, state_partitions: int | None = None) -> DataFrame:
    """Process what is available into a parquet table in the shared folder and read it back.

    State is kept in as many partitions as the cluster has cores unless given:
    the number is fixed when a query starts, and every micro-batch opens them all.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions or spark.sparkContext.defaultParallelism))
    try:
        query: StreamingQuery = (
            stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/rows")
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
