"""Rows that arrive behind the watermark: counted per window instead of vanishing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .ops_stream import DELAY

_LATE = "window_start timestamp, late_rows bigint, latest timestamp, batch bigint"


def count_late_rows(stream: DataFrame, name: str, bucket: str = "1 hour", delay: str = DELAY,
                    ts: str = "ts") -> DataFrame:
    """(window_start, late_rows, latest): rows a windowed report with this watermark would drop.

    The watermark of a micro-batch is the latest time of all batches before it,
    less ``delay``; a row is late when its window ended by then.  Every batch
    writes the counts of its late rows and its own latest time under its number,
    and a batch that is run again replaces what it wrote, so nothing is counted
    twice.  Rows without a time belong to no window.  Processes what is available.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    seen, late = f"{base}/seen", f"{base}/late"

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.where(F.col(ts).isNotNull()).select(F.col(ts).alias("ts"))
        try:
            before = session.read.schema("latest timestamp, batch bigint").parquet(seen).where(F.col("batch") < number)
            latest = before.agg(F.max("latest")).first()[0]
        except AnalysisException:
            latest = None
        if latest is not None:
            mark = F.date_trunc("millisecond", F.lit(latest)) - F.expr(f"INTERVAL {delay}")
            (rows.select(F.window("ts", bucket).alias("w"), "ts").where(F.col("w.end") <= mark)
             .groupBy(F.col("w.start").alias("window_start")).agg(F.count(F.lit(1)).alias("late_rows"),
                                                                 F.max("ts").alias("latest"))
             .write.mode("overwrite").parquet(f"{late}/batch={number}"))
        rows.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{seen}/batch={number}")

    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    try:
        found = spark.read.schema(_LATE).parquet(late)
    except AnalysisException:  # never a second batch
        found = spark.createDataFrame([], _LATE)
    return found.groupBy("window_start").agg(F.sum("late_rows").alias("late_rows"), F.max("latest").alias("latest"))
