"""Streams in several micro-batches against the batch reports, late rows, the log sink."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from incident_analytics.catalog import bindings as b
from incident_analytics.operators import opslog as o
from incident_analytics.session import scratch_path
from incident_analytics.sources.stores import (append_request_log, append_request_log_stream, read_request_log,
                                               read_training_log, request_log_rows, store_inventory)
from incident_analytics.streaming.ops_stream import ops_summary_stream, request_volume_stream, run_available


def parted(spark, sf, pieces=4):
    """The log as a folder of files in time order, and a stream that reads one file per batch."""
    path = scratch_path(spark, "log-files")
    log = b.request_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    n = log.count()
    for i in range(pieces):
        log.where((F.col("id") >= i * n // pieces) & (F.col("id") < (i + 1) * n // pieces)).coalesce(1) \
            .write.mode("append").parquet(path)
    return log, spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_in_many_batches_equal_the_batch_report(spark, sf):
    log, stream = parted(spark, sf)
    got = run_available(request_volume_stream(stream, "6 hours"), "t-volume")
    want = o.no_feedback(log).groupBy(F.window("ts", "6 hours"), "subtask").agg(F.count(F.lit(1)).alias("calls")).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), "subtask", "calls", "window.end")
    mark = o.no_feedback(log).agg(F.max("ts")).first()[0] - dt.timedelta(minutes=2)
    closed = want.where(F.col("end") <= F.lit(mark)).drop("end")
    seen = got.select("window_start", "subtask", "calls")
    assert seen.exceptAll(closed).count() == 0 and seen.count() == closed.count() > 100


def test_late_rows_are_dropped_and_counted(spark):
    t = dt.datetime(2024, 1, 1)
    path = scratch_path(spark, "late")
    schema = ("ts timestamp, subtask string, tokens_in bigint, tokens_out bigint, cost_usd double, status string, "
              "cache_hit int, latency_ms double")
    row = lambda hours: (t + dt.timedelta(hours=hours), "a", 1, 1, 0.0, "ok", 0, 1.0)
    for hours in ([0.1, 0.2], [5, 5.1], [6, 6.1], [0.3, 9]):
        spark.createDataFrame([row(h) for h in hours], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    base = scratch_path(spark, "late-out")
    query = (ops_summary_stream(stream).writeStream.format("parquet").option("path", f"{base}/rows")
             .option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start())
    query.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    rows = spark.read.parquet(f"{base}/rows").orderBy("window_start").collect()
    assert dropped >= 1
    assert [r.requests for r in rows] == [2, 2, 2]


def test_log_sink_as_stream(spark, sf):
    log, stream = parted(spark, sf, 2)
    path = scratch_path(spark, "log-sink")
    append_request_log_stream(stream, path, scratch_path(spark, "log-check")).awaitTermination()
    stored = read_request_log(spark, path)
    assert stored.exceptAll(request_log_rows(log).select(*stored.columns)).count() == 0
    assert stored.count() == log.count()
    since = read_request_log(spark, path, "2024-01-20")
    assert since.count() == log.where("ts >= '2024-01-20'").count()
    plan = since._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    as_of = F.lit("2024-01-31").cast("timestamp")
    dated = o.ops_summary(read_request_log(spark, path, keep_date=True), 3 * 86400, as_of)
    assert dated.collect() == o.ops_summary(log, 3 * 86400, as_of).collect()


def test_training_log_and_inventory(spark, tmp_path):
    (tmp_path / "log.json").write_text(
        '{"hyperparameters": {"epochs": 2}, "train_seconds": 3.5,\n "log_history": [{"epoch": 1, "loss": 2.5}]}')
    row = read_training_log(spark, str(tmp_path / "log.json")).first()
    assert row.train_seconds == 3.5 and row.log_history[0].loss == 2.5 and row.hyperparameters["epochs"] == "2"
    got = store_inventory(spark, {"log": str(tmp_path / "log.json"), "gone": str(tmp_path / "gone")}, "json").collect()
    assert {(r.store, r.present, r.files) for r in got} == {("log", True, 1), ("gone", False, 0)}


def test_repeated_batch_adds_nothing(spark, sf):
    log = b.request_log(spark, sf)
    path = scratch_path(spark, "named-log")
    first, second = log.where("id % 2 = 0"), log.where("id % 2 = 1")
    for rows, batch in ((first, "b1"), (second, "b2"), (first, "b1"), (second, "b2")):
        append_request_log(rows, path, batch)
    stored = read_request_log(spark, path)
    want = request_log_rows(log).select(*stored.columns)
    assert stored.exceptAll(want).count() == 0 and stored.count() == want.count()
    assert read_request_log(spark, path, "2024-01-20").count() == log.where("ts >= '2024-01-20'").count()
