"""Trailing percentiles from stored levels against the sorted values of every window."""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from incident_analytics.session import scratch_path
from incident_analytics.streaming import latency_tails as t
from incident_analytics.streaming.ops_stream import run_available

START = dt.datetime(2024, 3, 1)


def test_tails_of_every_window(spark):
    rng = random.Random(3)
    draw = [lambda: rng.lognormvariate(4, 2), lambda: 0.0, lambda: 25.0, lambda: -rng.random(), lambda: None]
    rows = [(START + dt.timedelta(minutes=m), "ab"[rng.random() < 0.3], rng.choices(draw, [8, 1, 3, 1, 1])[0]())
            for m in sorted(rng.uniform(0, 60 * 30) for _ in range(3000))]
    log = spark.createDataFrame(rows, "ts timestamp, subtask string, latency_ms double")
    path = scratch_path(spark, "tails-log")
    for i in range(3):
        log.where(F.col("ts").between(START + dt.timedelta(hours=10 * i), START + dt.timedelta(hours=10 * i + 10))) \
            .coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stored = run_available(t.latency_histogram_stream(stream), "t-levels").cache()
    assert stored.where("high > 0.001 AND high > low * (1 + 0.01) + 1e-9").count() == 0
    brackets = t.trailing_brackets(stored).cache()
    exact = {(r.window_start, r.subtask): r for r in t.exact_tails(log, brackets).collect()}
    near = {(r.window_start, r.subtask): r for r in t.estimated_tails(brackets).collect()}
    last = stored.agg(F.max("window_end")).first()[0]
    want = {}
    for back in range(-5, 30):
        low = START + dt.timedelta(hours=back)
        if low + dt.timedelta(hours=6) <= last:
            for task in "ab":
                values = sorted(v for ts, s, v in rows if s == task and v is not None
                                and low <= ts < low + dt.timedelta(hours=6))
                if values:
                    want[low, task] = values
    assert set(want) == set(exact) == set(near) and len(want) > 40
    for key, values in want.items():
        p50, p95 = (values[math.ceil(len(values) * p / 100) - 1] for p in (50, 95))
        assert (exact[key].requests, exact[key].p50, exact[key].p95) == (len(values), p50, p95)
        for got, truth in ((near[key].p50, p50), (near[key].p95, p95)):
            assert abs(got - truth) <= abs(truth) * t.ERROR / 2 + t.SMALLEST


def test_levels_rise_with_the_value(spark):
    values = sorted([0.0, 1e-9, 1e-3, 0.5, 1.0, 1.009, 1.02, 1e6, -1e-9, -0.5, -0.51, -1e6])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", t.level(F.col("v")).alias("l"))
    levels = [r.l for r in df.orderBy("v").collect()]
    assert levels == sorted(levels) and levels[0] < 0 < levels[-1]


def test_no_rows_give_no_windows(spark):
    none = spark.createDataFrame([], "window_start timestamp_ntz, window_end timestamp_ntz, subtask string, level int, "
                                     "n bigint, low double, high double")
    assert t.estimated_tails(t.trailing_brackets(none)).count() == 0
