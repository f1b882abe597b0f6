"""TTL replay: goldens, brute force, the path for hot keys, and the stream."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from incident_analytics.operators import cache_ttl
from incident_analytics.operators.cache_ttl import cache_table, ttl_requests
from incident_analytics.operators.opslog import cache_stats
from incident_analytics.session import scratch_path
from incident_analytics.streaming.ttl_stream import ttl_requests_batches, ttl_requests_stream

START = dt.datetime(2024, 1, 1)


def replay(rows, ttl):
    """Row-by-row replay: rows are (id, key, micros, succeeded)."""
    created, out = {}, {}
    for i, key, us, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        out[i] = key in created and us - created[key] <= ttl
        if not out[i] and ok:
            created[key] = us
    return out


def frame(spark, rows):
    data = [(i, k, START + dt.timedelta(microseconds=us), ok) for i, k, us, ok in rows]
    return spark.createDataFrame(data, "id bigint, key string, ts timestamp_ntz, ok boolean").repartition(5)


def hits(df):
    return {r.id: r.hit for r in df.collect()}


def test_golden_miss_then_two_hits(spark):
    rows = [(1, "a", 0, True), (2, "a", 1_000_000, True), (3, "a", 2_000_000, True)]
    done = ttl_requests(frame(spark, rows), ["key"], 3600)
    assert hits(done) == {1: False, 2: True, 3: True}
    assert cache_stats(cache_table(done, ["key"])).first().asDict() == {"entries": 1, "total_hits": 2}
    assert hits(ttl_requests(frame(spark, rows), ["key"], 0)) == {1: False, 2: False, 3: False}


def _rows(seed, n=300):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 1, 5, 40, 700]) * 1000
        rows.append((i, rng.choice(["hot", "hot", "hot", "cold", f"k{i % 9}"]), t, rng.random() > 0.3))
    return rows


@pytest.mark.parametrize("limit", [10_000, 60])
def test_equals_replay_also_for_hot_keys(spark, limit):
    rows = [(i, k, us, True) for i, k, us, _ in _rows(1)]
    got = hits(ttl_requests(frame(spark, rows), ["key"], 2, max_key_rows=limit))
    assert got == replay(rows, 2_000_000)


def test_hot_key_on_a_regular_grid(spark):
    """Requests at exact multiples of the lifetime, and densely in between."""
    rows = [(i, "hot", i * 250_000, True) for i in range(60)]
    got = hits(ttl_requests(frame(spark, rows), ["key"], 1, max_key_rows=20))
    assert got == replay(rows, 1_000_000)


def test_failed_misses_do_not_fill_the_cache(spark):
    rows = _rows(2)
    got = hits(ttl_requests(frame(spark, rows), ["key"], 2, succeeded="ok"))
    assert got == replay(rows, 2_000_000)


def test_stream_in_several_batches_equals_batch(spark):
    rows = [(i, k, us, True) for i, k, us, _ in _rows(4)]
    path = scratch_path(spark, "ttl-files")
    df = frame(spark, rows).withColumn("ts", F.col("ts").cast("timestamp"))
    for lo in (0, 100, 200):
        df.where(F.col("id").between(lo, lo + 99)).coalesce(1).write.mode("append").parquet(path)
    out = scratch_path(spark, "ttl-out")
    stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
              .parquet(path))
    query = (ttl_requests_stream(stream, ["key"], 2).writeStream.format("parquet").option("path", f"{out}/rows")
             .option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start())
    query.awaitTermination()
    assert hits(spark.read.parquet(f"{out}/rows")) == replay(rows, 2_000_000)


def test_null_key_parts_keep_their_place(spark):
    df = spark.createDataFrame([(1, None, "a", 0), (2, "a", None, 1), (3, None, "a", 2)],
                               "id bigint, x string, y string, s int") \
        .select("id", "x", "y", F.timestamp_seconds("s").alias("ts"))
    assert {r.id: r.hit for r in ttl_requests(df, ["x", "y"]).collect()} == {1: False, 2: False, 3: True}


def test_thousand_lifetimes_of_a_hot_key_take_few_rounds(spark, monkeypatch):
    """Bursts, gaps and a dense stretch: links between blocks double, whatever the number of lifetimes."""
    written = []
    write = cache_ttl.materialize
    monkeypatch.setattr(cache_ttl, "materialize", lambda df, name: written.append(name) or write(df, name))
    rng = random.Random(7)
    rows, t = [], 0
    for i in range(6000):
        t += rng.choice([1, 1, 90_000, 400_000, 3_000_000]) if i < 3000 else 250_000
        rows.append((i, "hot", t, True))
    rows += [(6000 + i, "warm", i * 70_000, True) for i in range(400)]
    expected = replay(rows, 1_000_000)
    assert sum(not hit for hit in expected.values()) > 1000
    assert hits(ttl_requests(frame(spark, rows), ["key"], 1, max_key_rows=300)) == expected
    assert written.count("ttl-jumps") <= 8


def test_batches_with_a_busy_key_and_late_rows_equal_a_plain_replay(spark):
    """Five shuffled batches; the busy key is cut into blocks, entries expire, old and untimed rows miss."""
    rows = [(i, k, us, True) for i, k, us, _ in _rows(9, 500)]
    rng = random.Random(3)
    dealt = [[] for _ in range(5)]
    for r in rows:
        dealt[min(4, max(0, r[0] // 100 + rng.choice([0, 0, 0, 1])))].append(r)
    path, out = scratch_path(spark, "ttl-files"), scratch_path(spark, "ttl-batches")
    created, latest, expected = {}, 0, {-7: False}
    for batch in dealt:
        df = frame(spark, batch).withColumn("ts", F.col("ts").cast("timestamp"))
        if batch is dealt[2]:
            df = df.unionByName(spark.createDataFrame([(-7, "hot", None, True)], df.schema))
        df.coalesce(1).write.mode("append").parquet(path)
        for i, key, us, _ in sorted(batch, key=lambda r: (r[2], r[0])):
            expected[i] = key in created and 0 <= us - created[key] <= 2_000_000
            if key not in created or us - created[key] > 2_000_000:
                created[key] = us
        latest = max([latest, *(r[2] for r in batch)])
        created = {k: c for k, c in created.items() if c + 2_000_000 + 1_000_000 >= latest}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    done = ttl_requests_batches(stream, ["key"], out, 2, delay="1 second", max_key_rows=40)
    assert hits(done) == expected
    assert hits(ttl_requests_batches(stream, ["key"], out, 2, delay="1 second")) == expected  # nothing new
