"""Leakage report, late rows and split CSV files, beside their SQL twins."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from incident_analytics.operators import leakage
from incident_analytics.plans.kb_build import build_kb
from incident_analytics.session import scratch_path
from incident_analytics.sources import csv_split
from incident_analytics.sources.tickets import read_kb, read_raw_tickets
from incident_analytics.streaming.late import count_late_rows

ROWS = [("a", "one", "x"), ("b", "two", "x"), ("c", None, "x"), ("d", "one", None), (None, "four", "y"), ("e", "five", "y")]
SCHEMA = "ticket_id string, description string, category string"


def test_leakage_by_id_and_text(spark):
    kb = spark.createDataFrame(ROWS, SCHEMA).withColumn("place", F.lit("p"))
    test = spark.createDataFrame([("b", "other", "x"), ("z", "one", "x"), (None, None, "y"), ("b", "again", "x")], SCHEMA)
    for bits in (6, 22):  # a full filter lets everything through to the exact join
        got = {r.category: tuple(r)[1:] for r in leakage.kb_eval_leakage(kb, test, bits=bits).collect()}
        assert got == {"x": (3, 1, 1, 2), None: (1, 0, 1, 1), "y": (2, 0, 0, 0)}
        left = leakage.without_leaked(kb, test, bits=bits)
        assert left.columns == kb.columns
        assert sorted(r.ticket_id or "" for r in left.collect()) == ["", "c", "e"]
    assert leakage.without_leaked(kb, test.limit(0)).count() == len(ROWS)
    plan = leakage.suspects(kb, test, "ticket_id", "description", 22)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_build_kb_without_test_tickets(spark, tmp_path):
    body = lambda i: f"body {i % 37}, with a comma and \"\"quotes\"\"\nand a second line {i % 37}"
    lines = ["subject,body,answer,queue,language,type,priority"] + [
        f'subject {i},"{body(i)}","answer {i}",q{i % 3},en,Incident,low' for i in range(200)]
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    build_kb(spark, str(tmp_path / "raw.csv"), str(tmp_path / "out"), exclude_test=True, split_files=True)
    kb, test = read_kb(spark, f"{tmp_path}/out/kb"), read_kb(spark, f"{tmp_path}/out/splits", split="test")
    assert kb.count() > 10 and test.count() >= 3
    assert kb.join(test, "ticket_id", "left_semi").count() == kb.join(test, "description", "left_semi").count() == 0


def test_late_rows_by_hand(spark):
    t = dt.datetime(2024, 1, 1)
    path = scratch_path(spark, "late-by-hand")
    for minutes in ([5, 50], [59, 125], [10, 61, 70, None], [20, 130, 240]):
        rows = [(None if m is None else t + dt.timedelta(minutes=m),) for m in minutes]
        spark.createDataFrame(rows, "ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.window_start: (r.late_rows, r.latest) for r in count_late_rows(stream, "late-out").collect()}
    # After the second batch the watermark is 2:03: hours 0 and 1 are over.
    at = lambda m: t + dt.timedelta(minutes=m)
    assert got == {at(0): (2, at(20)), at(60): (2, at(70))}


def _file(rng, n, end, extra):
    cells = ["plain", "", "two\nlines", "a \"\"quoted\"\" word", ",", "\n\n", "x" * 50, "é,\n\"\"", " spaced "]
    head = ["subject", "body", "answer"] + (["queue"] if extra else [])
    out = [",".join(head)]
    for i in range(n):
        row = [f'"{rng.choice(cells)}{rng.choice(cells)}"' if rng.random() < 0.8 else f"w{i}" for _ in head]
        out.append(",".join(row))
    return end.join(out) + (end if rng.random() < 0.5 else "")


def test_split_files_equal_the_one_task_reader(spark, tmp_path):
    rng = random.Random(9)
    for i in range(4):
        text = _file(rng, 300, "\r\n" if i == 2 else "\n", i % 2)
        (tmp_path / f"part{i}.csv").write_bytes(text.encode())
    (tmp_path / "empty.csv").write_bytes(b"subject,body,answer\n")
    whole = read_raw_tickets(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = csv_split._lines(spark, str(tmp_path), "*.csv")
        states = csv_split.split_states(lines).collect()
        assert len(states) > 80 and 10 < sum(r.inside for r in states) < len(states)
        got = read_raw_tickets(spark, str(tmp_path), split_files=True)
        cols = ["src_ord", "subject", "body", "answer", "queue"]
        rows = sorted(map(tuple, got.select(cols).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 1200 and rows == sorted(map(tuple, whole.select(cols).collect()))


def test_no_files(spark, tmp_path):
    assert read_raw_tickets(spark, str(tmp_path), split_files=True) is None
