from __future__ import annotations

import csv

import pytest
from pyspark.sql import functions as F

from incident_analytics.constants import KB_COLUMNS
from incident_analytics.operators import curation as c
from incident_analytics.operators import sampling as m
from incident_analytics.plans.kb_build import build_kb
from incident_analytics.session import scratch_path
from incident_analytics.sources.tickets import read_kb, read_raw_tickets, write_kb

HEADER = ["Subject", " body", "answer", "type", "QUEUE", "priority", "language", "tag_1", "tag_2"]


def raw_rows():
    """Ten queues of twelve tickets, and one row for each reason to be dropped."""
    rows = []
    for q in range(10):
        for i in range(12):
            n = q * 12 + i
            rows.append([f"Subject {n}", f"Body {n}\nsecond \"line\"", f"Answer {n}", "Incident ", f"Queue {q}", "high",
                         "EN" if n % 2 else "en", "Alpha", "Beta" if n % 2 else "nan"])
    rows.append(["Copy", rows[0][1], "Other answer", "Incident", "Queue 0", "low", "en", "", ""])
    rows.append(["German", "Text", "Antwort", "Incident", "Queue 0", "low", "de", "", ""])
    rows.append(["Blank", "Blank answer", " \t ", "Incident", "Queue 0", "low", "en", "", ""])
    rows.append(["Rare", "Rare body", "Rare answer", "Incident", "Rare queue", "low", "en", "", ""])
    return rows


def write_csv(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *rows])


def exports(tmp_path):
    rows = raw_rows()
    write_csv(tmp_path / "v1" / "a.csv", HEADER, rows[:70])
    write_csv(tmp_path / "v2" / "b.csv", [*HEADER, "extra"], [[*r, "x"] for r in rows[70:]])
    return rows


def test_read_raw_tickets_unites_parts_in_file_order(spark, tmp_path):
    rows = exports(tmp_path)
    df = read_raw_tickets(spark, str(tmp_path))
    assert df.count() == len(rows)
    assert "extra" in df.columns
    got = [r["Subject"] for r in df.orderBy("src_ord").collect()]
    assert got == [r[0] for r in rows]
    assert [r.src_ord for r in df.orderBy("src_ord").collect()] == list(range(len(rows)))
    single = read_raw_tickets(spark, str(tmp_path / "v1" / "a.csv"))
    assert single.count() == 70


def test_read_raw_tickets_of_an_empty_folder(spark, tmp_path):
    assert read_raw_tickets(spark, str(tmp_path)) is None


def test_curate_golden(spark, tmp_path):
    exports(tmp_path)
    kb = c.curate(read_raw_tickets(spark, str(tmp_path)), "src_ord")
    assert kb.columns == list(KB_COLUMNS)
    rows = kb.orderBy("ticket_id").collect()
    assert len(rows) == 120
    assert rows[0].ticket_id == "TKT-00001" and rows[-1].ticket_id == "TKT-00120"
    assert {r.tags for r in rows} == {"Alpha", "Alpha|Beta"}
    assert rows[0].title == "Subject 0" and rows[0].type == "Incident"
    assert {r.category for r in rows} == {f"Queue {i}" for i in range(10)}


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([("x",)], "subject string")
    with pytest.raises(ValueError, match="answer"):
        c.normalize_columns(df)


def test_dedup_keeps_the_first_of_very_many_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 1, "copy").otherwise(
        F.concat(F.lit("b"), "id")).alias("body")).repartition(11)
    got = c.dedup_by_body(df, "ord")
    assert got.count() == 2001
    assert got.where("body = 'copy'").first().ord == 1


def kb120(spark):
    return spark.range(120).select(F.format_string("T%03d", "id").alias("ticket_id"),
                                   F.concat(F.lit("Queue "), F.col("id") % 10).alias("category"),
                                   F.lit("t").alias("title"), F.lit("d").alias("description"))


def test_split_golden_and_independent_of_partitions(spark):
    def test_ids(df):
        return sorted(r.ticket_id for r in m.stratified_split(df).where("split = 'test'").collect())

    first = test_ids(kb120(spark))
    assert len(first) == 20
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert test_ids(kb120(spark).repartition(13)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    split = m.stratified_split(kb120(spark))
    per = split.where("split = 'test'").groupBy("category").count().collect()
    assert {r["count"] for r in per} == {2} and len(per) == 10
    checks = m.split_checks(kb120(spark), split.where("split = 'train'"), split.where("split = 'test'")).first()
    assert checks.asDict() == {"overlap": 0, "lost": 0, "invented": 0}


def sized(spark, *sizes):
    rows = [(f"c{i}-{j}", f"c{i}", "Title", "Body") for i, n in enumerate(sizes) for j in range(n)]
    return spark.createDataFrame(rows, "ticket_id string, category string, title string, description string")


def class_counts(df):
    return [r["count"] for r in df.groupBy("category").count().orderBy("category").collect()]


def test_balance_golden(spark):
    assert class_counts(m.balance_to_median(sized(spark, 40, 10, 20, 30))) == [25, 10, 20, 25]


@pytest.mark.parametrize(("cap", "want"), [(40, [10] * 4), (0, [20] * 4), (500, [20] * 4)])
def test_cap_golden(spark, cap, want):
    assert class_counts(m.stratified_cap(sized(spark, 20, 20, 20, 20), cap)) == want


def test_cap_keeps_one_of_a_small_class_but_sample_may_not(spark):
    df = sized(spark, 1, 999)
    assert class_counts(m.stratified_cap(df, 10)) == [1, 10]
    assert class_counts(m.kb_sample(df, 10)) == [10]
    assert m.kb_sample(df, 0).count() == 1000


def test_training_set_golden(spark):
    df = sized(spark, 5, 5, 5, 5).replace({"c0": "IT Support", "c1": "HR", "c2": "Sales", "c3": "Legal"}, subset="category")
    got = m.training_set(df, ["IT Support", "HR"], max_rows=0).collect()
    assert len(got) == 10
    assert {(r.category, r.label_id) for r in got} == {("HR", 0), ("IT Support", 1)}
    assert {r.text for r in got} == {"Title. Body"}
    own = m.training_set(df, None, max_rows=0)
    assert {(r.category, r.label_id) for r in own.collect()} == {
        ("HR", 0), ("IT Support", 1), ("Legal", 2), ("Sales", 3)}


def test_combined_quota_equals_balance_then_cap(spark):
    df = sized(spark, 40, 10, 20, 30)
    one = m.training_set(df, None, max_rows=33, balanced=True).select("ticket_id")
    two = m.stratified_cap(m.balance_to_median(df), 33).select("ticket_id")
    assert one.exceptAll(two).count() == 0 and one.count() == two.count()


def test_build_kb_writes_all_tables(spark, tmp_path):
    exports(tmp_path)
    out = scratch_path(spark, "kb-build")
    vectors = build_kb(spark, str(tmp_path), out, kb_rows=60)
    assert vectors.count() == 60
    assert len(vectors.first().embedding) == 384
    assert read_kb(spark, f"{out}/splits", split="test").count() == 20
    assert read_kb(spark, f"{out}/splits", split="train").count() == 100


def test_kb_as_csv_and_required_columns(spark):
    path = scratch_path(spark, "kb-csv")
    df = kb120(spark)
    write_kb(df, path, "csv")
    assert read_kb(spark, path, fmt="csv").count() == 120
    with pytest.raises(ValueError, match="resolution"):
        read_kb(spark, path, ["resolution"], "csv")


def test_labels_come_from_the_first_source_that_has_any(spark):
    table = lambda *names: spark.createDataFrame([(n,) for n in names], "category string")
    pairs = lambda df: sorted((r.label_id, r.label) for r in df.collect())
    empty, train = table().limit(0), table("b", "a", None, "b")
    saved = table("z", "y").withColumnRenamed("category", "name")
    assert pairs(m.resolve_labels(spark, saved, train)) == [(0, "y"), (1, "z")]
    assert pairs(m.resolve_labels(spark, empty, train)) == [(0, "a"), (1, "b")]
    assert pairs(m.resolve_labels(spark, empty, table(None), ["q", "p"])) == [(0, "p"), (1, "q")]
    assert pairs(m.resolve_labels(spark, default=["only"])) == [(0, "only")]
