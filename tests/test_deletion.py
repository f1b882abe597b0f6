"""Deletion by files: untouched files stay, lists swap at once, nothing else changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from incident_analytics.session import scratch_path
from incident_analytics.sources.deletion import _listed, add_files, delete_rows, read_live


def _table(spark, name):
    path = scratch_path(spark, name) + "/with space"
    rows = spark.range(1000).select("id", F.floor(F.col("id") / 10).alias("conversation_id"), F.lit("x").alias("content"))
    rows.repartitionByRange(10, "id").write.parquet(path)
    return path


def _ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "conversation_id bigint")


def test_only_files_with_deleted_rows_are_replaced(spark):
    path = _table(spark, "delete-files")
    before = set(read_live(spark, path).inputFiles())
    replaced = delete_rows(spark, path, _ids(spark, 3, 4, 77, None, 5000))
    after = set(read_live(spark, path).inputFiles())
    assert len(before) == 10 and len(replaced) == 2 and len(before & after) == 8
    assert {r.id for r in read_live(spark, path).collect()} == set(range(1000)) - {*range(30, 50), *range(770, 780)}

    assert delete_rows(spark, path, _ids(spark, 3)) == [] and _listed(spark, path)[0] == 1
    add_files(spark, path, spark.range(1000, 1010).select("id", F.lit(3).cast("bigint").alias("conversation_id"),
                                                          F.lit("new").alias("content")))
    assert read_live(spark, path).where("conversation_id = 3").count() == 10
    delete_rows(spark, path, _ids(spark, 3, 5))
    assert read_live(spark, path).where("conversation_id IN (3, 5)").count() == 0
    assert read_live(spark, path).count() == 960


def test_a_rest_without_a_list_changes_nothing_and_all_rows_can_go(spark):
    path = _table(spark, "delete-crash")
    spark.range(5).selectExpr("id", "id AS conversation_id", "'half' AS content").write.parquet(f"{path}/rest-broken")
    assert read_live(spark, path).count() == 1000
    delete_rows(spark, path, spark.range(100).withColumnRenamed("id", "conversation_id"))
    assert read_live(spark, path).count() == 0 and read_live(spark, path).columns == ["id", "conversation_id", "content"]
    assert delete_rows(spark, path, _ids(spark, 1)) == []
