"""Rows deleted from a folder of parquet files by rewriting only the files that hold them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import broadcast_if, fits_broadcast

_LIST = "file string, version bigint"


def _listed(spark: SparkSession, path: str) -> tuple[int, list[str] | None]:
    """Number and files of the newest list; 0 and None while nothing was ever deleted."""
    try:
        lists = spark.read.schema(_LIST).parquet(f"{path}/_live")
    except AnalysisException:
        return 0, None
    newest = lists.agg(F.max("version")).first()[0]
    if newest is None:
        return 0, None
    return newest, [r.file for r in lists.where((F.col("version") == newest) & (F.col("file") != "")).collect()]


def _read_files(spark: SparkSession, path: str, files: Sequence[str]) -> DataFrame:
    schema = spark.read.parquet(path).schema
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(unquote(f) for f in files))


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an unpartitioned parquet folder without those that :func:`delete_rows` removed."""
    _, files = _listed(spark, path)
    return spark.read.parquet(path) if files is None else _read_files(spark, path, files)


def delete_rows(spark: SparkSession, path: str, ids: DataFrame, key: str = "conversation_id") -> list[str]:
    """Delete the rows whose ``key`` is among ``ids``; returns the files that hold none of the rest any more.

    One scan of the key column finds the files concerned; only these are read
    whole, and their other rows are written to new files beside them.  Then a
    list of the files that count is written as a single file, which appears at
    once or not at all: a job that dies before leaves the table as it was, and
    readers see the rows from before or after, never between.  Files without a
    deleted row keep their names and bytes.  Only names of files pass the
    driver.  The replaced files stay for readers that still hold the former
    list; the caller removes them when these are done.  Files appended to the
    folder itself after a deletion are not in the list: call :func:`add_files`.
    A NULL id matches nothing.  One writer at a time.
    """
    version, files = _listed(spark, path)
    live = spark.read.parquet(path).inputFiles() if files is None else files
    gone = ids.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    gone = broadcast_if(gone, fits_broadcast(gone))
    rows = _read_files(spark, path, live)
    if not live:
        return []
    touched = [r[0] for r in rows.select(key, F.col("_metadata.file_path").alias("file"))
               .join(gone, key, "left_semi").select("file").distinct().collect()]
    if not touched:
        return []
    rest = f"{path}/rest-{uuid.uuid4().hex}"
    _read_files(spark, path, touched).join(gone, key, "left_anti").select(rows.columns).write.parquet(rest)
    names = {unquote(f).rsplit("/", 1)[-1] for f in touched}
    kept = [f for f in live if unquote(f).rsplit("/", 1)[-1] not in names]
    _write_list(spark, path, version + 1, kept + list(spark.read.parquet(rest).inputFiles()))
    return touched


def add_files(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append rows to a folder, in its list of files where it has one."""
    version, files = _listed(spark, path)
    if files is None:
        rows.write.mode("append").parquet(path)
        return
    more = f"{path}/more-{uuid.uuid4().hex}"
    rows.write.parquet(more)
    _write_list(spark, path, version + 1, files + list(spark.read.parquet(more).inputFiles()))


def _write_list(spark: SparkSession, path: str, version: int, files: Sequence[str]) -> None:
    """The empty name stands for the list itself, so that a list without files is one, too."""
    listed = spark.createDataFrame([(f,) for f in ["", *files]], "file string").coalesce(1)
    listed.write.mode("overwrite").parquet(f"{path}/_live/version={version}")
