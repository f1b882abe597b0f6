"""Raw ticket exports, the knowledge-base table and the train/test splits."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.curation import union_raw
from ..operators.scale import broadcast_if, fits_broadcast
from ..session import materialize
from .csv_split import numbered, records

CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "encoding": "UTF-8",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def list_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> list[str]:
    """Paths below ``path``, sorted.  Only names are read, never contents."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(path).select("path"))
    return sorted(r.path for r in found.collect())


def read_raw_tickets(spark: SparkSession, path: str, multi_line: bool = True,
                     one_header_per_dir: bool = False, order_col: str = "src_ord",
                     split_files: bool = False) -> DataFrame | None:
    """All CSV exports below ``path`` (or one file), united by column name.

    Files are grouped by their header, each group is read with its own all-text
    schema, and the groups are united, so parts may have different extra columns.
    ``order_col`` is the position of a row in the sorted list of files.  ``None``
    when there is no file.

    Only header lines are looked at while planning: one per file, or one per
    folder with ``one_header_per_dir`` (for stores with very many files).  With
    ``multi_line`` (bodies may contain line breaks) one file is one task; use
    ``multi_line=False`` for exports without line breaks so that files are split,
    or ``split_files=True`` to split files with line breaks in quoted fields too
    (see ``csv_split``; quotes must be doubled inside quoted fields).
    """
    if split_files:
        return _read_split(spark, path, order_col)
    files = list_files(spark, path)
    if not files:
        return None
    options = CSV_OPTIONS | {"multiLine": str(multi_line).lower()}
    probe = {(f.rsplit("/", 1)[0] if one_header_per_dir else f): f for f in reversed(files)}
    read_header = lambda f: tuple(spark.read.options(**options).csv(f).columns)
    with ThreadPoolExecutor(16) as pool:
        headers = dict(zip(probe, pool.map(read_header, probe.values()), strict=True))
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for f in files:
        groups[headers[f.rsplit("/", 1)[0] if one_header_per_dir else f]].append(f)
    parts = []
    for header, members in groups.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        parts.append(spark.read.options(**options).schema(schema).csv(members).select(
            *[F.col(f"`{c}`") for c in header],
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__start"),
            F.monotonically_increasing_id().alias("__mid")))
    return _with_positions(union_raw(parts), order_col)


def _read_split(spark: SparkSession, path: str, order_col: str) -> DataFrame | None:
    """All exports with every file cut by many tasks; headers are read in the same pass."""
    rows = materialize(numbered(records(spark, path)), "csv-rows")
    heads = rows.where("row = 0").select("file", F.regexp_replace("record", "\r$", "").alias("header"))
    kinds = sorted(r.header for r in heads.select("header").distinct().collect())  # one per form of export
    if not kinds:
        return None
    options = {k: CSV_OPTIONS[k] for k in ("escape", "quote", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace")}
    data = rows.where("row > 0").join(broadcast_if(heads, fits_broadcast(heads)), "file")
    parts = []
    for header in kinds:
        names = next(csv.reader([header]))
        fields = ", ".join(f"`{c}` STRING" for c in names)
        record = F.from_csv(F.regexp_replace("record", "\r$", ""), fields, options)
        parts.append(data.where(F.col("header") == header).select(
            record.alias("r"), (F.col("base") + F.col("row") - 1).cast("bigint").alias("__ord"))
            .select(*[F.col(f"r.`{c}`") for c in names], "__ord"))
    return union_raw(parts).withColumnRenamed("__ord", order_col)


def _with_positions(rows: DataFrame, out: str) -> DataFrame:
    """Positions over (file, split, row), summed up from counts per split."""
    splits = rows.groupBy("__file", "__start").agg(
        F.min("__mid").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = (Window.unboundedPreceding, -1)
    files = splits.groupBy("__file").agg(F.sum("__n").alias("__fn")).withColumn(
        "__fbase", F.coalesce(F.sum("__fn").over(Window.orderBy("__file").rowsBetween(*before)), F.lit(0)))
    inside = Window.partitionBy("__file").orderBy("__start").rowsBetween(*before)
    bases = (splits.withColumn("__sbase", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
             .join(files, "__file")
             .select("__file", "__start", (F.col("__fbase") + F.col("__sbase") - F.col("__first"))
                     .alias("__shift")))
    # One row per input split; counted before it is broadcast.
    small = fits_broadcast(splits)
    return (rows.join(broadcast_if(bases, small), ["__file", "__start"])
            .withColumn(out, (F.col("__mid") + F.col("__shift")).cast("bigint"))
            .drop("__file", "__start", "__mid", "__shift"))


def write_kb(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the knowledge base as parquet (default) or CSV."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Write train and test rows into one table partitioned by ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_kb(spark: SparkSession, path: str,
            required: Sequence[str] = ("title", "description", "category"),
            fmt: str = "parquet", split: str | None = None) -> DataFrame:
    """Read a knowledge base or one of its splits; fail early without a required column."""
    reader = spark.read.options(**(CSV_OPTIONS | {"multiLine": "true"})) if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the required columns {missing}")
    return df if split is None else df.where(F.col("split") == split)
