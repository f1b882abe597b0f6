"""Procedures, attachments, the request log, reports and the store inventory."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import REQUEST_LOG_COLUMNS
from ..functions.text import shortened
from ..operators.attachments import extract_attachments

# The files that can be attached.
ATTACHABLE = "*.{txt,log,md,csv,json,pdf,png,jpg,jpeg}"

_STATS = "struct<precision: double, recall: double, f1: double, support: bigint>"
_VARIANT = (f"struct<model_source: string, eval_rows: bigint, accuracy: double, f1_macro: double, "
            f"per_class: map<string, {_STATS}>>")
COMPARISON_SCHEMA = (
    f"base {_VARIANT}, finetuned {_VARIANT}, samples array<struct<text: string, true: string, "
    "base_pred: string, finetuned_pred: string>>")
TRAINING_LOG_SCHEMA = (
    "hyperparameters map<string, string>, train_seconds double, log_history array<struct<"
    "epoch: double, loss: double, eval_loss: double, eval_accuracy: double, "
    "eval_f1_macro: double, train_runtime: double>>")


def read_sops(spark: SparkSession, path: str, pattern: str = "*",
              max_chars: int | None = None) -> DataFrame:
    """One procedure per file as (slug, sop_text), the text cut to ``max_chars`` if given.

    The slug is the file's stem, or the partition value when the store is
    partitioned by ``slug``.
    """
    files = (spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True))
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    slug = F.col("slug").cast("string") if "slug" in files.columns else F.url_decode(stem)
    return files.select(slug.alias("slug"), shortened(F.col("value"), max_chars).alias("sop_text"))


def read_attachments(spark: SparkSession, path: str, pattern: str = ATTACHABLE) -> DataFrame:
    """(path, filename, attachment) for the files below ``path``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(path))
    named = files.select("path", F.url_decode(F.regexp_extract("path", r"([^/]*)$", 1)).alias("filename"),
                         "content")
    return extract_attachments(named).drop("content")


def request_log_rows(df: DataFrame) -> DataFrame:
    """The 12 log columns: latency to 3 places, empty ``extra`` as NULL."""
    return df.select(*[c for c in REQUEST_LOG_COLUMNS if c not in ("latency_ms", "extra")],
                     F.round("latency_ms", 3).alias("latency_ms"),
                     F.nullif(F.nullif("extra", F.lit("")), F.lit("{}")).alias("extra")
                     ).select(*REQUEST_LOG_COLUMNS)


def append_request_log(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Append metered rows to the log, one partition folder per day.

    With ``batch``, a name for these rows, the append may be repeated: the rows go
    to a folder of the batch below each day, and a repeated batch replaces exactly
    those folders.  One log is appended to either always with names or never.
    """
    rows = request_log_rows(df).withColumn("date", F.to_date("ts"))
    if batch is None:
        rows.write.mode("append").partitionBy("date").parquet(path)
    else:
        (rows.withColumn("batch", F.lit(batch)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path))


def append_request_log_stream(stream: DataFrame, path: str, checkpoint: str):
    """The same as a streaming sink; returns the started query (runs what is available)."""
    return (request_log_rows(stream).withColumn("date", F.to_date("ts"))
            .writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).partitionBy("date")
            .trigger(availableNow=True).start())


def read_request_log(spark: SparkSession, path: str, since: str | None = None,
                     keep_date: bool = False) -> DataFrame:
    """Read the log; ``since`` (a date) prunes partitions besides filtering.

    With ``keep_date`` the partition column stays, and trailing reports use it.
    """
    log = spark.read.parquet(path)
    if since is not None:
        log = log.where(F.col("date") >= F.lit(since).cast("date"))
    return log.drop("batch") if keep_date else log.drop("date", "batch")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """A comparison report as one row per variant, per-class stats as a map."""
    report = spark.read.schema(COMPARISON_SCHEMA).option("multiLine", "true").json(path)
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("r"))
                               for v in ("base", "finetuned")]))
    return (report.select(rows.alias("x")).where("x.r IS NOT NULL")
            .select("x.variant", "x.r.model_source", "x.r.eval_rows", "x.r.accuracy", "x.r.f1_macro",
                    "x.r.per_class"))


def read_report_samples(spark: SparkSession, path: str) -> DataFrame:
    """The sample predictions of a comparison report, one row each, with right/wrong marks.

    ``position`` is the place in the report; a report without samples gives no row.
    """
    report = spark.read.schema(COMPARISON_SCHEMA).option("multiLine", "true").json(path)
    mark = lambda c: F.when(F.col(c) == F.col("y_true"), "right").otherwise("wrong")
    return (report.select(F.posexplode("samples").alias("position", "x"))
            .select("position", "x.text", F.col("x.true").alias("y_true"), "x.base_pred", "x.finetuned_pred")
            .withColumns({"base_mark": mark("base_pred"), "finetuned_mark": mark("finetuned_pred")}))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING_LOG_SCHEMA).option("multiLine", "true").json(path)


def store_inventory(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> DataFrame:
    """Per store: present, files, size in KB, last change, rows.

    Sizes come from the file listing (contents are pruned away), rows from
    ``count()`` (parquet footers).  A missing store gives zeros.
    """
    parts = []
    for label, path in paths.items():
        name = F.lit(label).alias("store")
        try:
            files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                     .select("length", "modificationTime"))
            rows = spark.read.format(fmt).load(path).agg(F.count(F.lit(1))).scalar()
        except AnalysisException:
            parts.append(spark.range(1).select(
                name, F.lit(False).alias("present"), F.lit(0).cast("bigint").alias("files"),
                F.lit(0.0).alias("size_kb"), F.lit(None).cast("timestamp").alias("changed"),
                F.lit(0).cast("bigint").alias("n_rows")))
            continue
        parts.append(files.agg(
            F.count(F.lit(1)).alias("files"), F.round(F.sum("length") / 1024, 1).alias("size_kb"),
            F.max("modificationTime").alias("changed")).select(
            name, F.lit(True).alias("present"), "files", "size_kb", "changed", rows.alias("n_rows")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
