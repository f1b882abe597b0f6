"""The evidence of a comparison between a base and a tuned classifier."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import accuracy_macro_f1, classification_report


def compare_variants(pred: DataFrame, labels: DataFrame | Sequence[str]) -> DataFrame:
    """Rows (variant, label, precision, recall, f1, support, accuracy, f1_macro, eval_rows).

    Predictions of all variants are stacked and grouped by variant, so the
    predictions are read once per report, not once per variant.
    """
    report = classification_report(pred, labels, ["variant"])
    return report.join(accuracy_macro_f1(pred, ["variant"]), "variant")


def comparison_json(pred: DataFrame, labels: DataFrame | Sequence[str], samples: DataFrame | None = None,
                    model_sources: Mapping[str, str] | None = None) -> DataFrame:
    """The comparison as one JSON document (one value row), for the report store.

    ``samples`` are rows of ``variant_samples``, a handful by its own parameter, in
    ticket order; ``model_sources`` names where each variant's model came from.
    """
    rows = compare_variants(pred, labels)
    stats = F.struct("precision", "recall", "f1", "support")
    source = F.lit(None).cast("string")
    for variant, name in (model_sources or {}).items():
        source = F.when(F.col("variant") == variant, F.lit(name)).otherwise(source)
    per = rows.groupBy("variant").agg(
        F.first("eval_rows").alias("eval_rows"), F.first("accuracy").alias("accuracy"),
        F.first("f1_macro").alias("f1_macro"),
        F.map_from_entries(F.collect_list(F.struct("label", stats))).alias("per_class")) \
        .withColumn("model_source", source)
    body = F.map_from_entries(F.collect_list(F.struct(
        "variant", F.struct("model_source", "eval_rows", "accuracy", "f1_macro", "per_class"))))
    report = per.agg(F.to_json(body).alias("value"))
    if samples is None:
        return report
    shown = samples.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(
        "ticket_id", "text", "y_true", "base_pred", "finetuned_pred"))), lambda x: F.struct(
            x["text"].alias("text"), x["y_true"].alias("true"), x["base_pred"].alias("base_pred"),
            x["finetuned_pred"].alias("finetuned_pred")))).alias("value")).scalar()
    # both parts are JSON already: the closing brace of the first makes room for the samples
    return report.select(F.concat(F.regexp_replace("value", r"\}$", ""), F.lit(', "samples": '), shown,
                                  F.lit("}")).alias("value"))
