"""Column builders for the request log, cache keys, prompts and time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import strip_all

DEFAULT_STYLE = "stepwise"

_SOURCES = "Everything you state must come from the tickets and the procedure in the message. "
_GAPS = "Name what those sources leave open instead of guessing."

# Style names and prompt versions (the wording is ours).
PROMPT_STYLES = (
    ("stepwise", "resolve-v1-stepwise",
     "An engineer works along your answer at the console. " + _SOURCES
     + "Order the work from the safest check to the deepest change, and cite ticket ids. " + _GAPS),
    ("concise", "resolve-v1-concise",
     "Your answer is read on a phone during an outage. " + _SOURCES
     + "Keep to the few lines that change what the reader does next. " + _GAPS),
    ("customer", "resolve-v1-customer",
     "The person who reported the incident reads your answer. " + _SOURCES
     + "Write plainly and kindly, leave internals out, and list the tickets used at the end. " + _GAPS),
    ("handover", "resolve-v1-handover",
     "The next shift takes the incident over from your note. " + _SOURCES
     + "Cover who is affected, what is known, what was tried and what comes next. " + _GAPS),
)


def json_field(extra: Column, path: str, kind: str = "string") -> Column:
    """A field of free JSON text; malformed or non-object JSON gives NULL."""
    return F.try_variant_get(F.try_parse_json(extra), path, kind)


def request_error(error: Column, extra: Column) -> Column:
    """The error of a request, also when it was only noted in ``extra``."""
    return F.coalesce(error, json_field(extra, "$.error"))


def request_key(subtask: Column, model: Column, payload: dict[str, Column]) -> Column:
    """sha-256 cache key over subtask, model and the payload with sorted field names."""
    canonical = F.to_json(F.struct(*[payload[k].alias(k) for k in sorted(payload)]),
                          {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("|", subtask, model, canonical), 256)


def retrieval_request_key(subtask: Column, model: Column, text: Column, mode: str, k: int,
                          threshold: float) -> Column:
    """Cache key of a retrieval call; the settings are part of the key.

    ``mode`` is 'kb' or 'off', ``k`` 1..10, ``threshold`` 0..1 in steps of 0.05.
    """
    if mode not in ("kb", "off") or not 1 <= k <= 10 or not 0 <= threshold <= 1:
        raise ValueError("retrieval settings out of range")
    settings = {"mode": F.lit(mode), "text": text}
    if mode == "kb":
        settings |= {"top_k": F.lit(k), "threshold": F.format_string("%.2f", F.lit(float(threshold)))}
    return request_key(subtask, model, settings)


def content_fingerprint(content: Column) -> Column:
    """First 16 hex digits of the sha-1 of a blob."""
    return F.substring(F.sha1(content), 1, 16)


def version_stamp(ts: Column) -> Column:
    """``@YYYYMMDD-HHMMSS`` suffix of a model id, '' without a time."""
    return F.coalesce(F.concat(F.lit("@"), F.date_format(ts, "yyyyMMdd-HHmmss")), F.lit(""))


def model_version(model: Column) -> Column:
    """The version stamped on a model id, '' if there is none."""
    return F.regexp_extract(model, r"@([0-9]{8}-[0-9]{6})$", 1)


def day_bucket(ts: Column, as_of: Column) -> Column:
    """Today / Yesterday / Previous 7 days / Older, by calendar day."""
    days = F.datediff(F.to_date(as_of), F.to_date(ts))
    return (F.when(days <= 0, "Today").when(days == 1, "Yesterday")
            .when(days <= 7, "Previous 7 days").otherwise("Older"))


def style_key(style: Column) -> Column:
    return F.lower(strip_all(F.coalesce(style, F.lit(""))))


def prompt_styles(spark: SparkSession) -> DataFrame:
    """The styles table: four rows, fixed."""
    rows = F.array(*[F.struct(F.lit(k).alias("style"), F.lit(v).alias("prompt_version"),
                              F.lit(t).alias("system_text")) for k, v, t in PROMPT_STYLES])
    return spark.range(1).select(F.inline(rows))


def with_prompt_style(df: DataFrame, style: str = "style") -> DataFrame:
    """Replace ``style`` by a known style and add its version and system text.

    Unknown, empty and NULL styles get the default.
    """
    known = [k for k, _, _ in PROMPT_STYLES]
    key = style_key(F.col(style))
    resolved = F.when(key.isin(*known), key).otherwise(F.lit(DEFAULT_STYLE))
    # Broadcast: the styles table has four rows by construction.
    return (df.withColumn(style, resolved)
            .join(F.broadcast(prompt_styles(df.sparkSession).withColumnRenamed("style", style)),
                  style, "left"))


def high_is_bad(rate: Column, ok: float, warn: float) -> Column:
    return F.when(rate <= ok, "ok").when(rate <= warn, "warn").otherwise("err")


def high_is_good(rate: Column, ok: float, warn: float) -> Column:
    return F.when(rate >= ok, "ok").when(rate >= warn, "warn").otherwise("err")
