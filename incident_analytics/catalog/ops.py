"""Registered queries over the request log, the TTL cache and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.logs import request_error, request_key, version_stamp
from ..functions.text import approx_tokens
from ..operators import opslog as o
from ..operators.cache_ttl import cache_table, ttl_requests
from ..session import materialize, scratch_path
from ..sources.stores import append_request_log, read_request_log
from ..streaming.late import count_late_rows
from ..streaming.latency_tails import (ERROR, estimated_tails, exact_tails, latency_histogram_stream,
                                       trailing_brackets)
from ..streaming.ops_stream import (ops_summary_stream, request_volume_stream, run_available,
                                    trailing_summary_stream)
from ..streaming.ttl_stream import ttl_requests_batches, ttl_requests_stream
from . import bindings as b
from .bindings import AS_OF, LOG

QUERIES, ORACLES = {}, {}


def register(key, fn, sql=None):
    QUERIES[key] = fn
    if sql is not None:
        ORACLES[key] = sql


def _text(ts="ts"):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


_TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
_N = "CAST(count(*) AS BIGINT)"
_TOTALS = f"""{_N} AS requests, round(quantile_disc(latency_ms, 0.5), 2) AS latency_p50_ms,
  round(quantile_disc(latency_ms, 0.95), 2) AS latency_p95_ms,
  CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
  CAST(round(sum(CAST(cost_usd AS DECIMAL(28,9))), 6) AS DOUBLE) AS cost_usd, round(count(*) FILTER (WHERE status = 'error') / count(*), 4)
  AS error_rate, round(count(*) FILTER (WHERE cache_hit = 1) / count(*), 4) AS cache_hit_rate"""
_SPAN = "((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6)"
_RPM = f"round(CASE WHEN {_SPAN} > 0 THEN count(*) / {_SPAN} ELSE count(*) END, 2) AS throughput_rpm"

register("ops_summary", lambda s, d: o.ops_summary(b.request_log(s, d)),
         f"WITH {LOG} SELECT {_TOTALS}, {_RPM} FROM log")
register("ops_summary_trailing",
         lambda s, d: o.ops_summary(b.request_log(s, d), 7 * 86400, F.lit(AS_OF).cast("timestamp_ntz")),
         f"WITH {LOG} SELECT {_TOTALS}, {_RPM} FROM log WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
register("ops_summary_by_subtask", lambda s, d: o.ops_summary_by_subtask(b.request_log(s, d)),
         f"WITH {LOG} SELECT subtask, {_TOTALS} FROM log GROUP BY subtask")
register("latency_percentiles",
         lambda s, d: o.latency_percentiles(
             b.request_log(s, d), ["subtask", "model"],
             {"p0": 0, "p10": 10, "p50": 50, "p95": 95, "p99_9": 99.9, "p100": 100}),
         f"""WITH {LOG} SELECT subtask, model, min(latency_ms) AS p0, quantile_disc(latency_ms, 0.1) AS p10,
         quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95,
         quantile_disc(latency_ms, 0.999) AS p99_9, max(latency_ms) AS p100
         FROM log GROUP BY subtask, model""")
register("priced_requests",
         lambda s, d: b.request_log(s, d).select("id", "model", F.round("cost_usd", 9).alias("cost_usd")),
         f"WITH {LOG} SELECT id, model, round(cost_usd, 9) AS cost_usd FROM log")
_GROUP = f"""{_N} AS calls, round(avg(latency_ms), 1) AS avg_ms, CAST(round(sum(CAST(cost_usd AS DECIMAL(28,9))), 6) AS DOUBLE) AS cost_usd,
  CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS errors"""
register("ops_by_model", lambda s, d: o.ops_by_model(b.request_log(s, d)),
         f"WITH {LOG} SELECT model, {_GROUP} FROM log WHERE subtask <> 'feedback' GROUP BY model")
register("ops_by_prompt_version", lambda s, d: o.ops_by_prompt_version(b.request_log(s, d)),
         f"""WITH {LOG}, v AS (SELECT *, CASE WHEN json_valid(extra) THEN
         json_extract_string(extra, '$.prompt_version') END AS prompt_version FROM log
         WHERE subtask <> 'feedback')
         SELECT prompt_version, {_N} AS calls, round(avg(latency_ms), 1) AS avg_ms,
         CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
         CAST(round(sum(CAST(cost_usd AS DECIMAL(28,9))), 6) AS DOUBLE) AS cost_usd FROM v WHERE prompt_version IS NOT NULL GROUP BY 1""")
_VOTE = "TRY_CAST(CASE WHEN json_valid(extra) THEN json_extract_string(extra, '$.value') END AS BIGINT)"
_FEEDBACK = f"""SELECT CAST(count(*) FILTER (WHERE v > 0) AS BIGINT) AS up,
  CAST(count(*) FILTER (WHERE v < 0) AS BIGINT) AS down,
  CAST(count(*) FILTER (WHERE v <> 0) AS BIGINT) AS total
  FROM (SELECT coalesce({_VOTE}, 0) AS v FROM log WHERE subtask = 'feedback')"""
register("feedback_summary", lambda s, d: o.feedback_summary(b.request_log(s, d)),
         f"WITH {LOG} {_FEEDBACK}")
register("tokens_long", lambda s, d: o.tokens_long(b.request_log(s, d)),
         f"""WITH {LOG} SELECT subtask, 'tokens_in' AS direction, CAST(sum(tokens_in) AS BIGINT) AS tokens
         FROM log GROUP BY 1 UNION ALL SELECT subtask, 'tokens_out', CAST(sum(tokens_out) AS BIGINT)
         FROM log GROUP BY 1""")
_TREND = [x for x in b.SUBTASKS if x != "feedback"]
register("latency_trend",
         lambda s, d: o.latency_trend(b.request_log(s, d), _TREND).withColumn("ts", _text()),
         f"WITH {LOG} SELECT {_TEXT.format('ts')} AS ts, " + ", ".join(
             f"round(avg(latency_ms) FILTER (WHERE subtask = '{x}'), 3) AS {x}" for x in _TREND)
         + " FROM log WHERE subtask <> 'feedback' GROUP BY ts")
_BAD = "CASE WHEN {0} <= {1} THEN 'ok' WHEN {0} <= {2} THEN 'warn' ELSE 'err' END AS band"
_GOOD = "CASE WHEN {0} >= {1} THEN 'ok' WHEN {0} >= {2} THEN 'warn' ELSE 'err' END AS band"
register("ops_health_bands", lambda s, d: o.ops_health_bands(b.request_log(s, d)),
         f"""WITH {LOG}, s AS (SELECT {_TOTALS} FROM log), f AS ({_FEEDBACK}),
         r AS (SELECT CASE WHEN total > 0 THEN round(up / total, 4) ELSE 0.0 END AS x FROM f)
         SELECT 'error_rate' AS metric, error_rate AS value, {_BAD.format('error_rate', 0.02, 0.1)} FROM s
         UNION ALL SELECT 'success_rate', round(1 - error_rate, 4), {_GOOD.format('1 - error_rate', 0.5, 0.2)} FROM s
         UNION ALL SELECT 'cache_hit_rate', cache_hit_rate, {_GOOD.format('cache_hit_rate', 0.5, 0.2)} FROM s
         UNION ALL SELECT 'latency_p95_ms', latency_p95_ms, {_BAD.format('latency_p95_ms', 1500, 8000)} FROM s
         UNION ALL SELECT 'positive_feedback', x, {_GOOD.format('x', 0.5, 0.2)} FROM r""")
register("request_volume",
         lambda s, d: o.request_volume(b.request_log(s, d), 3600).withColumn(
             "bucket_start", _text("bucket_start")),
         f"""WITH {LOG}, c AS (SELECT subtask, date_trunc('hour', ts) AS h, {_N} AS calls FROM log
         WHERE subtask <> 'feedback' GROUP BY 1, 2),
         g AS (SELECT subtask, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h
         FROM c GROUP BY subtask)
         SELECT g.subtask, {_TEXT.format('g.h')} AS bucket_start, coalesce(c.calls, 0) AS calls
         FROM g LEFT JOIN c ON c.subtask = g.subtask AND c.h = g.h""")
register("recent_requests",
         lambda s, d: o.recent_requests(b.request_log(s, d), 50).select("id", "subtask", "model", "latency_ms"),
         f"WITH {LOG} SELECT id, subtask, model, latency_ms FROM log ORDER BY id DESC LIMIT 50")
register("resample_recent", lambda s, d: o.ops_by_model(o.recent_requests(b.request_log(s, d), 500)),
         f"""WITH {LOG}, r AS (SELECT * FROM log ORDER BY id DESC LIMIT 500)
         SELECT model, {_GROUP} FROM r WHERE subtask <> 'feedback' GROUP BY model""")
register("request_log_view",
         lambda s, d: o.request_log_view(b.request_log(s, d), "resolve", "ok", True, 200)
         .withColumn("cost_usd", F.round("cost_usd", 9)),
         f"""WITH {LOG}, m AS (SELECT * FROM log WHERE subtask = 'resolve' AND status = 'ok' AND cache_hit = 1)
         SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, subtask, model, latency_ms, tokens_in,
         tokens_out, round(cost_usd, 9) AS cost_usd, status, cache_hit, error,
         (SELECT {_N} FROM m) AS matching FROM m ORDER BY id DESC LIMIT 200""")
register("request_error",
         lambda s, d: b.request_log(s, d).select(
             "id", request_error(F.col("error"), F.col("extra")).alias("effective_error")),
         f"""WITH {LOG} SELECT id, coalesce(error, CASE WHEN json_valid(extra) THEN
         json_extract_string(extra, '$.error') END) AS effective_error FROM log""")


def _versioned(s, d):
    log = b.request_log(s, d)
    stamp = F.when(F.col("subtask") == "classify", version_stamp(F.date_trunc("DAY", "ts"))).otherwise("")
    return o.ops_by_model_version(log.withColumn("model", F.concat("model", stamp)))


register("model_version_stamp", _versioned,
         f"""WITH {LOG}, v AS (SELECT *, CASE WHEN subtask = 'classify' THEN
         strftime(date_trunc('day', ts), '%Y%m%d-%H%M%S') ELSE '' END AS model_version FROM log)
         SELECT model_version, {_GROUP} FROM v WHERE subtask <> 'feedback' GROUP BY 1""")


def _keys(s, d):
    e = b.table(s, d, "events").withColumn("k", F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"))
    return e.select("event_id", request_key(
        F.col("event_type"), F.lit("m"), {"user_id": F.col("user_id"), "k": F.col("k")}).alias("request_key"))


register("request_key", _keys, """SELECT event_id, sha256(event_type || '|m|{"k":' ||
  CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS VARCHAR) || ',"user_id":' ||
  CAST(user_id AS VARCHAR) || '}') AS request_key FROM events""")
register("approx_tokens",
         lambda s, d: b.table(s, d, "documents").select("doc_id", approx_tokens(F.col("text")).alias("tokens")),
         """SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0
         ELSE greatest(1, round_even(length(text) / 4.0, 0)) END AS BIGINT) AS tokens FROM documents""")


def _stored(s, d):
    path = scratch_path(s, "request-log")
    append_request_log(b.request_log(s, d), path)
    return read_request_log(s, path).withColumn("ts", _text()).withColumn(
        "cost_usd", F.round("cost_usd", 9))


register("append_request_log", _stored,
         f"""WITH {LOG} SELECT id, {_TEXT.format('ts')} AS ts, subtask, model, round(latency_ms, 3) AS latency_ms,
         tokens_in, tokens_out, round(cost_usd, 9) AS cost_usd, status, cache_hit, error, extra FROM log""")

# --- TTL cache ------------------------------------------------------------------

_KEYS = ["subtask", "model"]
_CHAIN = f"""WITH RECURSIVE {LOG}, ev AS (SELECT subtask, model, ts, min(id) AS id FROM log GROUP BY ALL),
  chain AS (SELECT subtask, model, min(ts) AS ts FROM ev GROUP BY ALL
    UNION ALL SELECT c.subtask, c.model, min(e.ts) FROM chain c JOIN ev e ON e.subtask = c.subtask
    AND e.model = c.model AND e.ts > c.ts + INTERVAL 3600 SECOND GROUP BY c.subtask, c.model, c.ts),
  decided AS (SELECT l.*, m.id IS NULL AS hit FROM log l LEFT JOIN (SELECT e.id FROM chain c JOIN ev e
    ON e.subtask = c.subtask AND e.model = c.model AND e.ts = c.ts) m ON m.id = l.id)"""
register("ttl_requests",
         lambda s, d: ttl_requests(b.unpriced_log(s, d), _KEYS).select("id", "hit"),
         _CHAIN + " SELECT id, hit FROM decided")
register("cache_table",
         lambda s, d: cache_table(ttl_requests(b.unpriced_log(s, d), _KEYS), _KEYS).withColumn(
             "created_ts", _text("created_ts")),
         _CHAIN + f""" SELECT subtask, model, {_TEXT.format('max(ts) FILTER (WHERE NOT hit)')} AS created_ts,
         CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits FROM decided GROUP BY subtask, model""")
register("cache_stats",
         lambda s, d: o.cache_stats(cache_table(ttl_requests(b.unpriced_log(s, d), _KEYS), _KEYS)),
         _CHAIN + f""" SELECT CAST(count(DISTINCT subtask || '|' || model) AS BIGINT) AS entries,
         CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS total_hits FROM decided""")

# --- streams --------------------------------------------------------------------


def log_stream(s, d):
    """The events file(s) as a stream of priced log rows."""
    schema = b.table(s, d, "events").schema
    raw = s.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    log = b.events_log(raw.withColumn("ts", F.col("ts").cast("timestamp")))
    return o.priced_requests(log, b.PRICES)


def _closed(df):
    return df.withColumn("window_start", _text("window_start")).drop("window_end")


_STREAM_TOTALS = f"""{_N} AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
  CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(round(sum(CAST(cost_usd AS DECIMAL(28,9))), 6) AS DOUBLE) AS cost_usd,
  round(count(*) FILTER (WHERE status = 'error') / count(*), 4) AS error_rate,
  round(count(*) FILTER (WHERE cache_hit = 1) / count(*), 4) AS cache_hit_rate"""
_MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 MINUTE FROM {0})"
register("request_volume_stream",
         lambda s, d: _closed(run_available(request_volume_stream(log_stream(s, d), "1 hour"), "volume")),
         f"""WITH {LOG}, w AS (SELECT * FROM log WHERE subtask <> 'feedback')
         SELECT {_TEXT.format("date_trunc('hour', ts)")} AS window_start, subtask, {_N} AS calls FROM w
         GROUP BY date_trunc('hour', ts), subtask
         HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_MARK.format('w')}""")
register("ops_summary_stream",
         lambda s, d: _closed(run_available(ops_summary_stream(log_stream(s, d), "1 hour"), "summary")),
         f"""WITH {LOG} SELECT {_TEXT.format("date_trunc('hour', ts)")} AS window_start, subtask, {_STREAM_TOTALS},
         quantile_disc(latency_ms, 0.5) AS latency_p50_ms, quantile_disc(latency_ms, 0.95) AS latency_p95_ms
         FROM log GROUP BY date_trunc('hour', ts), subtask
         HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_MARK.format('log')}""")
register("trailing_summary_stream",
         lambda s, d: _closed(run_available(trailing_summary_stream(log_stream(s, d)), "trailing")),
         f"""WITH {LOG}, w AS (SELECT *, unnest(generate_series(0, 5)) AS back FROM log)
         SELECT {_TEXT.format("date_trunc('hour', ts) - to_hours(back)")} AS window_start, {_STREAM_TOTALS}
         FROM w GROUP BY date_trunc('hour', ts) - to_hours(back)
         HAVING date_trunc('hour', ts) - to_hours(back) + INTERVAL 6 HOUR <= {_MARK.format('log')}""")


def _trailing_tails(s, d):
    """Exact percentiles, and whether the stored histograms alone come within their error of them."""
    stored = run_available(latency_histogram_stream(log_stream(s, d)), "latency-levels")
    brackets = materialize(trailing_brackets(stored), "latency-brackets")
    log = b.unpriced_log(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    near = lambda t: (F.abs(F.col(f"e.{t}") - F.col(t)) <= F.col(t) * (ERROR / 2) + 1e-3).alias(f"{t}_near")
    keys = ["window_start", "window_end", "subtask", "requests"]
    guess = estimated_tails(brackets).select(*keys, F.struct("p50", "p95").alias("e"))
    return _closed(exact_tails(log, brackets).join(guess, keys).select(
        *keys, "p50", "p95", near("p50"), near("p95")))


_RANK = "list(latency_ms ORDER BY latency_ms)[(count(*) * {0} + 99) // 100]"
register("trailing_tails_stream", _trailing_tails,
         f"""WITH {LOG}, h AS (SELECT *, date_trunc('hour', ts) AS hour FROM log WHERE latency_ms IS NOT NULL),
         closed AS (SELECT max(hour) + INTERVAL 1 HOUR AS until FROM h
           WHERE hour + INTERVAL 1 HOUR <= {_MARK.format('h')}),
         w AS (SELECT subtask, latency_ms, hour - to_hours(unnest(generate_series(0, 5))) AS start FROM h)
         SELECT {_TEXT.format("start")} AS window_start, subtask, {_N} AS requests, {_RANK.format(50)} AS p50,
           {_RANK.format(95)} AS p95, true AS p50_near, true AS p95_near FROM w
         WHERE start + INTERVAL 6 HOUR <= (SELECT until FROM closed) GROUP BY start, subtask""")
register("ttl_requests_stream",
         lambda s, d: run_available(ttl_requests_stream(log_stream(s, d), _KEYS), "ttl"),
         _CHAIN + " SELECT id, hit FROM decided")


def _ttl_batches(s, d):
    """The log in three parts, one after the other in time, a part per micro-batch."""
    path = scratch_path(s, "ttl-log")
    log = b.unpriced_log(s, d).select("id", *_KEYS, F.col("ts").cast("timestamp").alias("ts"))
    bounds = log.agg(F.percentile_approx(F.unix_micros("ts"), [1 / 3, 2 / 3])).scalar()
    part = F.when(F.unix_micros("ts") < bounds[0], 0).when(F.unix_micros("ts") < bounds[1], 1).otherwise(2)
    for i in range(3):
        log.where(part == i).coalesce(1).write.mode("append").parquet(path)
    stream = s.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return ttl_requests_batches(stream, _KEYS, scratch_path(s, "ttl-batches"))


register("ttl_requests_batches", _ttl_batches, _CHAIN + " SELECT id, hit FROM decided")


def _late(s, d):
    """The log arriving in four parts that each span the whole time, a part per micro-batch."""
    path = scratch_path(s, "late-log")
    log = b.unpriced_log(s, d).select("id", F.col("ts").cast("timestamp").alias("ts"))
    for part in range(4):
        log.where(F.col("id") % 4 == part).coalesce(1).write.mode("append").parquet(path)
    stream = s.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return (count_late_rows(stream, "late-rows", "1 hour")
            .select(_text("window_start").alias("window_start"), "late_rows"))


register("late_rows_stream", _late,
         f"""WITH {LOG}, seen AS (SELECT id % 4 + k AS part, max(ts) AS latest FROM log, (SELECT unnest([1, 2, 3]) AS k)
         WHERE id % 4 + k < 4 GROUP BY 1),
         w AS (SELECT date_trunc('hour', ts) AS h, date_trunc('millisecond', latest) - INTERVAL 2 MINUTE AS mark
               FROM log JOIN seen ON part = id % 4)
         SELECT {_TEXT.format("h")} AS window_start, {_N} AS late_rows FROM w WHERE h + INTERVAL 1 HOUR <= mark GROUP BY h""")
