"""Reports over the request log: latency, cost, errors, cache, feedback, trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FEEDBACK_SUBTASK
from ..functions.logs import high_is_bad, high_is_good, json_field, model_version, request_error
from .scale import exact_percentiles

VIEW_COLUMNS = ("id", "ts", "subtask", "model", "latency_ms", "tokens_in", "tokens_out",
                "cost_usd", "status", "cache_hit", "error")


def price_table(spark: SparkSession, prices: Mapping[str, tuple[float, float]]) -> DataFrame:
    """USD per million tokens, (in, out) per model."""
    rows = [F.struct(F.lit(m).alias("model"), F.lit(float(i)).alias("price_in"),
                     F.lit(float(o)).alias("price_out")) for m, (i, o) in sorted(prices.items())]
    return spark.range(1).select(F.inline(F.array(*rows)))


def priced_requests(log: DataFrame, prices: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Add ``cost_usd``; a model without a price costs nothing."""
    # The price list is a literal of the calling program, hence broadcast.
    table = F.broadcast(price_table(log.sparkSession, prices))
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return (log.join(table, "model", "left").withColumn("cost_usd", F.coalesce(cost, F.lit(0.0)))
            .drop("price_in", "price_out"))


def no_feedback(log: DataFrame) -> DataFrame:
    return log.where(F.col("subtask") != FEEDBACK_SUBTASK)


def trailing(log: DataFrame, window_seconds: float | None, as_of: Column | None) -> DataFrame:
    """Rows of the last ``window_seconds`` before ``as_of``; 0 or None keeps all."""
    if not window_seconds:
        return log
    if as_of is None:
        raise ValueError("a trailing window needs as_of")
    start = as_of - F.make_dt_interval(secs=F.lit(window_seconds).cast("decimal(18,6)"))
    # A log partitioned by day skips the days before the window.
    days = log.where(F.col("date") >= F.to_date(start)) if "date" in log.columns else log
    return days.where(F.col("ts") >= start)


def _failed(effective_errors: bool) -> Column:
    failed = F.col("status") == "error"
    return failed | request_error(F.col("error"), F.col("extra")).isNotNull() \
        if effective_errors else failed


def total_cost() -> Column:
    """Sum of costs to 6 places, as decimals: the same whatever order rows arrive in."""
    return F.round(F.sum(F.col("cost_usd").cast("decimal(28,9)")), 6).cast("double")


def _measures(effective_errors: bool) -> list[Column]:
    n = F.count(F.lit(1))
    rate = lambda flag: F.round(F.try_divide(F.count_if(flag), n), 4)  # noqa: E731  (NULL without rows)
    return [
        n.alias("requests"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        total_cost().alias("cost_usd"),
        rate(_failed(effective_errors)).alias("error_rate"),
        rate(F.col("cache_hit") == 1).alias("cache_hit_rate"),
    ]


_PROBS = {"latency_p50_ms": 50.0, "latency_p95_ms": 95.0}


def latency_percentiles(log: DataFrame, keys: Sequence[str] = ("subtask",),
                        probs: Mapping[str, float] = _PROBS, approximate: bool = False,
                        accuracy: int = 10_000) -> DataFrame:
    """Nearest-rank latency percentiles per key.

    ``approximate=True`` uses a mergeable sketch (rank error at most 1/accuracy).
    """
    if approximate:
        return log.groupBy(*keys).agg(*[
            F.percentile_approx("latency_ms", p / 100, accuracy).alias(name)
            for name, p in probs.items()])
    return exact_percentiles(log, keys, "latency_ms", dict(probs))


def ops_summary(log: DataFrame, window_seconds: float | None = None, as_of: Column | None = None,
                exclude_feedback: bool = False, effective_errors: bool = False) -> DataFrame:
    """One row of totals; zeros when nothing matches.

    Feedback rows count as requests unless ``exclude_feedback``.  With
    ``effective_errors`` a request also failed when its error is only noted in
    ``extra``.
    """
    rows = trailing(no_feedback(log) if exclude_feedback else log, window_seconds, as_of)
    span = (F.unix_micros(F.max("ts").cast("timestamp"))
            - F.unix_micros(F.min("ts").cast("timestamp"))) / 60e6
    n = F.count(F.lit(1))
    rpm = F.when(span > 0, n / span).otherwise(n.cast("double"))
    totals = rows.agg(*_measures(effective_errors), F.round(rpm, 2).alias("throughput_rpm"))
    tails = exact_percentiles(rows, [], "latency_ms", _PROBS).select(F.struct(*_PROBS)).scalar()
    tail = lambda c: F.coalesce(F.round(tails[c], 2), F.lit(0.0))
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z)).alias(c)
    return totals.select(
        "requests", *[tail(c).alias(c) for c in _PROBS],
        zero("tokens_in", 0), zero("tokens_out", 0), zero("cost_usd", 0.0),
        zero("error_rate", 0.0), zero("cache_hit_rate", 0.0), zero("throughput_rpm", 0.0))


def ops_summary_by_subtask(log: DataFrame, effective_errors: bool = False) -> DataFrame:
    """Totals and percentiles per subtask, sorted by subtask."""
    totals = log.groupBy("subtask").agg(*_measures(effective_errors))
    tails = latency_percentiles(log)
    return totals.join(tails, "subtask").select(
        "subtask", "requests", *[F.round(c, 2).alias(c) for c in _PROBS],
        "tokens_in", "tokens_out", "cost_usd", "error_rate", "cache_hit_rate").orderBy("subtask")


def _per_group(log: DataFrame, key: str) -> DataFrame:
    return no_feedback(log).groupBy(key).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.avg("latency_ms"), 1).alias("avg_ms"),
        total_cost().alias("cost_usd"),
        F.count_if(F.col("status") == "error").alias("errors"))


def ops_by_model(log: DataFrame) -> DataFrame:
    """Calls, mean latency, cost and errors per model id, without feedback."""
    return _per_group(log, "model")


def ops_by_model_version(log: DataFrame) -> DataFrame:
    """The same per version stamp of the model id ('' = unstamped)."""
    return _per_group(log.withColumn("model_version", model_version(F.col("model"))),
                      "model_version")


def ops_by_prompt_version(log: DataFrame) -> DataFrame:
    """Calls, latency, tokens and cost per prompt version noted in ``extra``."""
    version = json_field(F.col("extra"), "$.prompt_version")
    return (no_feedback(log).withColumn("prompt_version", version)
            .where(F.col("prompt_version").isNotNull())
            .groupBy("prompt_version").agg(
                F.count(F.lit(1)).alias("calls"), F.round(F.avg("latency_ms"), 1).alias("avg_ms"),
                F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
                total_cost().alias("cost_usd")))


def feedback_summary(log: DataFrame) -> DataFrame:
    """Thumbs up and down; malformed, missing and zero values count for neither."""
    value = F.coalesce(json_field(F.col("extra"), "$.value", "bigint"), F.lit(0))
    votes = log.where(F.col("subtask") == FEEDBACK_SUBTASK).select(value.alias("v"))
    return votes.agg(F.count_if(F.col("v") > 0).alias("up"), F.count_if(F.col("v") < 0).alias("down"),
                     F.count_if(F.col("v") != 0).alias("total"))


def tokens_long(log: DataFrame) -> DataFrame:
    """Token totals per subtask, one row per direction."""
    return (log.groupBy("subtask").agg(F.sum("tokens_in").alias("tokens_in"),
                                       F.sum("tokens_out").alias("tokens_out"))
            .unpivot(["subtask"], ["tokens_in", "tokens_out"], "direction", "tokens"))


def latency_trend(log: DataFrame, subtasks: Sequence[str]) -> DataFrame:
    """Mean latency, one row per time and one column per subtask, without feedback."""
    return (no_feedback(log).groupBy("ts").pivot("subtask", list(subtasks))
            .agg(F.round(F.avg("latency_ms"), 3)))


def request_volume(log: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """Calls per subtask and time bucket, without feedback, gaps filled with 0.

    Gaps are filled from the first to the last bucket of each subtask.  The bucket
    range is exploded in runs of 4096, so no row ever carries the whole range.
    """
    size, run = bucket_seconds * 1_000_000, 4096
    number = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / size).cast("bigint")
    counts = (no_feedback(log).groupBy("subtask", number.alias("__b"))
              .agg(F.count(F.lit(1)).alias("calls")))
    span = counts.groupBy("subtask").agg(F.min("__b").alias("__lo"), F.max("__b").alias("__hi"))
    runs = span.withColumn("__from", F.explode(F.sequence("__lo", "__hi", F.lit(run).cast("bigint"))))
    grid = runs.select("subtask", F.explode(F.sequence(
        "__from", F.least(F.col("__hi"), F.col("__from") + run - 1))).alias("__b"))
    return (grid.join(counts, ["subtask", "__b"], "left")
            .select("subtask", F.timestamp_micros(F.col("__b") * size).cast("timestamp_ntz")
                    .alias("bucket_start"), F.coalesce("calls", F.lit(0)).alias("calls")))


def recent_requests(log: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` rows by id."""
    return log.orderBy(F.desc("id")).limit(n)


def request_log_view(log: DataFrame, subtask: str | None = None, status: str | None = None,
                     cached_only: bool = False, n: int = 200) -> DataFrame:
    """The newest ``n`` rows that match all given predicates, and how many match in all."""
    view = log
    if subtask is not None:
        view = view.where(F.col("subtask") == subtask)
    if status is not None:
        view = view.where(F.col("status") == status)
    if cached_only:
        view = view.where(F.col("cache_hit") == 1)
    matching = view.agg(F.count(F.lit(1))).scalar()
    return (view.select(*VIEW_COLUMNS).orderBy(F.desc("id")).limit(n)
            .withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .withColumn("matching", matching))


def ops_health_bands(log: DataFrame) -> DataFrame:
    """Headline rates with a traffic-light band each."""
    summary = ops_summary(log).select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), value.alias("value"), band.alias("band"))
        for name, value, band in (
            ("error_rate", F.col("error_rate"), high_is_bad(F.col("error_rate"), 0.02, 0.1)),
            ("success_rate", F.round(1 - F.col("error_rate"), 4),
             high_is_good(1 - F.col("error_rate"), 0.5, 0.2)),
            ("cache_hit_rate", F.col("cache_hit_rate"),
             high_is_good(F.col("cache_hit_rate"), 0.5, 0.2)),
            ("latency_p95_ms", F.col("latency_p95_ms"),
             high_is_bad(F.col("latency_p95_ms"), 1500, 8000)),
        )])).alias("m")).select("m.*")
    ratio = F.when(F.col("total") > 0, F.round(F.col("up") / F.col("total"), 4)).otherwise(0.0)
    feedback = feedback_summary(log).select(
        F.lit("positive_feedback").alias("metric"), ratio.alias("value"),
        high_is_good(ratio, 0.5, 0.2).alias("band"))
    return summary.unionByName(feedback)


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries and total hits of a cache table."""
    return cache.agg(F.count(F.lit(1)).alias("entries"),
                     F.coalesce(F.sum("hits"), F.lit(0)).alias("total_hits"))
