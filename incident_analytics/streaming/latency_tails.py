"""Percentiles of trailing windows from one stored histogram per bucket of time.

The stream keeps, per time bucket and key, how many calls fall on each level of a
logarithmic scale.  Levels of several buckets merge by adding, so any trailing window
is a sum of stored rows and the log is not read again.  A level also keeps its smallest
and largest value: the percentile lies between both, and they differ by at most the
relative ``error`` (values within ``SMALLEST`` of zero share a level).

The exact value follows from the bracket: only rows of the log between both bounds
are counted (:func:`exact_tails`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import nearest_rank
from .ops_stream import DELAY, window_bounds

ERROR = 0.01
SMALLEST = 1e-3
TAILS = {"p50": 50.0, "p95": 95.0}


def level(value: Column, error: float = ERROR) -> Column:
    """Steps of the factor 1 + ``error`` from ``SMALLEST`` on, with the sign of the value; rises with it."""
    steps = F.ceil(F.log(F.greatest(F.abs(value) / SMALLEST, F.lit(1.0))) / math.log1p(error))
    return (F.signum(value) * steps).cast("int")


def latency_histogram_stream(stream: DataFrame, bucket: str = "1 hour", keys: Sequence[str] = ("subtask",),
                             delay: str = DELAY, error: float = ERROR, value: str = "latency_ms") -> DataFrame:
    """(window_start, window_end, *keys, level, n, low, high); a NULL value is not counted.

    State per bucket and key is bounded by the levels between the smallest and the largest value.
    """
    v = F.col(value).cast("double")
    return window_bounds(stream.where(v.isNotNull()).withWatermark("ts", delay)
                         .groupBy(F.window("ts", bucket), *keys, level(v, error).alias("level"))
                         .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")))


def trailing_brackets(histogram: DataFrame, span: str = "6 hours", slide: str = "1 hour",
                      keys: Sequence[str] = ("subtask",), tails: Mapping[str, float] = TAILS) -> DataFrame:
    """Per trailing window and key: requests, and a row per tail with its bounds.

    (window_start, window_end, *keys, requests, tail, rank, below, low, high): the value of nearest
    rank ``rank`` lies in low..high, and ``below`` values are smaller than low.  Windows that end
    behind the last stored bucket are left out, as their buckets may still be open.
    """
    group = ["window_start", "window_end", *keys]
    last = histogram.agg(F.max("window_end")).scalar()
    merged = window_bounds(
        histogram.select(F.window(F.col("window_start").cast("timestamp"), span, slide), *keys, "level", "n", "low", "high")
        .groupBy("window", *keys, "level")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))) \
        .where(F.col("window_end") <= last)
    per = Window.partitionBy(*group)
    upto = F.sum("n").over(per.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    counted = merged.withColumns({"requests": F.sum("n").over(per), "upto": upto})
    wanted = F.array(*[F.struct(F.lit(name).alias("tail"), nearest_rank(F.col("requests"), pct).alias("rank"))
                       for name, pct in tails.items()])
    return (counted.withColumn("w", F.explode(wanted))
            .where((F.col("w.rank") > F.col("upto") - F.col("n")) & (F.col("w.rank") <= F.col("upto")))
            .select(*group, "requests", "w.tail", "w.rank", (F.col("upto") - F.col("n")).alias("below"), "low", "high"))


def estimated_tails(brackets: DataFrame, keys: Sequence[str] = ("subtask",),
                    tails: Mapping[str, float] = TAILS) -> DataFrame:
    """One row per window and key; a tail is the middle of its bounds, so at most half the error away."""
    return brackets.groupBy("window_start", "window_end", *keys, "requests").agg(*[
        F.max(F.when(F.col("tail") == name, (F.col("low") + F.col("high")) / 2)).alias(name) for name in tails])


def exact_tails(log: DataFrame, brackets: DataFrame, span: str = "6 hours", slide: str = "1 hour",
                keys: Sequence[str] = ("subtask",), tails: Mapping[str, float] = TAILS,
                value: str = "latency_ms") -> DataFrame:
    """The tails exactly, from the rows of the log between the bounds of each window.

    Equal values of a time bucket are counted before they are dealt to the windows that hold
    them.  ``log`` must be the rows the histogram was made of.
    """
    group = ["window_start", "window_end", *keys]
    v = F.col(value).cast("double")
    counts = (log.where(v.isNotNull()).groupBy(F.window("ts", slide).alias("b"), *keys, v.alias("v"))
              .agg(F.count(F.lit(1)).alias("c")).select(F.window(F.col("b.start"), span, slide), *keys, "v", "c"))
    between = (window_bounds(counts).join(brackets, group)
               .where(F.col("v").between(F.col("low"), F.col("high")))
               .groupBy(*group, "requests", "tail", "rank", "below", "v").agg(F.sum("c").alias("c")))
    order = Window.partitionBy(*group, "tail").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    reached = between.withColumn("upto", F.col("below") + F.sum("c").over(order)).where("upto >= rank")
    return reached.groupBy(*group, "requests").agg(*[
        F.min(F.when(F.col("tail") == name, F.col("v"))).alias(name) for name in tails])
