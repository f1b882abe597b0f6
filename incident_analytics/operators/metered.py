"""Run a user function over payloads with metering, error capture and memoisation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logs import request_key
from ..functions.text import approx_tokens
from ..session import materialize
from .scale import heavy_keys, salted_join

Result = str | tuple[str, int, int]

_CALLED = ("__key string, output string, status string, error string, latency_ms double, "
           "used_in bigint, used_out bigint")


_CALLED_COLUMNS = ["__key", "output", "status", "error", "latency_ms", "used_in", "used_out"]


def _timed(call: Callable[[], object]) -> tuple[object, str | None, float]:
    """The result of a call, or its error as text, and its milliseconds."""
    start = time.perf_counter()
    result = error = None
    try:
        result = call()
    except Exception as exc:  # captured per payload, never fails the job
        error = f"{type(exc).__name__}: {exc}"
    return result, error, (time.perf_counter() - start) * 1000.0


def _answer(key: str, result: object, error: str | None, elapsed: float) -> tuple:
    output, used_in, used_out = result if isinstance(result, tuple) else (result, None, None)
    return key, output, "error" if error else "ok", error, round(elapsed, 3), used_in, used_out


def _one_by_one(fn: Callable[..., Result]):
    return lambda batch: [_answer(row[0], *_timed(lambda: fn(*row[1:]))) for row in batch.itertuples(index=False)]


def _together(fn: Callable[[pd.DataFrame], Sequence[Result]]):
    """One call per batch; where it fails, every payload is called alone, so only the bad ones fail."""
    def answers(batch: pd.DataFrame) -> list[tuple]:
        def checked() -> list[Result]:
            results = list(fn(batch.drop(columns="__key").reset_index(drop=True)))
            if len(results) != len(batch):
                raise ValueError(f"{len(results)} results for {len(batch)} payloads")
            return results
        results, error, elapsed = _timed(checked)
        if error and len(batch) > 1:
            return [row for i in range(len(batch)) for row in answers(batch.iloc[i:i + 1])]
        share = elapsed / max(len(batch), 1)
        return [_answer(k, r, error, share) for k, r in zip(batch["__key"], results or [None] * len(batch))]
    return answers


def _call(answers: Callable[[pd.DataFrame], list[tuple]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(answers(batch), columns=_CALLED_COLUMNS).astype(
                {"used_in": "Int64", "used_out": "Int64"})
    return run


def apply_metered(df: DataFrame, fn: Callable[..., Result], subtask: str, model: str,
                  payload_cols: Sequence[str], id_col: str = "id", batched: bool = False) -> DataFrame:
    """Call ``fn(*payload)`` once per distinct payload and give every row its envelope.

    With ``batched``, ``fn`` takes a pandas frame of payloads and returns one result
    per row; a batch that fails is called again payload by payload, and the latency
    of a batch is shared equally by its rows.

    ``fn`` returns the output text, or (output, tokens_in, tokens_out) when it
    knows its usage; otherwise tokens are estimated from the lengths.  The first
    row (by id) of a payload made the call; later rows with a successful result
    are cache hits.  A failed payload is not cached: its repeats are errors too.
    The calls are made here, and their results written to the shared folder, so
    that later uses of the returned table do not repeat them.
    Adds output, status, error, latency_ms, tokens_in, tokens_out,
    tokens_estimated and cache_hit.
    """
    payload = {c: F.col(c) for c in payload_cols}
    keyed = df.withColumn("__key", request_key(F.lit(subtask), F.lit(model), payload))
    # Distinct payloads: narrow first ids, then a semi-join on (key, id), which is unique.
    firsts = keyed.groupBy("__key").agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("__n"))
    calls = keyed.join(firsts.select("__key", F.col("__first").alias(id_col)), ["__key", id_col],
                       "left_semi")
    results = materialize(
        calls.select("__key", *payload_cols).mapInPandas(_call((_together if batched else _one_by_one)(fn)), _CALLED), "metered-calls")
    answered = results.join(firsts.select("__key", "__first"), "__key")
    rows = salted_join(keyed, answered, "__key", heavy_keys(firsts, "__key", "__n"), F.col(id_col))
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in payload_cols])
    repeated = (F.col(id_col) != F.col("__first")) & (F.col("status") == "ok")
    exact = F.col("used_in").isNotNull() & ~repeated
    return rows.select(
        *df.columns, "output", "status", "error",
        F.when(repeated, F.lit(0.0)).otherwise(F.col("latency_ms")).alias("latency_ms"),
        F.when(exact, F.col("used_in")).otherwise(approx_tokens(text)).alias("tokens_in"),
        F.when(exact, F.col("used_out")).otherwise(approx_tokens(F.col("output"))).alias("tokens_out"),
        (~exact).alias("tokens_estimated"), repeated.alias("cache_hit"))


def metered_log(metered: DataFrame, subtask: str, model: str, ts: str, id_col: str = "id") -> DataFrame:
    """Request-log rows (without cost) for the rows of :func:`apply_metered`."""
    extra = F.when(F.col("tokens_estimated"), F.lit('{"tokens_estimated": true}'))
    return metered.select(
        F.col(id_col).alias("id"), F.col(ts).alias("ts"), F.lit(subtask).alias("subtask"),
        F.lit(model).alias("model"), F.round("latency_ms", 3).alias("latency_ms"), "tokens_in",
        "tokens_out", "status", F.col("cache_hit").cast("int").alias("cache_hit"), "error",
        extra.alias("extra"))
