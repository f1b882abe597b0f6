"""TTL response cache, replayed over a request table.

A request is a hit when the entry of its key was created at most ``ttl`` seconds
ago; a miss (re)creates the entry.  Hits do not extend its life, so whether a
request hits depends on all requests before it.  Two facts keep this distributed:
misses of a key are more than ``ttl`` apart, and a key with few distinct times
fits one task.  Keys with many are followed by pointer jumping over "next miss" links
between blocks of times (see ``_follow_hot``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CACHE_TTL_SECONDS
from ..session import materialize

MAX_KEY_ROWS = 1_000_000
#: Quantiles of a hot key's times, a power of two; its blocks are whole runs of them.
_GRID = 4096
_NO_MISS = (1 << 63) - 1


def next_misses(times: np.ndarray, ttl: int) -> np.ndarray:
    """Miss times among sorted distinct ``times``, the first of which is a miss."""
    misses, at = [], 0
    while at < len(times):
        misses.append(times[at])
        at = int(np.searchsorted(times, times[at] + ttl, side="right"))
    return np.array(misses, dtype=np.int64)


def _follow_key(ttl: int):
    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["__us"].to_numpy(dtype=np.int64))
        misses = next_misses(times, ttl)
        return pd.DataFrame({"__key": pdf["__key"].iloc[0], "__us": misses})
    return follow


def _leave_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per time of a block the first miss behind the block, if the time itself is a miss."""
    pdf = pdf.sort_values("__us")
    times, to = pdf["__us"].to_numpy(dtype=np.int64), np.array(pdf["__to"], dtype=np.int64)
    inside = to <= times[-1]
    at = np.searchsorted(times, to)
    while inside.any():  # every step doubles the links that are followed
        at_inside = at[inside]
        to[inside], at[inside] = to[at_inside], at[at_inside]
        inside = to <= times[-1]
    return pd.DataFrame({"__key": pdf["__key"].iloc[0], "__us": times, "__to": to})


def _last_not_above(grid: Column, value: Column) -> Column:
    """Index of the last element of a rising array of at most ``_GRID`` that is not above ``value`` (0 if none)."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(_GRID.bit_length() - 1))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(grid, at + step) <= value, at + step).otherwise(at))


def _in_blocks(times: DataFrame, max_rows: int) -> DataFrame:
    """Add ``__block``: the times of a key cut at its quantiles into blocks of about ``max_rows`` / 2."""
    grids = materialize(times.groupBy("__key").agg(
        F.percentile_approx("__us", [i / _GRID for i in range(_GRID)], 100_000).alias("__grid"),
        F.least(F.lit(_GRID), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * 2 / max_rows))).alias("__blocks")),
        "ttl-grids")
    place = _last_not_above(F.col("__grid"), F.col("__us"))
    block = F.floor(place * F.col("__blocks") / _GRID).cast("int")
    return times.join(grids, "__key").select("__key", "__us", block.alias("__block"))


def _next_miss_links(blocked: DataFrame, ttl: int) -> DataFrame:
    """(__key, __us, __block, __to): the first time more than ``ttl`` later, NULL where there is none.

    Every time also asks from where its entry ends.  Inside a block, times and
    questions are walked backwards; a question behind the last time of its block
    is answered by the first time of the next block.
    """
    ends = blocked.select("__key", (F.col("__us") + ttl).alias("__at"), F.col("__us").alias("__from"))
    first = blocked.groupBy("__key", "__block").agg(F.min("__us").alias("__first"))
    # A key has at most _GRID blocks; the end of an entry lies in the last one that starts by then.
    starts = materialize(first.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("__first", "__block"))).alias("s"))
                         .select("__key", F.col("s.__first").alias("__firsts"), F.col("s.__block").alias("__numbers")),
                         "ttl-starts")
    asked = (ends.join(starts, "__key")
             .withColumn("__p", _last_not_above(F.col("__firsts"), F.col("__at")))
             .select("__key", "__at", "__from", F.get("__numbers", F.col("__p")).alias("__block"),
                     F.get("__firsts", F.col("__p") + 1).alias("__behind")))
    none = F.lit(None).cast("bigint")
    events = blocked.select("__key", "__block", F.col("__us").alias("__at"), F.col("__us").alias("__time"),
                            none.alias("__from"), none.alias("__behind")).unionByName(
        asked.select("__key", "__block", "__at", none.alias("__time"), "__from", "__behind"))
    # At equal times the question comes first on the way back: an entry still lives at its last instant.
    back = (Window.partitionBy("__key", "__block").orderBy(F.desc("__at"), F.col("__time").asc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, 0))
    answered = events.withColumn("__next", F.last("__time", ignorenulls=True).over(back)).where("__from IS NOT NULL")
    links = answered.select("__key", F.col("__from").alias("__us"), F.coalesce("__next", "__behind").alias("__to"))
    return links.join(blocked, ["__key", "__us"]).select("__key", "__us", "__block", "__to")


def _follow_hot(times: DataFrame, ttl: int, max_rows: int) -> DataFrame:
    """Misses of keys with more than ``max_rows`` distinct times.

    Every time links to the first time after its lifetime: the next miss, if it
    is one.  The times of a key are cut into blocks that fit a task; inside a
    block the links are followed to the first time behind it, so that a link
    leads from block to block.  Only times that some link leads to, and the first
    one, can enter a block.  Among these the misses are found by pointer jumping:
    a round adds the targets of the known misses and doubles the length of all
    links, so n blocks take about log2(n) rounds, however many lifetimes they
    hold.  At last each block is followed once from where it was entered.
    Blocks, links and the state of each round are written to the shared folder.
    """
    blocked = materialize(_in_blocks(times, max_rows), "ttl-blocks")
    links = materialize(_next_miss_links(blocked, ttl), "ttl-links")
    end = F.lit(_NO_MISS)
    leaving = materialize(
        links.withColumn("__to", F.coalesce("__to", end)).groupBy("__key", "__block")
        .applyInPandas(_leave_block, "__key string, __us bigint, __to bigint")
        .where(F.col("__to") < end), "ttl-leaving")
    known = materialize(blocked.groupBy("__key").agg(F.min("__us").alias("__us")), "ttl-known")
    targets = leaving.select("__key", F.col("__to").alias("__us")).distinct()
    jumps = materialize(leaving.join(targets.unionByName(known).distinct(), ["__key", "__us"], "left_semi"),
                        "ttl-jumps")
    while not jumps.isEmpty():
        reached = known.join(jumps, ["__key", "__us"]).select("__key", F.col("__to").alias("__us"))
        known = materialize(known.unionByName(reached).distinct(), "ttl-known")
        onward = jumps.select("__key", F.col("__us").alias("__to"), F.col("__to").alias("__far"))
        jumps = materialize(jumps.join(onward, ["__key", "__to"]).select("__key", "__us", F.col("__far").alias("__to")),
                            "ttl-jumps")
    # Misses only move on, so a block is entered once.
    entered = known.join(blocked, ["__key", "__us"]).select("__key", "__block", F.col("__us").alias("__start"))
    walked = blocked.join(materialize(entered, "ttl-entered"), ["__key", "__block"]).where(F.col("__us") >= F.col("__start"))
    return walked.groupBy("__key", "__block").applyInPandas(_follow_key(ttl), "__key string, __us bigint")


def entry_key(keys: Sequence[str]) -> Column:
    """Hash of the key columns; a NULL is a value of its own and keeps its place."""
    parts = F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)])
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def ttl_requests(df: DataFrame, keys: Sequence[str], ttl_seconds: int = CACHE_TTL_SECONDS,
                 ts: str = "ts", id_col: str = "id", succeeded: str | None = None,
                 max_key_rows: int = MAX_KEY_ROWS) -> DataFrame:
    """Add ``hit`` to every request.

    Equal times of one key are ordered by id: the first can be the miss, the rest
    are hits.  With ``succeeded`` (a boolean column) a miss fills the cache only
    when it succeeded; a failing request still hits while an entry is alive.
    """
    ttl = int(ttl_seconds * 1_000_000)
    keyed = df.withColumn("__key", entry_key(keys)).withColumn(
        "__us", F.unix_micros(F.col(ts).cast("timestamp")))
    filling = keyed if succeeded is None else keyed.where(F.col(succeeded))
    # First id per distinct time: narrow, combined before the shuffle.
    times = filling.groupBy("__key", "__us").agg(F.min(id_col).alias("__miss"))
    narrow = times.select("__key", "__us")
    hot = narrow.groupBy("__key").count().where(F.col("count") > max_key_rows).select("__key")
    if hot.isEmpty():
        misses = _follow_cold(narrow, ttl)
    else:
        narrow, hot = materialize(narrow, "ttl-times"), materialize(hot, "ttl-hot")
        misses = _follow_cold(narrow.join(hot, "__key", "left_anti"), ttl).unionByName(
            _follow_hot(narrow.join(hot, "__key", "left_semi"), ttl, max_key_rows))
    created = times.join(misses, ["__key", "__us"])
    if succeeded is None:
        rows = keyed.join(created, ["__key", "__us"], "left")
        hit = F.col("__miss").isNull() | (F.col("__miss") != F.col(id_col))
    else:
        # Misses are more than ttl apart, so a slot of that length holds at most one:
        # the entry a request may use was created in its own slot or in the one before.
        slot = F.floor(F.col("__us") / ttl).cast("bigint")
        entry = created.select("__key", slot.alias("__slot"), F.col("__us").alias("__c"),
                               F.col("__miss").alias("__m"))
        before = entry.select("__key", (F.col("__slot") + 1).alias("__slot"),
                              F.col("__c").alias("__pc"))
        rows = (keyed.withColumn("__slot", slot).join(entry, ["__key", "__slot"], "left")
                .join(before, ["__key", "__slot"], "left"))
        own = (F.col("__c") < F.col("__us")) | (
            (F.col("__c") == F.col("__us")) & (F.col("__m") < F.col(id_col)))
        hit = F.coalesce(own, F.lit(False)) | F.coalesce(
            F.col("__us") - F.col("__pc") <= ttl, F.lit(False))
    return rows.withColumn("hit", hit).select(*df.columns, "hit")


def _follow_cold(narrow: DataFrame, ttl: int) -> DataFrame:
    return narrow.groupBy("__key").applyInPandas(_follow_key(ttl), "__key string, __us bigint")


def cache_table(replayed: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """The cache after the replay: per key the last creation time and all hits."""
    return replayed.groupBy(*keys).agg(
        F.max(F.when(~F.col("hit"), F.col(ts))).alias("created_ts"),
        F.count_if("hit").alias("hits"))
