"""Building blocks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
_QUANTILES = 256
_SUPER = 1 << 10


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count ``df`` up to the bound; a caller broadcasts only when it fits."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast a side of checked size; otherwise adaptive execution decides
    (shuffle join, with its splitting of skewed partitions)."""
    return F.broadcast(df) if small else df


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """Repartition a plain scan that has fewer partitions than the cluster has cores.

    For scans of few, large files in front of work that is heavy on the processor;
    a scan with enough partitions is returned as it is.  Hashing on a unique key
    keeps the placement the same when a task is run again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on columns of both sides in which NULL equals NULL."""
    named = right.withColumnsRenamed({k: f"__right{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"__right{i}")) for i, k in enumerate(keys)]
    return left.join(named, same).drop(*(f"__right{i}" for i in range(len(keys))))


def sequence_numbers(df: DataFrame, order_col: str, keys: Sequence[str] = (),
                     out: str = "seq") -> DataFrame:
    """Dense numbers from 1 in the order of a unique BIGINT column.

    A single window would put a whole key (or, without keys, the whole table)
    into one task.  Instead the values are cut into blocks: at the approximate
    quantiles of ``order_col``, so that far outliers take no room from the others,
    and between two quantiles into equal widths.  Rows are ranked inside (key,
    block), and each block is shifted by the number of rows in the blocks before
    it.  Only block counts, never rows, are summed up across blocks.  A NULL key
    is a key of its own; rows with a NULL order value come first, in any order.
    """
    keys = list(keys)
    blocked = _with_block(df, order_col)

    counts = (blocked.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__super", F.floor(F.col("__block") / _SUPER)))
    before = (Window.unboundedPreceding, -1)
    supers = (counts.groupBy(*keys, "__super").agg(F.sum("__n").alias("__sn"))
              .withColumn("__base", F.coalesce(F.sum("__sn").over(
                  Window.partitionBy(*keys).orderBy("__super").rowsBetween(*before)), F.lit(0)))
              .drop("__sn"))
    offsets = (counts.withColumn("__in", F.coalesce(F.sum("__n").over(
        Window.partitionBy(*keys, "__super").orderBy("__block").rowsBetween(*before)), F.lit(0)))
        .transform(_join_null_safe, supers, [*keys, "__super"])
        .select(*keys, "__block", (F.col("__in") + F.col("__base")).alias("__offset")))

    rank = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(order_col))
    return (blocked.withColumn("__rank", rank)
            .transform(_join_null_safe, offsets, [*keys, "__block"])
            .withColumn(out, (F.col("__rank") + F.col("__offset")).cast("bigint"))
            .drop("__block", "__rank", "__offset"))


def _with_block(df: DataFrame, order_col: str) -> DataFrame:
    """Add ``__block``, rising with the value: its quantile, then its place between both quantiles.

    The quantiles are one array of 257 values, in which a value finds its own in
    eight halving steps.
    """
    o = F.col(order_col)
    found = df.agg(F.percentile_approx(o, [i / _QUANTILES for i in range(_QUANTILES + 1)], 20_000)).first()[0]
    if found is None:  # no value at all
        return df.withColumn("__block", F.lit(None).cast("bigint"))
    grid = F.lit(found)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(_QUANTILES.bit_length() - 1))])
    placed = df.withColumn("__q", F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(grid, at + step) <= o, at + step).otherwise(at)))
    low, high = F.get(grid, F.col("__q")).cast("double"), F.get(grid, F.col("__q") + 1).cast("double")
    inside = F.floor((o.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * _SUPER)
    place = F.greatest(F.lit(0), F.least(F.lit(_SUPER - 1), inside))
    return placed.withColumn("__block", F.when(o.isNotNull(), F.col("__q") * _SUPER + place).cast("bigint")).drop("__q")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str | Column,
                      probs: dict[str, float], resolution: int = 4096) -> DataFrame:
    """Nearest-rank percentiles per key, exact, without gathering a key's values.

    Equal values are counted first (spread over (key, value)); a histogram over a
    monotone logarithmic bucket finds the bucket that holds each rank; only the
    distinct values of that bucket are ordered.  ``probs`` maps the output column
    to a percentage: <= 0 is the minimum, >= 100 the maximum.
    """
    keys = list(keys)
    v = value if isinstance(value, Column) else F.col(value)
    grouped = [*keys] if keys else ["__all"]
    base = df.select(*([F.col(k) for k in keys] or [F.lit(0).alias("__all")]),
                     v.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    distinct = base.groupBy(*grouped, "__v").agg(F.count(F.lit(1)).alias("__n"))
    # Never NULL: the join below then adds no filter that would keep the counts from being reused.
    bucket = F.coalesce(F.floor(F.signum("__v") * F.log1p(F.abs("__v")) * resolution), F.lit(0))
    counted = distinct.withColumn("__b", bucket)

    per_key = Window.partitionBy(*grouped)
    running = per_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    hist = (counted.groupBy(*grouped, "__b").agg(F.sum("__n").alias("__bn"))
            .withColumn("__upto", F.sum("__bn").over(running))
            .withColumn("__total", F.sum("__bn").over(per_key)))
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("__p"), nearest_rank(F.col("__total"), pct).alias("__r"))
        for name, pct in probs.items()]))
    picks = (hist.select("*", wanted.alias("__w"))
             .select(*grouped, "__b", F.col("__w.__p").alias("__p"),
                     F.col("__w.__r").alias("__r"),
                     (F.col("__upto") - F.col("__bn")).alias("__below"), "__upto")
             .where((F.col("__r") > F.col("__below")) & (F.col("__r") <= F.col("__upto"))))

    inside = Window.partitionBy(*grouped, "__b", "__p").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, 0)
    found = (counted.join(picks, [*grouped, "__b"])
             .withColumn("__cum", F.col("__below") + F.sum("__n").over(inside))
             .where(F.col("__cum") >= F.col("__r")))
    return found.groupBy(*grouped).agg(*[
        F.min(F.when(F.col("__p") == name, F.col("__v"))).alias(name) for name in probs])


def nearest_rank(total: Column, pct: float) -> Column:
    """The rank of a percentage among ``total`` values: 1 for 0 and below, all for 100 and above."""
    if pct <= 0:
        return F.lit(1).cast("bigint")
    if pct >= 100:
        return total
    # Multiplied as decimals so that 95 % of 100 is 95 and never 95.00000000000001.
    rank = F.ceil(total.cast("decimal(20,0)") * F.lit(str(pct)).cast("decimal(9,6)") / 100)
    return F.greatest(F.lit(1).cast("bigint"), rank.cast("bigint"))


def heavy_keys(counts: DataFrame, key: str, n: str, share: int = 1000) -> DataFrame:
    """Keys that hold more than 1/``share`` of all rows, from a table of counts.

    There can be fewer than ``share`` of them, so the result may be broadcast.
    """
    total = counts.agg(F.sum(n)).scalar()
    return counts.where(F.col(n) * share > total).select(key)


def least_common_count(counts: DataFrame, n: str, max_rows: int) -> int:
    """A power of two such that at most ``max_rows`` keys of a table of counts are counted as often or more.

    Found from the number of keys per bit length of the count, at most 64 rows.
    """
    held, least = 0, 63
    bits = F.length(F.bin(F.col(n).cast("bigint")))
    for row in counts.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("keys")).orderBy(F.desc("bits")).collect():
        held += row["keys"]
        if held > max_rows:
            break
        least = row["bits"]
    return 1 << (least - 1)


def salted_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, spread: Column,
                how: str = "inner", salts: int = 64) -> DataFrame:
    """Equi-join on ``key`` with the rows of heavy keys spread over ``salts`` partitions.

    ``heavy`` comes from :func:`heavy_keys`; ``spread`` is a deterministic
    expression over the columns of ``left`` (never a random number, so a re-run
    task places its rows as before).  The matching rows of ``right`` are copied
    once per salt, for heavy keys only.
    """
    flag = F.broadcast(heavy.select(key, F.lit(True).alias("__heavy")))
    left_s = (left.join(flag, key, "left")
              .withColumn("__salt", F.when(F.col("__heavy"), F.pmod(F.xxhash64(spread), F.lit(salts)))
                          .otherwise(F.lit(0).cast("bigint"))).drop("__heavy"))
    copies = F.when(F.col("__heavy"), F.sequence(F.lit(0).cast("bigint"),
                                                 F.lit(salts - 1).cast("bigint"))) \
        .otherwise(F.array(F.lit(0).cast("bigint")))
    right_s = right.join(flag, key, "left").withColumn("__salt", F.explode(copies)).drop("__heavy")
    return left_s.join(right_s, [key, "__salt"], how).drop("__salt")
