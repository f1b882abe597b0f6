"""Reproducible stratified samples and splits.

Rows of a category are ordered by ``md5(seed:ticket_id)``, which does not depend
on partitioning.  Taking the first q rows of a category never sorts the category:
counts over 4096 hash prefixes locate the prefix that holds the q-th row, only
that prefix is ranked, and the hash found there is the cut-off that a plain
filter then applies to the wide rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_QUEUES, SEED, TEST_FRACTION, TRAIN_MAX_ROWS
from ..functions.text import classifier_text
from ..session import materialize
from .scale import broadcast_if, fits_broadcast

Quota = Callable[[Column, Column], Column]


def _order_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def _prefix(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 3), 16, 10).cast("int")


def _hashed(df: DataFrame, id_col: str, category: str, seed: int) -> DataFrame:
    h = F.col("__h")
    return (df.select(F.col(category).alias("__cat"), F.col(id_col).alias("__id"),
                      _order_hash(id_col, seed).alias("__h"))
            .where(F.col("__cat").isNotNull()).withColumn("__b", _prefix(h)))


def _histogram(hashed: DataFrame) -> DataFrame:
    """Rows per (category, hash prefix) with running and total counts."""
    per_cat = Window.partitionBy("__cat")
    upto = per_cat.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    return (hashed.groupBy("__cat", "__b").agg(F.count(F.lit(1)).alias("__n"))
            .withColumn("__upto", F.sum("__n").over(upto))
            .withColumn("__size", F.sum("__n").over(per_cat)))


def class_sizes(df: DataFrame, category: str = "category") -> DataFrame:
    return (df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("__cat"))
            .agg(F.count(F.lit(1)).alias("__size")))


def mark_first(df: DataFrame, id_col: str, category: str, seed: int, quota: Quota,
               flag: str = "__first") -> DataFrame:
    """Add a boolean: is the row among the first quota(class size, table size) of its class?"""
    # One row per class; checked before it is broadcast.
    small = fits_broadcast(df.select(category).distinct())
    hashed = _hashed(df, id_col, category, seed)
    hist = _histogram(hashed)
    total = class_sizes(df, category).agg(F.coalesce(F.sum("__size"), F.lit(0))).scalar()
    bounds = (hist.withColumn("__q", F.least(F.col("__size"), quota(F.col("__size"), total)))
              .where((F.col("__q") > F.col("__upto") - F.col("__n"))
                     & (F.col("__q") <= F.col("__upto")))
              .select("__cat", "__b", (F.col("__q") - F.col("__upto") + F.col("__n")).alias("__r")))
    inside = Window.partitionBy("__cat", "__b").orderBy("__h", "__id")
    cuts = (hashed.join(broadcast_if(bounds, small), ["__cat", "__b"])
            .withColumn("__k", F.row_number().over(inside)).where(F.col("__k") == F.col("__r"))
            .select(F.col("__cat").alias(category), F.col("__h").alias("__cut_h"),
                    F.col("__id").alias("__cut_id")))
    h = _order_hash(id_col, seed)
    first = (h < F.col("__cut_h")) | ((h == F.col("__cut_h")) & (F.col(id_col) <= F.col("__cut_id")))
    return (df.join(broadcast_if(cuts, small), category, "left")
            .withColumn(flag, F.coalesce(first, F.lit(False))).drop("__cut_h", "__cut_id"))


def _take(df: DataFrame, id_col: str, category: str, seed: int, quota: Quota) -> DataFrame:
    return mark_first(df, id_col, category, seed, quota).where("__first").drop("__first")


def stratified_rank(df: DataFrame, id_col: str = "ticket_id", category: str = "category",
                    seed: int = SEED, out: str = "rank") -> DataFrame:
    """The full seeded order: position of every row inside its category, from 1."""
    hist = (_histogram(_hashed(df, id_col, category, seed))
            .select(F.col("__cat").alias(category), "__b",
                    (F.col("__upto") - F.col("__n")).alias("__below")))
    inside = Window.partitionBy(category, "__b").orderBy("__h", id_col)
    return (df.where(F.col(category).isNotNull())
            .withColumn("__h", _order_hash(id_col, seed)).withColumn("__b", _prefix(F.col("__h")))
            .withColumn("__k", F.row_number().over(inside))
            .join(hist, [category, "__b"])
            .withColumn(out, (F.col("__k") + F.col("__below")).cast("bigint"))
            .drop("__h", "__b", "__k", "__below"))


def _share(rows: int) -> Quota:
    return lambda n, total: F.bround(n * (F.lit(float(rows)) / total)).cast("bigint")


def at_least_one(quota: Quota) -> Quota:
    return lambda n, total: F.greatest(F.lit(1).cast("bigint"), quota(n, total))


def kb_sample(df: DataFrame, rows: int, id_col: str = "ticket_id", category: str = "category",
              seed: int = SEED) -> DataFrame:
    """Cap the knowledge base at about ``rows`` (0 = all), in proportion; a class may get none."""
    if rows <= 0:
        return df
    return _capped(df, rows, id_col, category, seed, _share(rows))


def _capped(df: DataFrame, rows: int, id_col: str, category: str, seed: int, share: Quota) -> DataFrame:
    """A table of at most ``rows`` rows as it is, NULL categories included; else its shares."""
    size = df.agg(F.count(F.lit(1))).scalar()
    marked = mark_first(df, id_col, category, seed, share)
    return marked.where((size <= rows) | F.col("__first")).drop("__first")


def stratified_cap(df: DataFrame, max_rows: int, id_col: str = "ticket_id",
                   category: str = "category", seed: int = SEED) -> DataFrame:
    """Like :func:`kb_sample`, but every class keeps at least one row."""
    if max_rows <= 0:
        return df
    return _capped(df, max_rows, id_col, category, seed, at_least_one(_share(max_rows)))


def stratified_split(df: DataFrame, fraction: float = TEST_FRACTION, id_col: str = "ticket_id",
                     category: str = "category", seed: int = SEED) -> DataFrame:
    """Add ``split``: the first max(1, round(n * fraction)) rows of a class are 'test'."""
    quota = at_least_one(lambda n, total: F.bround(n * F.lit(float(fraction))).cast("bigint"))
    marked = mark_first(df, id_col, category, seed, quota)
    return (marked.withColumn("split", F.when(F.col("__first"), "test").otherwise("train"))
            .drop("__first"))


def _median_class(df: DataFrame, category: str) -> Column:
    """floor(median class size); reads one row per class."""
    return class_sizes(df, category).agg(
        F.floor(F.median("__size")).cast("bigint")).scalar()


def balance_to_median(df: DataFrame, id_col: str = "ticket_id", category: str = "category",
                      seed: int = SEED) -> DataFrame:
    """Cut every class down to the median class size."""
    cap = _median_class(df, category)
    return _take(df, id_col, category, seed, lambda n, total: F.least(n, cap))


def train_complement(df: DataFrame, test: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """The rows that are not in ``test``."""
    return df.join(test.select(id_col), id_col, "left_anti")


def split_checks(df: DataFrame, train: DataFrame, test: DataFrame,
                 id_col: str = "ticket_id") -> DataFrame:
    """One row: overlap of the parts, rows lost and rows invented (all should be 0)."""
    ids = lambda d: d.select(F.col(id_col))
    both = ids(train).unionByName(ids(test))
    parts = (ids(train).intersect(ids(test)).select(F.lit("overlap").alias("kind"))
             .unionByName(ids(df).exceptAll(both).select(F.lit("lost").alias("kind")))
             .unionByName(both.exceptAll(ids(df)).select(F.lit("invented").alias("kind"))))
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    return parts.agg(count("overlap"), count("lost"), count("invented"))


def label_index(df: DataFrame, category: str = "category") -> DataFrame:
    """Sorted distinct labels with ids from 0.

    Labels are range-partitioned; ranks are taken inside a partition and shifted
    by the partitions before it, so a long label list, also one with a common
    prefix, is never ordered in one task.
    """
    labels = df.where(F.col(category).isNotNull()).select(F.col(category).alias("label")).distinct()
    labels = materialize(labels.repartitionByRange("label").withColumn("__l", F.spark_partition_id()),
                         "labels")
    sizes = (labels.groupBy("__l").agg(F.count(F.lit(1)).alias("__n"))
             .withColumn("__before", F.coalesce(F.sum("__n").over(
                 Window.orderBy("__l").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    inside = Window.partitionBy("__l").orderBy("label")
    return (labels.withColumn("__k", F.row_number().over(inside)).join(sizes, "__l")
            .select("label", (F.col("__k") - 1 + F.col("__before")).cast("bigint").alias("label_id")))


def resolve_labels(spark: SparkSession, saved: DataFrame | None = None, train: DataFrame | None = None,
                   default: Sequence[str] = DEFAULT_QUEUES, category: str = "category") -> DataFrame:
    """(label, label_id) of a classifier: the saved labels, else those of the training
    rows, else the given default; an empty source counts as missing."""
    for source in (saved, train):
        if source is not None:
            column = category if category in source.columns else source.columns[0]
            found = label_index(source, column)
            if not found.isEmpty():
                return found
    return _given_labels(spark, default)


def known_labels_filter(df: DataFrame, labels: DataFrame | Sequence[str],
                        category: str = "category") -> DataFrame:
    """Drop rows whose category is not a known label."""
    if isinstance(labels, DataFrame):
        side = labels.select(F.col(labels.columns[0]).alias(category)).distinct()
        return df.join(broadcast_if(side, fits_broadcast(side)), category, "left_semi")
    return df.where(F.col(category).isin(*labels))


def unknown_label_count(df: DataFrame, labels: DataFrame | Sequence[str],
                        category: str = "category") -> DataFrame:
    """One row: how many rows :func:`known_labels_filter` keeps and drops."""
    kept = known_labels_filter(df, labels, category).agg(F.count(F.lit(1))).scalar()
    return (df.agg(F.count(F.lit(1)).alias("n_rows"))
            .select("n_rows", kept.alias("kept"), (F.col("n_rows") - kept).alias("dropped")))


def training_set(df: DataFrame, labels: DataFrame | Sequence[str] | None = None,
                 max_rows: int = TRAIN_MAX_ROWS, balanced: bool = False, seed: int = SEED,
                 id_col: str = "ticket_id", category: str = "category") -> DataFrame:
    """Known labels, then (optionally) median balance, then the proportional cap.

    Balance and cap use the same seeded order, so both together are one quota per
    class and need one pass instead of two.
    """
    known = df.where(F.col(category).isNotNull())
    if labels is not None:
        known = known_labels_filter(known, labels, category)
    if balanced or max_rows > 0:
        cap = _median_class(known, category) if balanced else None
        sizes = class_sizes(known, category)
        left = F.least(F.col("__size"), cap) if balanced else F.col("__size")
        pool = sizes.agg(F.coalesce(F.sum(left), F.lit(0))).scalar()

        def quota(n: Column, total: Column) -> Column:
            kept = F.least(n, cap) if balanced else n
            if max_rows <= 0:
                return kept
            share = F.bround(kept * (F.lit(float(max_rows)) / pool)).cast("bigint")
            return F.when(pool <= max_rows, kept).otherwise(
                F.greatest(F.lit(1).cast("bigint"), share))

        known = _take(known, id_col, category, seed, quota)
    ids = (label_index(known, category) if labels is None
           else _given_labels(df.sparkSession, labels)).withColumnRenamed("label", category)
    return (known.join(broadcast_if(ids, fits_broadcast(ids)), category)
            .select(id_col, classifier_text(F.col("title"), F.col("description")).alias("text"),
                    category, "label_id"))


def _given_labels(spark: SparkSession, labels: DataFrame | Sequence[str]) -> DataFrame:
    if isinstance(labels, DataFrame):
        return label_index(labels.select(F.col(labels.columns[0]).alias("label")), "label")
    rows = [F.struct(F.lit(name).alias("label"), F.lit(i).cast("bigint").alias("label_id"))
            for i, name in enumerate(sorted(labels))]
    return spark.range(1).select(F.inline(F.array(*rows)))
