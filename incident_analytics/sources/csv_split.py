"""Multi-line CSV files read by many tasks each.

A quoted field may hold line breaks, so whether a line begins a record depends on
all quotes before it.  But a stretch of a file only matters as a function of two
states: it ends inside quotes exactly when it began so and has an even number of
quotes, or began outside and has an odd one.  So one pass counts the quotes of
every split, a sum over the splits gives the state each begins in, and the second
pass cuts every split into records from its true state.  At most the first and
the last record of a split are fragments; they are joined across splits.

Holds for files in which a field with quotes is itself quoted and its quotes are
doubled; lines end with a line feed, with or without a carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scale import fits_broadcast
from ..session import materialize

_RECORDS = "file string, start bigint, place bigint, open boolean, record string"


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Lines in file order inside each split; only line feeds end a line."""
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    "value"))


def split_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside): whether a split begins inside quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of the splits of a task; ``place`` -1 is what goes on from the split before, ``open`` goes on after."""
    split, held, place = None, [], 0

    def rows(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["file", "start", "place", "open", "record"])

    for batch in batches:
        found = []
        for file, start, inside, value in batch.itertuples(index=False):
            if (file, start) != split:
                if held:
                    found.append((*split, place, True, "\n".join(held)))
                split, held, place = (file, start), [], -1 if inside else 0
                within = inside
            held.append(value)
            within ^= value.count('"') % 2 == 1
            if not within:
                found.append((*split, place, False, "\n".join(held)))
                held, place = [], place + 1
        if found:
            yield rows(found)
    if held:
        yield rows([(*split, place, True, "\n".join(held))])


def records(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(file, start, place, record): the raw records, in order of (file, start, place); empty lines left out."""
    lines = _lines(spark, path, pattern)
    states = materialize(split_states(lines), "csv-states")
    # One row per split; counted before it is broadcast, which keeps the lines in order.
    if not fits_broadcast(states):
        raise ValueError("more splits than can be broadcast: raise spark.sql.files.maxPartitionBytes")
    known = lines.join(F.broadcast(states), ["file", "start"]).select("file", "start", "inside", "value")
    pieces = materialize(known.mapInPandas(_cut, _RECORDS), "csv-records")
    whole = pieces.where((F.col("place") >= 0) & ~F.col("open")).select("file", "start", "place", "record")
    # At most two fragments per split: they are numbered by the record they belong to.
    parts = pieces.where((F.col("place") < 0) | F.col("open"))
    so_far = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    grouped = parts.withColumn("of", F.count_if(F.col("place") >= 0).over(so_far)).groupBy("file", "of").agg(
        F.array_sort(F.collect_list(F.struct("start", "place", "record"))).alias("p"))
    joined = grouped.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["place"].alias("place"),
                            F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    return whole.unionByName(joined).where(F.trim(F.replace("record", F.lit("\r"), F.lit(""))) != "")


def numbered(found: DataFrame) -> DataFrame:
    """Add ``row``: the position of a record in its file (the header is row 0) and ``base``, the rows of files before."""
    splits = found.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file").orderBy("start").rowsBetween(*before)
    files = splits.groupBy("file").agg((F.sum("n") - 1).alias("data")).select(
        "file", F.coalesce(F.sum("data").over(Window.orderBy("file").rowsBetween(*before)), F.lit(0)).alias("base"))
    shifts = splits.withColumn("shift", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(files, "file")
    rank = F.row_number().over(Window.partitionBy("file", "start").orderBy("place")) - 1
    return (found.withColumn("rank", rank).join(shifts.select("file", "start", "shift", "base"), ["file", "start"])
            .select("file", (F.col("rank") + F.col("shift")).alias("row"), "base", "record"))
