"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE = 256
WHITESPACE = " \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table of the test folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


CARRIED = "__row"


def map_slices(df: DataFrame, fn: Callable[..., dict[str, list]], schema: StructType,
               rows: int = SLICE, text_bytes: int | None = None) -> DataFrame:
    """Apply ``fn`` to slices of ``rows`` rows, one list per column of ``df``, in Arrow batches.

    ``fn`` returns a dict of equally long lists or numpy arrays, one per field of
    ``schema``.  A task holds one Arrow batch and the Python values of one slice.
    With ``text_bytes`` a slice also ends where the values of the last column would
    pass that size (a longer value is a slice of its own).
    A last column ``__row`` (see :func:`carry`) is handed through untouched; then
    ``fn`` must return a row per row.
    """
    carried = df.columns[-1] == CARRIED
    if carried:
        schema = StructType([*schema.fields, df.schema[CARRIED]])
    arrow = to_arrow_schema(schema)
    width = len(df.columns) - carried

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = pc.fill_null(pc.binary_length(batch.column(width - 1)), 0).to_pylist() if text_bytes else None
        start = held = 0
        for i in range(1, batch.num_rows + 1):
            if size:
                held += size[i - 1]
            if i == batch.num_rows or i - start == rows or (size and held + size[i] > text_bytes):
                yield batch.slice(start, i - start)
                start, held = i, 0

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for part in cut(batch):
                out = fn(*(part.column(i).to_pylist() for i in range(width)))
                columns = [pa.array(out[f.name], type=f.type) for f in list(arrow)[:len(arrow) - carried]]
                yield pa.RecordBatch.from_arrays(
                    columns + [part.column(i) for i in range(width, part.num_columns)], schema=arrow)

    return df.mapInArrow(batches, schema)


def carry(df: DataFrame) -> Column:
    """The whole row as one struct, so that no column of it can clash with results."""
    return F.struct(*df.columns).alias(CARRIED)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan with fewer splits than the session has cores; else leave it.

    Without it a table in one file would be worked on by one task.  Rows are
    placed by the hash of ``keys``, so a task that is run again gets the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores, *keys)


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text, as the contracts of the queries deal folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
