"""Token ids in binary files: blocks of ids split into planes, each plane compressed by itself.

A file holds the ids of consecutive documents in ascending id order::

    "TOKPLAN1"  compressed planes of block 0, block 1, ...  footer  footer length (8 bytes)  "TOKPLAN1"

The ids are cut into blocks of a fixed number of ids across document borders.
A block is written as its four byte planes (byte k of every id) or its 32 bit
planes (bit k of every id, packed), so the high planes, which are nearly
constant, shrink to a few bytes.  Each plane is a zstandard frame.  The footer
is a zstandard frame too and holds the chunk index (length of every plane of
every block), the document ids and the number of ids per document; with it one
document is read by decompressing only the blocks it lies in.

Defined cases: null text is an empty text (its ids are the end id alone); rows
with a null id come first; rows that share an id stay separate, ordered by text;
an empty table gives no file and no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from incident_analytics.llm.files import create, new_name, open_random
from incident_analytics.llm.tokens import byte_slices, word_ids
from incident_analytics.session import materialize, scratch_path

MAGIC = b"TOKPLAN1"
BLOCK_IDS = 1 << 16
LEVEL = 3
MANIFEST = StructType([
    StructField("path", StringType()), StructField("first_id", LongType()),
    StructField("n_docs", LongType()), StructField("n_ids", LongType()),
    StructField("n_bytes", LongType())])


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """Split 32-bit ids into 4 byte planes or 32 packed bit planes, lowest first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [rows[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """Undo :func:`to_planes`; the number of planes tells the unit."""
    if len(planes) == 4:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").ravel()


class PlaneWriter:
    """Streams ids into one file; holds one block and the document table."""

    def __init__(self, out, unit: str = "byte", block_ids: int = BLOCK_IDS) -> None:
        self.out, self.unit, self.block_ids = out, unit, block_ids
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.index: list[int] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        out.write(MAGIC)
        self.n_bytes = len(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.counts += counts.tolist()
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block_ids:
            rest = np.concatenate(self.waiting)
            whole = len(rest) // self.block_ids * self.block_ids
            for start in range(0, whole, self.block_ids):
                self._block(rest[start:start + self.block_ids])
            self.waiting, self.n_waiting = [rest[whole:]], len(rest) - whole

    def _put(self, data: bytes) -> int:
        frame = self.pack.compress(data)
        self.out.write(frame)
        self.n_bytes += len(frame)
        return len(frame)

    def _block(self, ids: np.ndarray) -> None:
        self.index += [self._put(p) for p in to_planes(ids, self.unit)]

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        names = np.array([d or 0 for d in self.doc_ids], "<i8")
        footer = b"".join([
            struct.pack("<QIIQ", self.n_ids, self.block_ids, 4 if self.unit == "byte" else 32,
                        len(names)),
            np.array(self.index, "<u4").tobytes(), names.tobytes(), known.tobytes(),
            np.array(self.counts, "<u8").tobytes()])
        size = self._put(footer)
        self.out.write(struct.pack("<Q", size) + MAGIC)
        self.n_bytes += 8 + len(MAGIC)


class PlaneReader:
    """Reads a file of :class:`PlaneWriter` block by block or document by document."""

    def __init__(self, source) -> None:
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 8 - len(MAGIC))
        end = source.read()
        if end[8:] != MAGIC:
            raise ValueError("not a token plane file")
        length = struct.unpack("<Q", end[:8])[0]
        source.seek(size - 8 - len(MAGIC) - length)
        footer = self.unpack.decompress(source.read(length))
        self.n_ids, self.block_ids, self.n_planes, docs = struct.unpack_from("<QIIQ", footer)
        blocks = -(-self.n_ids // self.block_ids)
        at = struct.calcsize("<QIIQ")
        self.index = np.frombuffer(footer, "<u4", blocks * self.n_planes, at).reshape(blocks, -1)
        at += self.index.nbytes
        names = np.frombuffer(footer, "<i8", docs, at)
        at += names.nbytes
        known = np.frombuffer(footer, np.uint8, docs, at)
        self.doc_ids = [n if k else None for n, k in zip(names.tolist(), known.tolist())]
        self.counts = np.frombuffer(footer, "<u8", docs, at + docs).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        sizes = self.index.sum(axis=1, dtype=np.int64)
        self.block_at = len(MAGIC) + np.cumsum(sizes) - sizes

    def block(self, k: int) -> np.ndarray:
        self.source.seek(int(self.block_at[k]))
        data = self.source.read(int(self.index[k].sum()))
        cuts = np.append(0, np.cumsum(self.index[k], dtype=np.int64)).tolist()
        n = int(min(self.block_ids, self.n_ids - k * self.block_ids))
        return from_planes([self.unpack.decompress(data[a:b]) for a, b in zip(cuts, cuts[1:])], n)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file, from the blocks it lies in."""
        a, n = int(self.starts[i]), int(self.counts[i])
        if not n:
            return np.empty(0, "<u4")
        first, last = a // self.block_ids, (a + n - 1) // self.block_ids
        ids = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return ids[a - first * self.block_ids:][:n]

    def checksums(self) -> Iterator[int]:
        """crc32 of the ids of every document, in file order; one block in memory at a time."""
        k, ids, at = -1, np.empty(0, "<u4"), 0
        for n in self.counts.tolist():
            crc = 0
            while n:
                if at == len(ids):
                    k, at = k + 1, 0
                    ids = self.block(k)
                part = ids[at:at + n]
                crc = zlib.crc32(np.ascontiguousarray(part).tobytes(), crc)
                at, n = at + len(part), n - len(part)
            yield crc


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, unit: str = "byte",
                      id_col: str = "doc_id", text_col: str = "text",
                      block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode ``docs`` into files of ascending ids; returns the committed manifest, a row per file.

    The texts are range-partitioned by id before they are encoded, so that the
    sampling of the ranges reads ids and never runs the tokenizer.
    """
    folder = scratch_path(docs.sparkSession, "token-planes")
    arrow = to_arrow_schema(MANIFEST)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer_path)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = new_name(folder, ".tokens")
        with create(path) as out:
            writer = PlaneWriter(out, unit, block_ids)
            batch = first
            while batch is not None:
                for start, rows in byte_slices(batch.column(1)):
                    part = batch.slice(start, rows)
                    writer.add(part.column(0).to_pylist(), *encoder.encode(part.column(1), end_id))
                batch = next(batches, None)
            writer.close()
        yield pa.RecordBatch.from_pylist([{
            "path": path, "first_id": first.column(0)[0].as_py(), "n_docs": len(writer.counts),
            "n_ids": writer.n_ids, "n_bytes": writer.n_bytes}], schema=arrow)

    ordered = (docs.select(F.col(id_col).cast("bigint"), text_col).repartitionByRange(id_col)
               .sortWithinPartitions(id_col, text_col))
    return materialize(ordered.mapInArrow(written, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, start among all ids, number of ids and their crc32.

    Files are read in parallel, a task per file; only the manifest (a row per
    file) is put in order as a whole.
    """
    schema = StructType([StructField(id_col, LongType()), StructField("start", LongType()),
                         StructField("n_tokens", LongType()), StructField("ids_crc32", LongType()),
                         StructField("file_row", IntegerType())])
    arrow = to_arrow_schema(schema)
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "path").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_random(path) as source:
                    reader = PlaneReader(source)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(reader.doc_ids, pa.int64()), pa.array(base + reader.starts),
                        pa.array(reader.counts), pa.array(list(reader.checksums()), pa.int64()),
                        pa.array(np.arange(len(reader.counts), dtype=np.int32))], schema=arrow)

    return placed.repartition(max(1, files), "path").mapInArrow(read, schema)
