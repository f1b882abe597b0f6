"""Alignment of two tokenizers over the same texts, by as-of merges of their byte offsets.

Both tokenizers cut the bytes of a blank and the text.  In every slice of texts
the tokens of either side are rows (document, start), and ``pandas.merge_asof``,
keyed by document, gives for each token the token of the other side that covers
its first byte.  The union of both directions is the set of overlapping pairs;
offsets where tokens of both sides end cut the text into groups.

How many documents hold an id pair is summed over the corpus.  Pairs are counted
per slice, merged per task, and aggregated by Spark; the counts go into sorted
files of a bounded number of pairs, a file per range of codes.  A task looks its
slices up in one such file after the other, so its memory does not depend on how
many different pairs there are, and no pair is shuffled per document.

Defined cases: null and empty texts, and texts whose tokens of either side do
not join to exactly the blank and the text (for example a character that the
other vocabulary replaces), have no tokens: all numbers are zero and the digest
is ''; strings of special tokens are ordinary text; rows with a null id and rows
that share an id are documents of their own; an empty table gives an empty
result; a text is aligned whole, whatever its length, and a very long one is a
slice of its own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (ArrayType, BinaryType, LongType, StringType, StructField, StructType)

from incident_analytics.llm.files import create, new_name, open_random
from incident_analytics.llm.tokens import byte_alphabet, byte_slices, spans, word_ids
from incident_analytics.session import materialize, scratch_path

SLICE_BYTES = 1 << 20
MERGED_PAIRS = 1 << 21
FILE_PAIRS = 1 << 21
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class TokenBytes:
    """The bytes of every id of a vocabulary, flat."""

    def __init__(self, entries: list[bytes]) -> None:
        self.length = np.array([len(e) for e in entries], np.int32)
        self.begin = np.cumsum(self.length, dtype=np.int32) - self.length
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spans(self.begin[ids], self.length[ids])]


def byte_level_entries(tokenizer) -> list[bytes]:
    """Entry bytes by id of a byte-level vocabulary."""
    back = {c: b for b, c in byte_alphabet().items()}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    entries = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        entries[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
    return entries


def piece_entries(model) -> list[bytes]:
    """Piece bytes by id: U+2581 is a blank and <0xHH> the byte HH."""
    found = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        one = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        found.append(bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode())
    return found


class Aligner:
    """Both tokenizers of a worker, and what they make of a slice of texts."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        self.a = word_ids(path_a, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = TokenBytes(byte_level_entries(self.a.tokenizer))
        self.bytes_b = TokenBytes(piece_entries(self.b))
        # Decimal ids followed by each of the separators ',', '|' and ';'.
        self.most = max(len(self.bytes_a.length), len(self.bytes_b.length))
        self.names = np.array([f"{i}{s}" for s in ",|;" for i in range(self.most)], object)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and counts per text of both sides; nothing for texts that either side does not reproduce."""
        filled = pc.fill_null(texts, "")
        given = pc.if_else(pc.equal(filled, ""), "", pc.binary_join_element_wise(" ", filled, ""))
        ids_a, n_a = self.a.encode(given)
        lists = self.b.encode(filled.to_pylist(), num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        ids_b = np.fromiter((x for ids in lists for x in ids), np.int32, int(n_b.sum()))
        size = pc.binary_length(given).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.frombuffer(b"".join(given.cast(pa.binary()).to_pylist()), np.uint8)
        good = size > 0
        for ids, n, entries in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)):
            good &= _sums(entries.length[ids], n) == size
        for ids, n, entries in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)):
            wrong = np.flatnonzero(entries.join(ids[np.repeat(good, n)]) != raw[np.repeat(good, size)])
            good[np.searchsorted(np.cumsum(np.where(good, size, 0)), wrong, side="right")] = False
        return (ids_a[np.repeat(good, n_a)], np.where(good, n_a, 0),
                ids_b[np.repeat(good, n_b)], np.where(good, n_b, 0))

    def align(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        """Per text the counts, digest and distinct linked pairs (code ``a * 65536 + b``) with their repeats."""
        ids_a, n_a, ids_b, n_b = self.encode(texts)
        docs = len(n_a)
        doc_a, doc_b = np.repeat(np.arange(docs), n_a), np.repeat(np.arange(docs), n_b)
        # Offsets run on over the texts of the slice: both sides reach the same end of every text.
        end_a, end_b = (np.cumsum(e.length[i], dtype=np.int64) for e, i in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)))
        left = pd.DataFrame({"doc": doc_a, "start": end_a - self.bytes_a.length[ids_a], "a": np.arange(len(ids_a))})
        right = pd.DataFrame({"doc": doc_b, "start": end_b - self.bytes_b.length[ids_b], "b": np.arange(len(ids_b))})
        ab = pd.merge_asof(left, right, on="start", by="doc")
        ba = pd.merge_asof(right, left.assign(begun=left["start"]), on="start", by="doc")
        ba = ba[ba["begun"] < ba["start"]]  # equal starts are in the other direction
        link_a = np.concatenate([ab["a"].to_numpy(), ba["a"].to_numpy()]).astype(np.int64)
        link_b = np.concatenate([ab["b"].to_numpy(), ba["b"].to_numpy()]).astype(np.int64)
        link_doc = doc_a[link_a]
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        # A document's groups are the common ends up to its own last byte.
        upto = np.searchsorted(common, np.cumsum(_sums(self.bytes_a.length[ids_a], n_a)), side="right")
        code = ids_a[link_a].astype(np.int64) << 16 | ids_b[link_b]
        entry, repeats = np.unique(link_doc << 32 | code, return_counts=True)
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(upto, prepend=0),
                "n_links": np.bincount(link_doc, minlength=docs),
                "groups_sha256": self._digests(ids_a, n_a, ids_b, n_b, end_a, end_b, common),
                "entry_doc": entry >> 32, "entry_code": (entry & 0xFFFFFFFF).astype(np.uint32), "repeats": repeats}

    def _digests(self, ids_a, n_a, ids_b, n_b, end_a, end_b, common) -> list[str]:
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        per_a, per_b = (np.bincount(g, minlength=len(common)) for g in (group_a, group_b))
        first = np.cumsum(per_a + per_b) - per_a - per_b
        place_a = first[group_a] + np.arange(len(ids_a)) - (np.cumsum(per_a) - per_a)[group_a]
        place_b = (first + per_a)[group_b] + np.arange(len(ids_b)) - (np.cumsum(per_b) - per_b)[group_b]
        kind = np.empty(len(ids_a) + len(ids_b), np.int64)
        kind[place_a], kind[place_b] = ids_a, ids_b
        kind[first + per_a - 1] += self.most
        kind[first + per_a + per_b - 1] += 2 * self.most
        names = self.names[kind].tolist()
        found, at = [], 0
        for n in (n_a + n_b).tolist():
            found.append(hashlib.sha256("".join(names[at:at + n])[:-1].encode()).hexdigest() if n else "")
            at += n
        return found


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner; see :func:`word_ids` for where it is kept."""
    kept = sys.__dict__.setdefault("_incident_analytics_aligners", {})
    if (path_a, path_b) not in kept:
        kept[path_a, path_b] = Aligner(path_a, path_b)
    return kept[path_a, path_b]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of ``counts`` values."""
    upto = np.append(0, np.cumsum(values, dtype=np.int64))
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


def _pack(values: np.ndarray, dtype: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, dtype).tobytes())


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def aligned_slices(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """A row per slice of texts: arrays with a value per document, and the linked pairs packed.

    ``codes`` are the different pairs of the slice, ``held`` how many of its
    documents hold each; ``entries`` counts the different pairs per document, and
    ``at`` and ``repeats`` give their places in ``codes`` and their occurrences.
    """
    longs = ArrayType(LongType())
    schema = StructType([StructField("ids", longs), *(StructField(c, longs) for c in _COUNTS),
                         StructField("groups_sha256", ArrayType(StringType())), StructField("entries", longs),
                         *(StructField(c, BinaryType()) for c in ("codes", "held", "at", "repeats"))])
    arrow = to_arrow_schema(schema)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        for batch in batches:
            for start, rows in byte_slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(start, rows)
                found = tool.align(part.column(1))
                codes, at, held = np.unique(found["entry_code"], return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip([
                    part.column(0).to_pylist(), *(found[c].tolist() for c in _COUNTS), found["groups_sha256"],
                    np.bincount(found["entry_doc"], minlength=rows).tolist(), _pack(codes, "<u4"),
                    _pack(held, "<u4"), _pack(at, "<u4"), _pack(found["repeats"], "<u4")], arrow)], schema=arrow)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(made, schema)


def pair_counts(slices: DataFrame, merged: int = MERGED_PAIRS) -> DataFrame:
    """``code``, ``docs`` (documents that hold the pair) and ``best`` (no pair of its first id has more)."""
    schema = pa.schema([("code", pa.int64()), ("docs", pa.int64())])

    def merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for codes, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((_unpack(codes, "<u4"), _unpack(docs, "<u4")))
                size += len(held[-1][0])
                if size > merged:
                    held = [merge(held)]
                    size = len(held[0][0])
                    if size > merged // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in held[0]], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in merge(held)], schema=schema)

    counts = (slices.select("codes", "held").mapInArrow(summed, "code bigint, docs bigint")
              .groupBy("code").agg(F.sum("docs").alias("docs")))
    # An id meets at most as many pairs as the other vocabulary has ids.
    most = F.max("docs").over(Window.partitionBy(F.shiftright("code", 16)))
    return counts.withColumn("best", F.col("docs") == most)


def count_files(counts: DataFrame, most: int = FILE_PAIRS) -> list[tuple[str, int]]:
    """Write the counts as files of consecutive codes; (path, first code) in order of codes."""
    folder = scratch_path(counts.sparkSession, "pair-counts")
    counts = materialize(counts, "pair-table")
    arrow = pa.schema([("path", pa.string()), ("first", pa.int64())])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [np.empty(0, np.int64)]
        docs = [np.empty(0, np.int64)]
        for batch in batches:
            codes.append(batch.column(0).to_numpy())
            docs.append(batch.column(1).to_numpy() << 1 | batch.column(2).to_numpy(zero_copy_only=False))
        code, value = np.concatenate(codes), np.concatenate(docs)
        if len(code):
            path = new_name(folder, ".pairs")
            with create(path) as out:
                out.write(zstandard.ZstdCompressor(level=1).compress(
                    code.astype("<i8").tobytes() + value.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([int(code[0])])], schema=arrow)

    files = 1 + counts.count() // most
    ranged = counts.repartitionByRange(files, "code").sortWithinPartitions("code")
    rows = materialize(ranged.mapInArrow(written, "path string, first bigint"), "pair-files").collect()
    return sorted(((r.path, r["first"]) for r in rows), key=lambda f: f[1])


def _read_counts(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The sorted codes of a file and their values; the last file read stays with the worker."""
    kept = sys.__dict__.setdefault("_incident_analytics_pairs", {})
    if path not in kept:
        kept.clear()
        with open_random(path) as source:
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read()), "<i8")
        kept[path] = tuple(data.reshape(2, -1))
    return kept[path]


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, tokens of both sides, groups, links, and how common its links are.

    ``n_best`` counts the links whose pair no other pair of the same first id
    exceeds in documents; ``count_sum`` adds the documents of every link's pair;
    ``groups_sha256`` is the digest of the groups written as ``a1,a2|b1;a3|b2``.
    """
    slices = materialize(aligned_slices(docs, path_a, path_b, id_col, text_col), "aligned-slices")
    files = count_files(pair_counts(slices))
    schema = StructType([StructField(id_col, LongType()), *(StructField(c, LongType()) for c in _COUNTS),
                         StructField("n_best", LongType()), StructField("count_sum", LongType()),
                         StructField("groups_sha256", StringType())])
    arrow = to_arrow_schema(schema)
    last = [first for _, first in files[1:]]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_unpack(c, "<u4").astype(np.int64) for c in batch.column("codes").to_pylist()]
            values = [np.empty(len(c), np.int64) for c in codes]
            cuts = [np.append(np.append(0, np.searchsorted(c, last)), len(c)) for c in codes]
            for k, (path, _) in enumerate(files):
                known, value = _read_counts(path)
                for c, v, cut in zip(codes, values, cuts):
                    a, b = cut[k], cut[k + 1]
                    v[a:b] = value[np.searchsorted(known, c[a:b])]
            for i, value in enumerate(values):
                at, repeats = (_unpack(batch.column(c)[i].as_py(), "<u4") for c in ("at", "repeats"))
                entries = np.array(batch.column("entries")[i].as_py(), np.int64)
                found = value[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, *(batch.column(c)[i].values for c in _COUNTS),
                     pa.array(_sums(repeats * (found & 1), entries)),
                     pa.array(_sums(repeats * (found >> 1), entries)), batch.column("groups_sha256")[i].values],
                    schema=arrow)

    return slices.mapInArrow(looked_up, schema)
