"""Pack token sequences into as few fixed-size sequences as possible, by linear grouping.

1. A document longer than the capacity is cut into pieces of the capacity; its
   first piece takes the remainder.
2. Pieces are counted per length.  Lengths are bounded by the capacity, so this
   histogram is bounded too, whatever the number of documents, and the plan is
   made from it alone.
3. Large lengths, in descending order, are dealt into groups of equal
   cardinality and rounded up to the largest length of their group.  For those
   few sizes, configurations (multisets of sizes that fit one sequence) are
   chosen one after another: the fullest one that holds the largest open size,
   used as often as the open counts allow.
4. The places of the configurations are filled with the real lengths of their
   groups, which leaves gaps.
5. Small pieces go, longest first, into the tightest gap that takes them
   (best fit); what fits nowhere opens new sequences.

The plan is a list of runs: "pieces number r to r+c of length L lie at offset o
of sequences s to s+c".  Its size depends on the capacity and the number of
groups, not on the documents.  Each piece finds its place from its number among
the pieces of its length, which is counted in salted parts, so that a length
that a third of all documents share is spread over many tasks.

Defined cases: null or empty texts consist of the end id alone; repeated rows
and rows with a null id are pieces of their own, placed like any other; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from incident_analytics.llm.rows import map_slices
from incident_analytics.llm.tokens import SLICE_BYTES, word_ids
from incident_analytics.session import materialize

CAPACITY = 1024
GROUPS = 512
SMALL = 256
SALT_ROWS = 4096
TEXTS = 2048


@dataclass(frozen=True)
class Run:
    """Pieces ``rank`` to ``rank + count - 1`` of ``length`` in sequences from ``sequence`` on."""
    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def group_sizes(counts: dict[int, int], groups: int) -> list[tuple[int, dict[int, int]]]:
    """(size, real lengths with counts) per group of equal cardinality, sizes descending."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    found: list[tuple[int, dict[int, int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                found.append((length, {}))
                room = each
            take = min(room, left)
            found[-1][1][length] = take
            room, left = room - take, left - take
    merged: dict[int, dict[int, int]] = {}
    for size, members in found:  # groups that start at the same length have the same size
        own = merged.setdefault(size, defaultdict(int))
        for length, n in members.items():
            own[length] += n
    return sorted(merged.items(), reverse=True)


def fullest(largest: int, sizes: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest configuration that holds ``largest``; larger sizes first among equals."""
    room = capacity - largest
    reach, steps = 1, []
    limit = (1 << (room + 1)) - 1
    for size in sizes:
        for _ in range(min(left[size] - (size == largest), room // size)):
            steps.append((size, reach))
            reach |= (reach << size) & limit
        if reach >> room:
            break
    fill = reach.bit_length() - 1
    chosen = defaultdict(int, {largest: 1})
    for size, before in reversed(steps):
        if not before >> fill & 1:
            chosen[size] += 1
            fill -= size
    return chosen


class Planner:
    """Builds the runs of a histogram; sequences are numbered as they are opened."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.runs: list[Run] = []
        self.placed: dict[int, int] = defaultdict(int)
        self.opened = 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (sequence, count)

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append(Run(length, self.placed[length], count, sequence, offset))
        self.placed[length] += count

    def open(self, lengths: list[int], count: int) -> None:
        """``count`` new sequences, each with one piece of every given length."""
        offset = 0
        for length in lengths:
            self.put(length, count, self.opened, offset)
            offset += length
        self.gaps[self.capacity - offset].append((self.opened, count))
        self.opened += count

    def configurations(self, counts: dict[int, int], groups: int) -> None:
        members = {size: sorted(m.items(), reverse=True)
                   for size, m in group_sizes(counts, groups)}
        left = {size: sum(n for _, n in m) for size, m in members.items()}
        while left:
            sizes = sorted(left, reverse=True)
            chosen = fullest(sizes[0], sizes, left, self.capacity)
            times = min(left[size] // n for size, n in chosen.items())
            for size, n in chosen.items():
                left[size] -= n * times
                if not left[size]:
                    del left[size]
            self._substitute(chosen, times, members)

    def _substitute(self, chosen: dict[int, int], times: int, members: dict) -> None:
        """Fill ``times`` sequences of a configuration with real lengths, in runs of equal ones."""
        while times:
            whole = min(members[size][0][1] // n for size, n in chosen.items())
            run = min(times, whole) or 1
            lengths = []
            for size, n in chosen.items():
                for _ in range(n):
                    length, open_count = members[size][0]
                    lengths.append(length)
                    if open_count > run:
                        members[size][0] = (length, open_count - run)
                    else:
                        members[size].pop(0)
            self.open(lengths, run)
            times -= run

    def best_fit(self, length: int, count: int) -> None:
        while count:
            gap = min((g for g in self.gaps if g >= length), default=None)
            if gap is None:
                each = self.capacity // length
                full, rest = divmod(count, each)
                if full:
                    self.open([length] * each, full)
                if rest:
                    self.open([length] * rest, 1)
                return
            sequence, n = self.gaps[gap].pop()
            take = min(n, count)
            if n > take:
                self.gaps[gap].append((sequence + take, n - take))
            if not self.gaps[gap]:
                del self.gaps[gap]
            self.put(length, take, sequence, self.capacity - gap)
            self.gaps[gap - length].append((sequence, take))
            count -= take


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS,
              small: int = SMALL) -> list[Run]:
    """Runs that place every piece of ``histogram`` (length to count, lengths 1 to capacity)."""
    planner = Planner(capacity)
    if histogram.get(capacity):
        planner.open([capacity], histogram[capacity])
    planner.configurations({k: n for k, n in histogram.items() if small < k < capacity and n}, groups)
    for length in sorted((k for k, n in histogram.items() if k <= small and k < capacity and n),
                         reverse=True):
        planner.best_fit(length, histogram[length])
    return planner.runs


PIECES = (StructField("piece", IntegerType()), StructField("start", LongType()),
          StructField("length", LongType()), StructField("ids_crc32", LongType()))


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of every document: number, place in the document, length, crc32 of its ids."""
    schema = StructType([docs.select(id_col).schema[0], *PIECES])

    def cut(names: list, texts: list) -> dict:
        ids, counts = word_ids(tokenizer_path).encode(texts, end_id)
        pieces = -(-counts // capacity)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(counts - (pieces - 1) * capacity, pieces)
        start = np.where(number == 0, 0, first + (number - 1) * capacity)
        length = np.where(number == 0, first, capacity)
        at = (np.repeat(np.cumsum(counts) - counts, pieces) + start).tolist()
        raw = memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at, length.tolist())]
        owner = np.repeat(np.arange(len(names)), pieces).tolist()
        return {id_col: [names[i] for i in owner], "piece": number, "start": start,
                "length": length, "ids_crc32": crc}

    return map_slices(docs.select(id_col, text_col), cut, schema, TEXTS, SLICE_BYTES)


def numbered_by_length(pieces: DataFrame, most: int, id_col: str) -> DataFrame:
    """Add ``rank``: numbers from 0 among the pieces of a length, counted in salted parts."""
    salts = 1 + most // SALT_ROWS
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
               .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("length", "salt").orderBy(id_col, "piece", "start", "ids_crc32")
    return (salted.withColumn("inside", F.row_number().over(inside) - 1)
            .join(offsets, ["length", "salt"])
            .withColumn("rank", F.col("base") + F.col("inside")).drop("salt", "inside", "base"))


def place(numbered: DataFrame, runs: list[Run]) -> DataFrame:
    """Look every (length, rank) up in the runs; adds ``sequence_id`` and ``offset``, drops ``rank``."""
    ordered = sorted(runs, key=lambda r: (r.length, r.rank))
    keys = np.array([(r.length << 48) + r.rank for r in ordered], np.int64)
    ranks, sequences, offsets = (np.array([getattr(r, f) for r in ordered], np.int64)
                                 for f in ("rank", "sequence", "offset"))
    kept = [c for c in numbered.columns if c != "rank"]
    schema = StructType([*(numbered.schema[c] for c in kept), StructField("sequence_id", LongType()),
                         StructField("offset", LongType())])
    arrow = to_arrow_schema(schema)

    def placed(batches):
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequences[at] + rank - ranks[at]),
                 pa.array(offsets[at])], schema=arrow)

    return numbered.mapInArrow(placed, schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS,
                small: int = SMALL, id_col: str = "doc_id") -> DataFrame:
    """Give every piece (columns id, ``piece``, ``start``, ``length``, ``ids_crc32``) its sequence and offset.

    Only the histogram, at most ``capacity`` rows, comes to the driver.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    numbered = numbered_by_length(pieces, max(histogram.values(), default=0), id_col)
    placed = place(numbered, plan_runs(histogram, capacity, groups, small))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY,
                     groups: int = GROUPS, small: int = SMALL, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Pieces of all documents of ``docs`` with their places; the texts are encoded once."""
    pieces = materialize(cut_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    return pack_pieces(pieces, capacity, groups, small, id_col)
