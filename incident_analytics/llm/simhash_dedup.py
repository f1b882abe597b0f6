"""Near-duplicates by SimHash fingerprints, with pairs discarded by pivot distance tables.

1. The fingerprint of a text has a bit set where more than half of its shingle
   hashes (repeats counted) have it set.  Equal fingerprints form one class,
   represented by its smallest id.
2. Beside every fingerprint its Hamming distances to fixed reference
   fingerprints (pivots) are stored.  Two fingerprints that differ in at most r
   bits have distances to any pivot that differ by at most r.
3. The distances of unrelated fingerprints lie close together, so they cannot
   deal the classes to tasks.  That is done by blocks: of b blocks of bits, at
   least b - r are equal in a linked pair, so the classes meet under the values
   of every choice of b - r blocks, and no link is lost.  The number of blocks
   follows the number of classes, so that a bucket of unrelated ones stays small.
4. A bucket becomes packed chunks of a bounded number of members.  A crowded
   bucket is first dealt to cells of the distances to some pivots, and two chunks
   meet only when all their ranges of distances come within r of each other.
   Inside a chunk or pair of chunks the pairs whose largest coordinate difference
   exceeds r are discarded, and the survivors verified on the fingerprints.  Out
   of a comparison comes one row per linked member (to the smallest member of its
   part), never a row per pair.
5. The links are closed to components.

Defined cases: a text with fewer words than a shingle is one shingle; a null
text, or one without words, has fingerprint zero and is linked like any other;
rows with a null id have a fingerprint and a null component; rows that share an
id are one document, linked through the fingerprint of each row; an empty table
gives an empty result; texts are hashed whole, in runs of bounded length; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from incident_analytics.llm.components import components
from incident_analytics.llm.rows import map_slices
from incident_analytics.operators.scale import heavy_keys
from incident_analytics.session import materialize

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
PIVOTS = 16
CELL_PIVOTS = 3
CHUNK = 1024
BUCKET = 256
_RUN = 1 << 15


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint (unsigned) of the space-joined ``k``-word shingles of a text (A-Z lower-cased)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = min(k, len(words))
    begin = np.append(0, ends[:len(words) - n] + 1).tolist()
    end = ends[n - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begin), _RUN):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[at:at + _RUN], end[at:at + _RUN])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begin), bitorder="little").view("<u8")[0])


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed random ones."""
    return np.random.default_rng(20250311).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def fingerprints(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, ``fp`` (the fingerprint as a signed BIGINT) and ``near``, a byte of distance per pivot."""
    schema = StructType([StructField(id_col, LongType()), StructField("fp", LongType()),
                         StructField("near", BinaryType())])
    refs = pivots()

    def made(ids: list, texts: list) -> dict:
        fps = np.array([fingerprint(t, k) for t in texts], np.uint64)
        table = np.bitwise_count(fps[:, None] ^ refs[None, :])
        return {id_col: ids, "fp": fps.view(np.int64), "near": [row.tobytes() for row in table]}

    return map_slices(docs.select(F.col(id_col).cast("bigint"), text_col), made, schema)


def block_masks(blocks: int) -> list[int]:
    """The bits of each of ``blocks`` nearly equal runs of the 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def enough_blocks(classes: int, radius: int, bucket: int) -> int:
    """The least number of blocks whose equal ones leave at most ``bucket`` unrelated classes together."""
    blocks = radius + 1
    while blocks < 3 * radius and classes >> (64 * (blocks - radius) // blocks) > bucket:
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_entries(classes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """One row per class and choice of blocks: (``choice``, ``value``) names the bucket."""
    masks = block_masks(blocks)
    chosen = [_signed(sum(c)) for c in combinations(masks, blocks - radius)]
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in chosen))).alias("choice", "value")
    return classes.select("id", "fp", "near", keys)


def packed_chunks(entries: DataFrame, chunk: int) -> DataFrame:
    """Buckets of two or more members as rows of arrays of at most about ``chunk`` members.

    A crowded bucket is dealt to cells by the distances to some pivots, and a
    crowded cell by the hash of its fingerprints; ``low`` and ``high`` are the
    ranges of distances in a chunk.
    """
    sizes = entries.groupBy("choice", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    near = [F.conv(F.hex(F.substring("near", i + 1, 1)), 16, 10).cast("int") for i in range(PIVOTS)]
    # Crowded buckets hold more than `chunk` members each; the join is left to adaptive execution.
    members = entries.join(sizes, ["choice", "value"])
    crowded = F.col("n") > chunk
    cell = sum((near[i] / 6).cast("int") * 16 ** i for i in range(CELL_PIVOTS))
    members = members.withColumn("cell", F.when(crowded, cell).otherwise(F.lit(0)))
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk)).cast("int")
    members = members.withColumn("salt", F.when(crowded, F.pmod(F.xxhash64("fp"), salts)).otherwise(F.lit(0)))
    return members.groupBy("choice", "value", "cell", "salt").agg(
        F.collect_list(F.struct("fp", "id", "near")).alias("members"), F.first("n").alias("n"),
        F.array(*(F.min(d) for d in near)).alias("low"), F.array(*(F.max(d) for d in near)).alias("high"))


def _labels(fp: np.ndarray, near: np.ndarray, radius: int) -> np.ndarray:
    """The smallest member (by position) that each of the members reaches over links among them."""
    n = len(fp)
    alive = np.ones((n, n), bool)
    for k in range(near.shape[1]):
        d = near[:, k].astype(np.int8)
        alive &= np.abs(d[:, None] - d[None, :]) <= radius
        if k == 3 or k == near.shape[1] - 1:  # most pairs are gone: go on with the survivors
            break
    a, b = np.nonzero(np.triu(alive, 1))
    for k in range(4, near.shape[1], 4):
        some = near[:, k:k + 4].astype(np.int8)
        left = (np.abs(some[a] - some[b]) <= radius).all(axis=1)
        a, b = a[left], b[left]
    left = np.bitwise_count(fp[a] ^ fp[b]) <= radius
    a, b = a[left], b[left]
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        if (least == label[a]).all() and (least == label[b]).all():
            break
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
    return label


def chunk_links(chunks: DataFrame, radius: int) -> DataFrame:
    """Links ``a``, ``b`` that connect all linked members of every bucket."""
    cols = ("choice", "value", "cell", "salt", "members", "low", "high")
    big = chunks.where(F.col("n") > F.size("members"))
    left = big.select(*(F.col(c).alias(f"l_{c}") for c in cols))
    right = big.select(*(F.col(c).alias(f"r_{c}") for c in cols))
    later = F.struct("l_cell", "l_salt") < F.struct("r_cell", "r_salt")
    meet = [F.col("l_choice") == F.col("r_choice"), F.col("l_value") == F.col("r_value"), later]
    for i in range(PIVOTS):
        meet.append((F.col("l_low")[i] <= F.col("r_high")[i] + radius)
                    & (F.col("r_low")[i] <= F.col("l_high")[i] + radius))
    crossing = left.join(right, meet).select(F.concat("l_members", "r_members").alias("members"))
    groups = chunks.where(F.size("members") > 1).select("members").union(crossing)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            cuts = lists.offsets.to_numpy()
            flat = lists.flatten()
            cuts = cuts - cuts[0]
            fps = flat.field(0).to_numpy().view(np.uint64)
            ids = flat.field(1).to_numpy()
            table = np.frombuffer(b"".join(flat.field(2).to_pylist()), np.uint8).reshape(len(fps), -1)
            for start, end in zip(cuts.tolist(), cuts[1:].tolist()):
                order = start + np.argsort(ids[start:end], kind="stable")
                label = _labels(fps[order], table[order], radius)
                moved = np.flatnonzero(label != np.arange(len(label)))
                if len(moved):
                    own = ids[order]
                    yield pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[label[moved]])], schema=schema)

    return groups.mapInArrow(linked, "a bigint, b bigint").distinct()


def hex_digits(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a signed BIGINT read as unsigned."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, radius: int = RADIUS, chunk: int = CHUNK,
                       bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``fingerprint`` and ``component_id``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest id reachable over links.
    """
    made = materialize(fingerprints(docs, k, id_col, text_col), "fingerprints")
    classes = materialize(
        made.where(F.col(id_col).isNotNull()).groupBy("fp").agg(
            F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"), F.first("near").alias("near")), "classes")
    blocks = enough_blocks(classes.count(), radius, bucket)
    chunks = materialize(packed_chunks(bucket_entries(classes, radius, blocks), chunk), "simhash-chunks")
    links = chunk_links(chunks, radius)
    # Rows that share an id are one document: their fingerprints' classes are linked through it.
    own = made.where(F.col(id_col).isNotNull()).select(id_col, "fp").distinct()
    repeated = own.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col)
    shared = (own.join(repeated, id_col).join(classes.select("fp", "id"), "fp")
              .where(F.col("id") != F.col(id_col)).select(F.col(id_col).alias("a"), F.col("id").alias("b")))
    joined = components(links.union(shared), "simhash-components")
    known = materialize(
        classes.join(joined.withColumnRenamed("node", "id"), "id", "left")
        .where((F.col("n") > 1) | F.col("component").isNotNull())
        .select("fp", "n", F.coalesce("component", "id").alias("component_id")), "simhash-classes")
    # Fewer than 1000 fingerprints can hold more than a thousandth of all rows each.
    heavy = F.broadcast(known.join(heavy_keys(classes, "fp", "n"), "fp", "left_semi").select("fp", "component_id"))
    rest = known.join(heavy_keys(classes, "fp", "n"), "fp", "left_anti").select("fp", F.col("component_id").alias("__c"))
    rows = made.select(id_col, "fp").join(heavy, "fp", "left")
    # A key of its own for rows that are settled, so that none is shared by many of them.
    seeking = F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")
    settled = rows.where(F.col("component_id").isNotNull()).select(id_col, "fp", "component_id")
    others = (rows.where(F.col("component_id").isNull()).select(id_col, seeking).join(rest, "fp", "left")
              .select(id_col, "fp", F.coalesce("__c", id_col).alias("component_id")))
    return settled.union(others).select(
        id_col, hex_digits(F.col("fp")).alias("fingerprint"),
        F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))
