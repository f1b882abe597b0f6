"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

1. Every text becomes its set of distinct word shingles (64-bit hashes).  Each
   permutation of a signature keeps both the smallest and the largest value, so
   one evaluation yields two signature values.  Bands of several such values
   become bucket keys.
2. Documents with the same set form one class, represented by its smallest id;
   only classes go on.
3. In every bucket all classes are compared with one pivot, not with each other.
   Members linked to the pivot are in one component with it.  For the strays,
   which are not, set arithmetic relative to the pivot tells which other members
   they can be linked to at all (see :func:`stray_pairs`), and those pairs are
   compared too.  So no link between members of a bucket is lost, and a group of
   n copies costs about n comparisons, not n * n.
4. A comparison joins the two whole texts and counts the shingles they share.
   Confirmed links are closed to components.

Defined cases: a text with fewer words than a shingle is one shingle; a null
text, or one without words, has an empty set and is linked with nothing; rows
with a null id are returned unlinked (null component, kept); rows that share an
id are one document, linked through the set of each row; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from incident_analytics.llm.components import components
from incident_analytics.llm.rows import CARRIED, carry, map_slices
from incident_analytics.session import materialize

SHINGLE_WORDS = 5
PERCENT = 80
BANDS = 28
BAND_PERMUTATIONS = 3

_MIX = np.random.default_rng(20240717).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 4096


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a text (A-Z lower-cased)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = min(k, len(hashes))
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        total = _scramble(total ^ hashes[i:len(hashes) - n + 1 + i] * _MIX[i % 64])
    return np.unique(total)


class Signer:
    """Bucket keys of shingle sets: ``bands`` keys of 2 * ``permutations`` signature values each."""

    def __init__(self, bands: int, permutations: int) -> None:
        draw = np.random.default_rng(7)
        n = bands * permutations
        self.factor = (draw.integers(0, 1 << 63, (n, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.shift = draw.integers(0, 1 << 63, (n, 1), dtype=np.uint64)
        self.weights = (draw.integers(0, 1 << 63, (1, 2 * permutations), dtype=np.uint64)
                        << np.uint64(1)) | np.uint64(1)
        self.bands = bands

    def min_max(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = high = None
        for at in range(0, len(hashes), _CHUNK):
            values = hashes[at:at + _CHUNK] * self.factor + self.shift
            least, most = values.min(axis=1), values.max(axis=1)
            low = least if low is None else np.minimum(low, least)
            high = most if high is None else np.maximum(high, most)
        return low, high

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        low, high = self.min_max(hashes)
        rows = np.concatenate([low.reshape(self.bands, -1), high.reshape(self.bands, -1)], axis=1)
        summed = (_scramble(rows) * self.weights).sum(axis=1, dtype=np.uint64)
        return _scramble(summed + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, permutations: int, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Per row: id, set size, 128-bit digest of the set (null when empty) and its bucket keys."""
    schema = StructType([StructField(id_col, LongType()), StructField("n_shingles", LongType()),
                         StructField("digest", BinaryType()), StructField("keys", ArrayType(LongType()))])
    signer = Signer(bands, permutations)

    def signed(ids: list, texts: list) -> dict:
        sets = [shingle_set(t, k) for t in texts]
        return {id_col: ids, "n_shingles": [len(s) for s in sets],
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "keys": [signer.keys(s) if len(s) else None for s in sets]}

    return map_slices(docs.select(F.col(id_col).cast("bigint"), text_col), signed, schema)


def similarities(pairs: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Compare the whole texts of each pair ``a``, ``b`` of ids.

    Returns the shared and united shingle counts, how many shingles of ``b`` are
    missing in ``a``, and the shingles that ``a`` has beyond ``b``.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")) \
        .where(F.col("id").isNotNull())
    joined = (pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
              .join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
              .select("a", "b", "text_a", "text_b"))
    schema = StructType([*(StructField(c, LongType()) for c in ("a", "b", "shared", "united", "missing")),
                         StructField("extra", ArrayType(LongType()))])

    def compared(a: list, b: list, texts_a: list, texts_b: list) -> dict:
        out: dict[str, list] = {"a": a, "b": b, "shared": [], "united": [], "missing": [], "extra": []}
        last, known = None, None
        for one, two in zip(texts_a, texts_b):
            if known is None or two != last:
                last, known = two, shingle_set(two, k)
            own = shingle_set(one, k)
            extra = np.setdiff1d(own, known, assume_unique=True)
            both = len(own) - len(extra)
            out["shared"].append(both)
            out["united"].append(len(known) + len(extra))
            out["missing"].append(len(known) - both)
            out["extra"].append(extra.view(np.int64))
        return out

    return map_slices(joined, compared, schema)


def _is_link(percent: int) -> Column:
    return (F.col("united") > 0) & (F.col("shared") * 100 >= F.col("united") * percent)


def pivot_pairs(entries: DataFrame) -> DataFrame:
    """(``a``, ``b``) of every member of a shared bucket and the pivot of that bucket.

    The pivot is the member that meets most others over all its buckets (ties:
    smallest id).  In a group of copies that is the text the others derive from,
    or one close to it, and it is the same in most buckets of the group.
    """
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(entries.join(sizes, "key"), "buckets")
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    pivots = (shared.join(degree, "id").groupBy("key")
              .agg((-F.max(F.struct("degree", (-F.col("id")).alias("id")))["id"]).alias("pivot")))
    return (shared.join(pivots, "key").where("id <> pivot")
            .select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())


def stray_pairs(found: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a pivot's group that may be linked though one is not linked to the pivot.

    ``found`` holds the comparisons with pivots.  Let a member x lack Dx of the
    pivot's n shingles and have Ax beyond them.  Two members share at most
    n - max(Dx, Dy) + s shingles and unite at least n + Ax + Ay - min(Dx, Dy) - s,
    where s of their extra shingles are common.  So a link needs
    (100 + p) * s >= p * (n + Ax + Ay - min(Dx, Dy)) - 100 * (n - max(Dx, Dy)).
    Where the right side is not positive, the pair is compared as it is; all
    other links must share an extra shingle, and are found by a join on those.
    The extra shingles a member shares with most others are left out of its side
    as far as the number it must share allows (prefix filter).  Extra shingles
    are changes of single copies, so few members have one in common, and the
    work follows the number of members, not of their pairs.
    """
    member = found.select(
        F.col("a").alias("id"), F.col("b").alias("pivot"), (F.col("shared") + F.col("missing")).alias("n"),
        F.col("missing").alias("lack"), F.size("extra").cast("bigint").alias("more"), "extra",
        (~_is_link(percent)).alias("stray"))
    short = percent * (F.col("n") + F.col("more")) - 100 * (F.col("n") - F.col("lack"))
    member = member.withColumn("short", short).withColumn("shrink", F.col("lack") - F.col("more"))
    groups = member.groupBy("pivot").agg(
        F.greatest(F.max("shrink"), F.lit(0)).alias("most"),
        F.min(F.when(F.col("stray"), F.col("short"))).alias("least")).where(F.col("least").isNotNull())
    member = materialize(member.join(groups, "pivot"), "stray-groups")

    fields = ("id", "lack", "more", "stray")
    y = member.withColumnsRenamed({f: f"{f}_y" for f in fields})
    both = ((F.col("id") != F.col("id_y")) & (~F.col("stray_y") | (F.col("id") < F.col("id_y"))))
    bound = (percent * (F.col("n") + F.col("more") + F.col("more_y") - F.least("lack", "lack_y"))
             - 100 * (F.col("n") - F.greatest("lack", "lack_y")))
    pair = (F.greatest("id", "id_y").alias("a"), F.least("id", "id_y").alias("b"))

    direct = (member.where(F.col("stray") & (F.col("short") <= percent * F.col("most")))
              .select("pivot", "n", *fields)
              .join(y.where(percent * F.col("shrink") >= F.col("least"))
                    .select("pivot", *(f"{f}_y" for f in fields)), "pivot")
              .where(both & (bound <= 0)).select(*pair))

    grams = member.select("pivot", "n", "most", "short", *fields, F.explode("extra").alias("gram"))
    often = grams.groupBy("pivot", "gram").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    grams = materialize(grams.join(often, ["pivot", "gram"]), "stray-shingles")
    must_share = F.greatest(F.lit(1), F.ceil((F.col("short") - percent * F.col("most")) / (100 + percent)))
    place = F.row_number().over(Window.partitionBy("pivot", "id").orderBy(F.desc("often"), "gram"))
    x = grams.where("stray").withColumn("place", place).where(F.col("place") >= must_share)
    y = grams.select("pivot", "gram", *(F.col(f).alias(f"{f}_y") for f in fields))
    alike = (x.join(y, ["pivot", "gram"])
             .where(both & (bound <= (100 + percent) * F.least("more", "more_y"))).select(*pair))
    return direct.union(alike).distinct()


def bucket_links(entries: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str,
                 text_col: str) -> DataFrame:
    """Confirmed links ``a``, ``b`` that join all linked members of every bucket."""
    found = materialize(similarities(pivot_pairs(entries), docs, k, id_col, text_col), "pivot-links")
    rest = materialize(stray_pairs(found, percent), "stray-pairs")
    more = materialize(similarities(rest, docs, k, id_col, text_col).drop("extra"), "stray-links")
    return found.where(_is_link(percent)).select("a", "b").union(
        more.where(_is_link(percent)).select("a", "b"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT,
                    bands: int = BANDS, permutations: int = BAND_PERMUTATIONS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked when 100 * shared >= ``percent`` * united shingles;
    ``component_id`` is the smallest id reachable over links, and the document of
    that id is kept.
    """
    signed = materialize(signatures(docs, k, bands, permutations, id_col, text_col), "signatures")
    classes = (signed.where(F.col("digest").isNotNull() & F.col(id_col).isNotNull())
               .groupBy("digest").agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"),
                                      F.first("keys").alias("keys")))
    classes = materialize(classes, "classes")
    links = bucket_links(classes.select("id", F.explode("keys").alias("key")), docs, k, percent,
                         id_col, text_col)
    joined = components(links, "components")
    known = (classes.select("digest", "id", "n")
             .join(joined.withColumnRenamed("node", "id"), "id", "left")
             .where((F.col("n") > 1) | F.col("component").isNotNull())
             .select("digest", F.coalesce("component", "id").alias("id")))
    named = signed.select(id_col, "n_shingles", _never_null("digest", id_col).alias("digest"))
    return (named.join(known.withColumnRenamed("id", "__component"), "digest", "left")
            .select(id_col, "n_shingles", F.when(F.col(id_col).isNotNull(), F.coalesce("__component", id_col))
                    .alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def one_per_group(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id :func:`near_duplicates` keeps, one row per id.

    Of rows that share an id the one with the smallest text stays; rows without an
    id have no group and all stay.
    """
    gone = judged.where(~F.col("kept")).select(id_col).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), carry(docs))
    first = F.row_number().over(Window.partitionBy("id").orderBy("text"))
    named = (rows.where(F.col("id").isNotNull()).join(gone.withColumnRenamed(id_col, "id"), "id", "left_anti")
             .withColumn("place", first).where("place = 1"))
    return named.select(f"{CARRIED}.*").union(docs.where(F.col(id_col).isNull()))


def _never_null(digest: str, id_col: str) -> Column:
    """The digest, or for empty sets the id's hash, so that no join key is null and shared by many."""
    return F.coalesce(digest, F.xxhash64(id_col).cast("string").cast("binary"))
