"""Approximate top-K retrieval: hyperplane tables whose crowded buckets are split by further planes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SEED, SIMILARITY_THRESHOLD, TOP_K
from ..session import materialize
from .retrieval import _SCORED, _score_blocks, topk_per_query

TABLES = 8
PLANES = 24
PROBES = 6
LEAF_ROWS = 1024


def hyperplanes(tables: int, planes: int, dim: int, seed: int) -> np.ndarray:
    """Normals (table, plane, dim), the same for the same seed."""
    return np.random.default_rng(seed).standard_normal((tables, planes, dim))


def plane_codes(df: DataFrame, id_col: str, vector: str, normals: np.ndarray) -> DataFrame:
    """(id, v, tab, code, margins): the sides of all planes of a table, first plane in the highest bit.

    ``margins`` are the distances of the vector to the planes.
    """
    tables, planes, dim = normals.shape
    flat = normals.reshape(tables * planes, dim).T
    weights = 1 << np.arange(planes - 1, -1, -1, dtype=np.int64)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            matrix = np.stack(rows["v"].to_numpy()).astype(np.float64)
            side = (matrix @ flat).reshape(len(rows), tables, planes)
            yield pd.DataFrame({
                "id": np.repeat(rows["id"].to_numpy(), tables), "v": np.repeat(rows["v"].to_numpy(), tables),
                "tab": np.tile(np.arange(tables), len(rows)), "code": ((side > 0) * weights).sum(axis=2).ravel(),
                "margins": list(np.abs(side).reshape(-1, planes).astype(np.float32))})

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return (rows.where(F.col("id").isNotNull() & (F.size("v") == dim))
            .mapInPandas(code, "id bigint, v array<float>, tab int, code bigint, margins array<float>"))


def probe_codes(asked: DataFrame, crowded: DataFrame, planes: int, probes: int) -> DataFrame:
    """(id, v, tab, code): every query's own code and the ``probes`` most likely codes of its neighbours.

    A neighbour is parted from the query by few planes close to it.  Only planes
    that cut the query's bucket count; sets of up to three of the nearest ones are
    ordered by the sum of squared distances.
    """
    path = (asked.select("tab", "code").distinct()
            .select("tab", "code", F.explode(F.sequence(F.lit(0), F.lit(planes - 1))).alias("depth"))
            .withColumn("prefix", _prefix("code", "depth", planes)).join(crowded, ["tab", "depth", "prefix"])
            .groupBy("tab", "code").agg((F.max("depth") + 1).alias("cuts")))
    near = 12
    sets = [c for n in (1, 2, 3) for c in combinations(range(near), n)]
    member = np.zeros((len(sets), near), bool)
    for i, chosen in enumerate(sets):
        member[i, list(chosen)] = True

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            margins = np.stack(rows["margins"].to_numpy()).astype(np.float64)
            margins[np.arange(planes)[None, :] >= rows["cuts"].to_numpy()[:, None]] = np.inf
            order = np.argsort(margins, axis=1, kind="stable")[:, :near]
            costs = np.take_along_axis(margins, order, 1) ** 2
            bits = np.int64(1) << (planes - 1 - order)
            if order.shape[1] < near:
                pad = ((0, 0), (0, near - order.shape[1]))
                costs, bits = np.pad(costs, pad, constant_values=np.inf), np.pad(bits, pad)
            total = np.where(member[None], costs[:, None, :], 0).sum(axis=2)
            best = np.argsort(total, axis=1, kind="stable")[:, :probes]
            flips = np.where(member[best], bits[:, None, :], 0).sum(axis=2)
            useful = np.isfinite(np.take_along_axis(total, best, 1))
            codes = np.concatenate([rows["code"].to_numpy()[:, None],
                                    rows["code"].to_numpy()[:, None] ^ np.where(useful, flips, 0)], axis=1)
            keep = np.concatenate([np.ones((len(rows), 1), bool), useful], axis=1)
            at = np.nonzero(keep)[0]
            yield pd.DataFrame({"id": rows["id"].to_numpy()[at], "v": rows["v"].to_numpy()[at],
                                "tab": rows["tab"].to_numpy()[at], "code": codes[keep]})

    return (asked.join(path, ["tab", "code"], "left").na.fill(0, ["cuts"])
            .select("id", "v", "tab", "code", "margins", "cuts")
            .mapInPandas(probe, "id bigint, v array<float>, tab int, code bigint"))


def first_copies_of_vectors(kb: DataFrame, id_col: str, vector: str, copies: int) -> DataFrame:
    """The ``copies`` smallest ids of every vector; equal vectors tie, so later ones never reach a top-K."""
    order = Window.partitionBy(F.xxhash64(vector), vector).orderBy(id_col)
    return kb.where(F.col(id_col).isNotNull()).withColumn("__copy", F.row_number().over(order)).where(F.col("__copy") <= copies).drop("__copy")


def prefix_counts(codes: DataFrame, planes: int) -> DataFrame:
    """(tab, depth, prefix, n): the rows below every prefix of a code, counted per distinct code first."""
    counted = codes.groupBy("tab", "code").agg(F.count(F.lit(1)).alias("n"))
    return (counted.select("tab", "code", "n", F.explode(F.sequence(F.lit(0), F.lit(planes))).alias("depth"))
            .groupBy("tab", "depth", _prefix("code", "depth", planes).alias("prefix")).agg(F.sum("n").alias("n")))


def leaves(nodes: DataFrame, crowded: DataFrame, planes: int, leaf_rows: int) -> DataFrame:
    """The buckets: prefixes that fit and whose parent does not.

    A bucket that no plane can split (equal codes) stays whole at the last plane.
    """
    fits = nodes.where((F.col("n") <= leaf_rows) | (F.col("depth") == planes))
    children = crowded.select("tab", (F.col("depth") + 1).alias("depth"), F.explode(F.array(
        F.shiftleft("prefix", 1), F.shiftleft("prefix", 1) + 1)).alias("prefix"))
    return (fits.join(children, ["tab", "depth", "prefix"], "left_semi").select("tab", "depth", "prefix", "n")
            .unionByName(fits.where("depth = 0").select("tab", "depth", "prefix", "n")))


def _prefix(code: str, depth: str, planes: int) -> Column:
    return F.expr(f"shiftrightunsigned({code}, {planes} - {depth})")


def in_leaves(coded: DataFrame, buckets: DataFrame, planes: int) -> DataFrame:
    """The rows of ``coded`` with the bucket that their code lies in, if there is one.

    Codes are looked up once per distinct (table, code), without the vectors.
    """
    distinct = coded.select("tab", "code").distinct()
    looked = (distinct.select("tab", "code", F.explode(F.sequence(F.lit(0), F.lit(planes))).alias("depth"))
              .withColumn("prefix", _prefix("code", "depth", planes))
              .join(buckets, ["tab", "depth", "prefix"]).select("tab", "code", "depth", "prefix", "n"))
    return coded.join(looked, ["tab", "code"])


def _packed(rows: DataFrame, keys: list[str], prefix: str, salts: Column, dim: int) -> DataFrame:
    """Rows of a bucket as matrices, in as many parts as ``salts`` says."""
    part = F.pmod(F.xxhash64("id"), salts).cast("int")
    grouped = (rows.withColumn("part", part).groupBy(*keys, "part")
               .agg(F.collect_list(F.struct("id", "v")).alias("members")))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, vectors, sizes = [], [], []
            for members in batch["members"]:
                ids.append(np.array([m["id"] for m in members], np.int64).tobytes())
                vectors.append(np.stack([m["v"] for m in members]).astype(np.float32).tobytes())
                sizes.append(len(members))
            yield batch[keys].assign(**{f"{prefix}ids": ids, f"{prefix}vectors": vectors,
                                        f"{prefix}n": sizes, f"{prefix}dim": dim})

    return grouped.mapInPandas(pack, ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
                               + f", {prefix}ids binary, {prefix}vectors binary, {prefix}n int, {prefix}dim int")


def approximate_pairs(queries: DataFrame, kb: DataFrame, copies: int, query_id: str, kb_id: str, vector: str,
                      tables: int, planes: int, probes: int, leaf_rows: int, seed: int) -> DataFrame:
    """Pairs of packed query and knowledge-base blocks that share a bucket in some table."""
    dim = kb.where(F.col(vector).isNotNull()).select(F.max(F.size(vector))).first()[0] or 1
    normals = hyperplanes(tables, planes, dim, seed)
    coded = materialize(plane_codes(first_copies_of_vectors(kb, kb_id, vector, copies), kb_id, vector, normals),
                        "plane-codes")
    nodes = materialize(prefix_counts(coded, planes), "plane-counts")
    crowded = nodes.where((F.col("n") > leaf_rows) & (F.col("depth") < planes)).select("tab", "depth", "prefix")
    buckets = materialize(leaves(nodes, crowded, planes, leaf_rows), "plane-buckets")
    asked = materialize(probe_codes(plane_codes(queries, query_id, vector, normals), crowded, planes, probes),
                        "plane-probes")
    keys = ["tab", "depth", "prefix"]
    # Probes of one query that end in one bucket count once.
    visits = in_leaves(asked, buckets, planes).dropDuplicates(["id", *keys])
    load = visits.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked"))
    parts = F.ceil(F.col("n") / leaf_rows)
    left = _packed(in_leaves(coded, buckets, planes), keys, "", parts, dim)
    right = _packed(visits.join(load, keys), keys, "q_", F.ceil(F.col("asked") / leaf_rows), dim)
    return left.join(right, keys)


def similar_topk_approx(queries: DataFrame, kb: DataFrame, k: int = TOP_K,
                        threshold: float | None = SIMILARITY_THRESHOLD, query_id: str = "query_id",
                        kb_id: str = "vec_id", vector: str = "embedding", exclude_self: bool = False,
                        tables: int = TABLES, planes: int = PLANES, probes: int = PROBES,
                        leaf_rows: int = LEAF_ROWS, seed: int = SEED) -> DataFrame:
    """Approximate twin of ``similar_topk`` on unit vectors: exact scores of the best hits found.

    Each of ``tables`` tables cuts the space by seeded hyperplanes.  A bucket with
    more than ``leaf_rows`` tickets is cut by the next plane, so no candidate of a
    bucket is dropped and none is compared with a crowd; a query looks into its own
    bucket of every table and into ``probes`` buckets behind the nearest planes.
    Copies of one vector count as its k + 1 smallest ids, as no later one can be
    among the best k.  Work per query is about tables * (probes + 1) * leaf_rows
    products, whatever the number of tickets.
    """
    score = _score_blocks(k, threshold, exclude_self)

    def best_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Block by block: a pair may be found in several tables, and must not fill a running best.
        for batch in batches:
            for i in range(len(batch)):
                yield from score(iter([batch.iloc[i:i + 1]]))

    pairs = approximate_pairs(queries, kb, k + 1, query_id, kb_id, vector, tables, planes, probes, leaf_rows, seed)
    scored = (pairs.select("ids", "vectors", "n", "dim", "q_ids", "q_vectors", "q_n", "q_dim")
              .mapInPandas(best_of_blocks, _SCORED))
    return topk_per_query(scored.dropDuplicates(["query_id", "vec_id"]), k)
