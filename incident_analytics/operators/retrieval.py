"""Vector tables and exact top-K retrieval over them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..constants import SIMILARITY_THRESHOLD, SNIPPET_CHARS, TOP_K
from ..session import materialize
from .scale import broadcast_if, fits_broadcast

Encoder = Callable[[pd.Series], np.ndarray]

_PACKED = "ids binary, vectors binary, n int, dim int"
_SCORED = "query_id bigint, vec_id bigint, score double"
_HELD_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 128 << 10
CELL_BYTES = 32 << 20
STREAM_BYTES = 256 << 20
_ROW_GROUP_BYTES = 8 << 20
_QUERY_ROWS, _KB_ROWS = 1024, 4096
_GATHERED = 1 << 22


def fit_text_encoder(df: DataFrame, text_col: str = "text", dim: int = 384) -> PipelineModel:
    """Fit hashed tf-idf weights on the cluster; the model is one vector of ``dim`` numbers."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="__tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=dim),
        IDF(inputCol="__tf", outputCol="__idf"),
        Normalizer(inputCol="__idf", outputCol="__unit", p=2.0),
    ]).fit(df.select(text_col))


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    wide = np.asarray(matrix, dtype=np.float64)
    norms = np.linalg.norm(wide, axis=1, keepdims=True)
    return np.divide(wide, norms, out=np.zeros_like(wide), where=norms > 0).astype(np.float32)


def embed_corpus(df: DataFrame, text_col: str = "text", encoder: Encoder | None = None,
                 model: PipelineModel | None = None, dim: int = 384,
                 load_encoder: Callable[[], Encoder] | None = None, batch_size: int = 256) -> DataFrame:
    """Add ``embedding``: a unit ARRAY<FLOAT> per text (a zero vector stays zero).

    Without an ``encoder`` the JVM-side hashed tf-idf model is used (fitted here,
    or passed in so that queries and corpus share one).  An encoder maps a series
    of texts to a matrix; it is called once per Arrow batch.  ``load_encoder`` makes an
    encoder where it runs: it is called once per Python worker, so weights are read
    there and never pickled, and its encoder gets arrays of at most ``batch_size`` texts.
    """
    if load_encoder is not None:
        def make():
            encode_texts = load_encoder()
            return lambda texts: _unit_rows(encode_texts(texts))

        loaded = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size)
        return df.withColumn("embedding", loaded(F.coalesce(F.col(text_col), F.lit(""))))
    if encoder is None:
        fitted = model or fit_text_encoder(df, text_col, dim)
        return (fitted.transform(df)
                .withColumn("embedding", vector_to_array("__unit", "float32"))
                .drop("__tokens", "__tf", "__idf", "__unit"))

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_unit_rows(encoder(texts))))

    return df.withColumn("embedding", encode(F.col(text_col)))


def unit_vector(col: Column) -> Column:
    """L2-normalise an array; a zero vector is returned as it is."""
    wide = F.transform(col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm == 0, col).otherwise(
        F.transform(wide, lambda x: (x / norm).cast("float"))).cast("array<float>")


def build_vector_table(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Vectors normalised once at build time, in the same row as their metadata."""
    return df.withColumn(embedding, unit_vector(F.col(embedding)))


def pack_vectors(df: DataFrame, id_col: str, vector_col: str, block_rows: int = 4096) -> DataFrame:
    """Pack rows into blocks of at most ``block_rows`` vectors and ``BLOCK_BYTES``, without a shuffle.

    A block is cut from one Arrow batch, so nothing else is held.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            ids = batch["__id"].to_numpy(dtype=np.int64)
            vectors = np.stack(batch["__v"].to_numpy()).astype(np.float32)
            dim = vectors.shape[1]
            step = min(block_rows, max(1, BLOCK_BYTES // (4 * max(1, dim))))
            cuts = [slice(i, i + step) for i in range(0, len(ids), step)]
            yield pd.DataFrame({"ids": [ids[c].tobytes() for c in cuts], "vectors": [vectors[c].tobytes() for c in cuts],
                                "n": [len(ids[c]) for c in cuts], "dim": dim})

    rows = df.select(F.col(id_col).cast("bigint").alias("__id"), F.col(vector_col).alias("__v"))
    return rows.where(F.col("__v").isNotNull()).mapInPandas(pack, _PACKED)


def _merge_best(held: tuple[np.ndarray, np.ndarray] | None, scores: np.ndarray, ids: np.ndarray,
                k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k of each row (score descending, then id) among held and new candidates."""
    if held is not None:
        scores = np.concatenate([held[0], scores], axis=1)
        ids = np.concatenate([held[1], ids], axis=1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _score_blocks(k: int, threshold: float | None, exclude_self: bool):
    def emit(qids: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        scores, ids = best
        rows, cols = np.nonzero(np.isfinite(scores))
        return pd.DataFrame({"query_id": qids[rows], "vec_id": ids[rows, cols],
                             "score": scores[rows, cols]})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        held_rows = 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                kids = np.frombuffer(r.ids, dtype=np.int64)
                kmat = np.frombuffer(r.vectors, dtype=np.float32).reshape(r.n, r.dim)
                qids = np.frombuffer(r.q_ids, dtype=np.int64)
                qmat = np.frombuffer(r.q_vectors, dtype=np.float32).reshape(r.q_n, r.q_dim)
                scores = qmat.astype(np.float64) @ kmat.astype(np.float64).T
                if exclude_self:
                    scores[qids[:, None] == kids[None, :]] = -np.inf
                if threshold is not None:
                    scores[scores < threshold] = -np.inf
                # Keep every tie of the k-th score, so that ties are settled by id.
                if scores.shape[1] > k:
                    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
                    width = int(((scores >= kth) & np.isfinite(scores)).sum(axis=1).max())
                    if width == 0:
                        continue
                    cols = np.argpartition(-scores, width - 1, axis=1)[:, :width]
                    scores = np.take_along_axis(scores, cols, 1)
                    ids = kids[cols]
                else:
                    ids = np.broadcast_to(kids, scores.shape)
                if r.q_ids not in held:
                    held_rows += len(qids)
                held[r.q_ids] = _merge_best(held.get(r.q_ids), scores, ids, k)
                if held_rows > _HELD_ROWS:
                    for key, best in held.items():
                        yield emit(np.frombuffer(key, dtype=np.int64), best)
                    held, held_rows = {}, 0
        for key, best in held.items():
            yield emit(np.frombuffer(key, dtype=np.int64), best)

    return score


def _unpacked(blocks: list[tuple[pa.Buffer, pa.Buffer]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and finite vectors of packed blocks, by ascending id; a product with any other vector is no finite score."""
    of_block = [np.frombuffer(x, dtype=np.int64) for x, _ in blocks]
    ids = np.concatenate(of_block)
    vectors = np.concatenate([np.frombuffer(v, dtype=np.float32).reshape(len(x), -1 if v.size else 0)
                              for x, (_, v) in zip(of_block, blocks, strict=True)])
    order = np.argsort(ids, kind="stable")
    order = order[np.isfinite(vectors).all(axis=1)[order]]
    return ids[order], vectors[order]


def _keep_best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, new_scores: np.ndarray,
               new_ids: np.ndarray) -> None:
    """Merge candidates into the best k (score descending, then id) of their rows, in place."""
    k = scores.shape[1]
    touched, at = np.unique(rows, return_inverse=True)
    r = np.concatenate([np.repeat(np.arange(len(touched)), k), at])
    s = np.concatenate([scores[touched].ravel(), new_scores])
    i = np.concatenate([ids[touched].ravel(), new_ids])
    order = np.lexsort((i, -s, r))
    r, s, i = r[order], s[order], i[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    kept = place < k
    scores[touched[r[kept]], place[kept]] = s[kept]
    ids[touched[r[kept]], place[kept]] = i[kept]


def best_hits(qids: np.ndarray, queries: np.ndarray, kids: np.ndarray, kb: np.ndarray, k: int,
              threshold: float | None, exclude_self: bool,
              least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best k scores (double precision) and ids per query; ``kids`` ascend, missing hits score -inf.

    A product in single precision, whose error is bounded by the norms, finds the
    pairs that can still enter the best k; only those are multiplied in double
    precision.  Later ids lose ties, so a full row takes strictly better scores.
    ``least`` is a score per query that hits must reach, as other vectors have.
    """
    dim = kb.shape[1]
    q_norm = np.sqrt(np.einsum("ij,ij->i", queries, queries, dtype=np.float64))
    k_norm = np.sqrt(np.einsum("ij,ij->i", kb, kb, dtype=np.float64)).max(initial=0.0)
    # Products near the end of the range of single precision are made in double precision at once.
    wide = np.float32 if q_norm.max(initial=0.0) * k_norm < 1e30 else np.float64
    margin = 2.0 ** -23 * (dim + 4) * q_norm * k_norm + dim * 1e-37
    floor = np.full(len(qids), -np.inf if threshold is None else threshold)
    if least is not None:
        floor = np.maximum(floor, least)
    best = np.full((len(qids), k), -np.inf)
    found = np.full((len(qids), k), -1, dtype=np.int64)
    for q0 in range(0, len(qids), _QUERY_ROWS):
        q = slice(q0, q0 + _QUERY_ROWS)
        q_ids, q_rows, q_margin, q_floor, zero = qids[q], queries[q], margin[q], floor[q], q_norm[q] == 0
        scores, ids = best[q], found[q]
        for k0 in range(0, len(kids), _KB_ROWS):
            k_ids, k_rows = kids[k0:k0 + _KB_ROWS], kb[k0:k0 + _KB_ROWS]
            rough = q_rows.astype(wide, copy=False) @ k_rows.astype(wide, copy=False).T
            if exclude_self:
                low, high = np.searchsorted(k_ids, q_ids), np.searchsorted(k_ids, q_ids, "right")
                for row in np.nonzero(high > low)[0]:
                    rough[row, low[row]:high[row]] = -np.inf
            full = np.isfinite(scores[:, -1])
            cut = np.maximum(scores[:, -1], q_floor) - q_margin
            cut[full & zero] = np.inf
            if k0 == 0 and len(k_ids) > k:
                kth = np.partition(rough, len(k_ids) - k, axis=1)[:, -k].astype(np.float64)
                cut = np.maximum(cut, kth - 2 * q_margin)
            hits = np.flatnonzero(rough >= cut.astype(wide)[:, None])
            step = max(1, _GATHERED // max(1, dim))
            for h0 in range(0, len(hits), step):
                rows, cols = np.divmod(hits[h0:h0 + step], len(k_ids))
                exact = np.einsum("ij,ij->i", q_rows[rows].astype(np.float64), k_rows[cols].astype(np.float64))
                last = scores[rows, -1]
                good = (exact >= q_floor[rows]) & (exact > last) & np.isfinite(rough[rows, cols])
                if good.any():
                    _keep_best(scores, ids, rows[good], exact[good], k_ids[cols[good]])
    return best, found


def _score_cell(k: int, threshold: float | None, exclude_self: bool, piece_bytes: int):
    """Scores one cell: all query blocks come beside its first knowledge-base block, the other ones follow alone.

    At most about ``piece_bytes`` of the knowledge base are held at a time; the best k of
    every query are merged from piece to piece.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[tuple[pa.Buffer, pa.Buffer]] = []
        piece: list[tuple[pa.Buffer, pa.Buffer]] = []
        held, best = 0, None

        def multiplied() -> None:
            nonlocal queries, best
            if best is None:
                best, queries = (*_unpacked(queries), None, None), []
            qids, q_rows, scores, ids = best
            found = best_hits(qids, q_rows, *_unpacked(piece), k, threshold, exclude_self,
                              None if scores is None else scores[:, -1])
            if scores is not None:
                found = _merge_best((scores, ids), *found, k)
            best = (qids, q_rows, *found)

        for batch in batches:
            k_ids, k_vectors, q_ids, q_vectors = batch.columns
            for i in range(batch.num_rows):
                if k_ids[i].is_valid:
                    if held >= piece_bytes:
                        multiplied()
                        piece, held = [], 0
                    piece.append((k_ids[i].as_buffer(), k_vectors[i].as_buffer()))
                    held += piece[-1][1].size
                if q_ids[i].is_valid:
                    queries.append((q_ids[i].as_buffer(), q_vectors[i].as_buffer()))
        if not piece:
            return
        multiplied()
        qids, _, scores, ids = best
        rows, cols = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_pydict({"query_id": qids[rows], "vec_id": ids[rows, cols], "score": scores[rows, cols]})

    return score


def _grid(queries: tuple[int, int], kb: tuple[int, int], cores: int) -> tuple[int, int]:
    """Groups of query and knowledge-base blocks, from (blocks, bytes): cells of bounded bytes, some for every core."""
    def groups(side: tuple[int, int], least: int) -> int:
        return max(1, min(side[0], max(-(-side[1] // CELL_BYTES), least)))

    cells = 4 * cores
    q = groups(queries, math.isqrt(cells - 1) + 1)
    k = groups(kb, -(-cells // q))
    return max(q, groups(queries, -(-cells // k))), k


def topk_per_query(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best rows per query (score, then smaller id) with their rank.

    Planned as a group limit before and after the shuffle, so a query with very
    many candidates is cut down inside the map tasks.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_topk(queries: DataFrame, kb: DataFrame, k: int = TOP_K,
                 threshold: float | None = SIMILARITY_THRESHOLD, query_id: str = "query_id",
                 kb_id: str = "vec_id", vector: str = "embedding", exclude_self: bool = False,
                 shards: int | None = None, block_rows: int = 4096) -> DataFrame:
    """Exact inner-product top-K on unit vectors, then score >= threshold.

    Both sides are packed into small blocks and written; their bytes decide how
    many groups each side is dealt into (``shards``: groups of the knowledge
    base).  Every pair of groups is a cell of a cartesian product, whose task reads
    both groups where they are stored: no copy of a block is shuffled or written,
    however many groups there are.  Of a cell's pairs of blocks only those with a
    first block are passed on, so each block reaches Python once.  A task holds
    one group of queries (about ``CELL_BYTES``) and as much of the knowledge base
    at a time, and keeps the best k per query over its group of about
    ``STREAM_BYTES``; at most queries * k * groups rows are shuffled - pairs are
    never rows.

    Dropping scores under the threshold first leaves the same rows as dropping
    them after the top-K, so it is done in the task.
    """
    spark = queries.sparkSession

    def packed(df: DataFrame, id_col: str, name: str) -> tuple[DataFrame, tuple[int, int]]:
        blocks = materialize(pack_vectors(df, id_col, vector, block_rows), name, **{"parquet.block.size": _ROW_GROUP_BYTES})
        size = blocks.agg(F.count(F.lit(1)), F.sum(F.octet_length("vectors").cast("bigint"))).first()
        return blocks, (size[0], size[1] or 0)

    cores = spark.sparkContext.defaultParallelism
    q_blocks, q_size = packed(queries, query_id, "query-blocks")
    kb_blocks, kb_size = packed(kb, kb_id, "kb-blocks")
    q_groups, pieces = _grid(q_size, kb_size, cores)
    kb_groups = shards or min(pieces, max(-(-4 * cores // q_groups), -(-kb_size[1] // STREAM_BYTES)))
    # Files are grouped as they lie; only a table of fewer files than groups is dealt out.
    spread = kb_blocks.rdd.getNumPartitions() < kb_groups
    kb_blocks = kb_blocks.repartition(kb_groups) if spread else kb_blocks.coalesce(kb_groups)

    def side(blocks: DataFrame, name: str) -> DataFrame:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        return blocks.select(first.alias(f"{name}_first"), F.col("ids").alias(f"{name}_ids"),
                             F.col("vectors").alias(f"{name}_vectors"))

    cells = side(kb_blocks, "kb").join(side(q_blocks.repartition(q_groups), "q").hint("shuffle_replicate_nl"),
                                       F.col("kb_first") | F.col("q_first"))
    once = cells.select(*[F.when(F.col(f"{other}_first"), F.col(f"{own}_{x}")).alias(f"{own}_{x}")
                          for own, other in (("kb", "q"), ("q", "kb")) for x in ("ids", "vectors")])
    scored = once.mapInArrow(_score_cell(k, threshold, exclude_self, CELL_BYTES), _SCORED)
    return topk_per_query(scored, k)


def hits_with_metadata(hits: DataFrame, kb: DataFrame, kb_id: str = "vec_id",
                       snippet: int = SNIPPET_CHARS) -> DataFrame:
    """Attach ticket fields to hits; score to 4 places, padding hits (id -1) dropped.

    The hits (at most queries * k narrow rows) are written to the shared folder and
    counted.  If they fit they are broadcast, and the knowledge base with its texts
    is scanned once without a shuffle; otherwise adaptive execution joins both and
    splits the partition of a ticket that very many queries hit.
    """
    meta = kb.select(F.col(kb_id).alias("vec_id"), "ticket_id", "title",
                     F.substring("description", 1, snippet).alias("description"),
                     "resolution", "category",
                     F.coalesce("priority", F.lit("")).alias("priority"))
    found = materialize(hits.where(F.col("vec_id") >= 0), "hits")
    return (meta.join(broadcast_if(found, fits_broadcast(found)), "vec_id")
            .select(*hits.columns, *[c for c in meta.columns if c != "vec_id"])
            .withColumn("score", F.round("score", 4)))
