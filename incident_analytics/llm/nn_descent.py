"""Nearest neighbours by cosine: a neighbour graph from NN-descent, searched greedily.

1. Equal vectors form one class (its smallest id is the node of the graph).
2. A first graph comes from blocks of vectors that follow each other in the order
   of random projections; a task compares the vectors of a block.
3. NN-descent: every node receives the vectors of its neighbours, forward and
   reverse, and compares them with each other; each neighbour learns of closer
   ones.  A round is a join of the edges with the vectors and a shuffle to the
   common neighbour.  Lists are of bounded length, so no node gathers more than
   2 * ``k`` vectors, however popular it is.
4. A query starts at an entry node and follows the graph: the best ``beam``
   nodes found so far are expanded in every hop, scored on the original vectors
   in double precision.

Inside the descent vectors are one byte per component; every reported score is
computed from the original vectors.  The graph holds every row; its recall
against brute force is tested.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do vectors of another length than the most common
one, nor rows with a null id; rows that share an id keep their first vector in
array order; equal scores are ordered by id; with fewer than ``top`` candidates
all are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, FloatType, LongType, StructField, StructType

from incident_analytics.session import materialize

K = 32
TABLES = 4
BLOCK = 512
PER_BLOCK = 16
ROUNDS = 4
PER_MEETING = 4
BEAM = 64
HOPS = 3
EDGES = StructType([StructField("u", LongType()), StructField("w", LongType()),
                    StructField("sim", FloatType())])


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id`` and ``vec`` (array of doubles) of the rows that take part, one per id."""
    v = F.col(vec_col).cast("array<double>")
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    ok = (rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
          .select(F.col(id_col).cast("bigint").alias("id"), v.alias("vec"), norm.alias("norm"))
          # a null component makes the sum null; infinite ones and NaN fail the bound
          .where((F.col("norm") > 0) & (F.col("norm") < float("inf"))))
    length = ok.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = length["d"] if length else 0
    return ok.where(F.size("vec") == d).groupBy("id").agg(F.min("vec").alias("vec"))


def classes(vectors: DataFrame) -> DataFrame:
    """``node`` (smallest id) of every id; equal vectors share a node."""
    named = vectors.select("id", F.sha2(F.to_json("vec").cast("binary"), 256).alias("digest"))
    nodes = named.groupBy("digest").agg(F.min("id").alias("node"))
    return named.join(nodes, "digest").select("id", "node")


def pack(vectors: np.ndarray) -> list[bytes]:
    """Unit vectors as a scale (4 bytes) and one signed byte per component."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1).astype("<f4") / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale, codes)]


def unpack(packed: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    scale = np.ascontiguousarray(rows[:, :4]).view("<f4")
    return np.ascontiguousarray(rows[:, 4:]).view(np.int8) * scale


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed_nodes(vectors: DataFrame, named: DataFrame, tables: int) -> DataFrame:
    """``id``, packed vector and an order key per table for every node."""
    keys = [f"key{t}" for t in range(tables)]
    schema = StructType([StructField("id", LongType()), StructField("code", BinaryType()),
                         *(StructField(k, DoubleType()) for k in keys)])
    arrow = to_arrow_schema(schema)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _stack(batch.column(1))
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            draw = np.random.default_rng(11)
            orders = []
            for _ in range(tables):
                planes = draw.standard_normal((x.shape[1], 9))
                side = unit @ planes
                bits = (side[:, :8] > 0) @ (1 << np.arange(8))
                orders.append(bits + 0.5 + np.clip(side[:, 8] / 16, -0.499, 0.499))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pack(x), pa.binary()), *map(pa.array, orders)], schema=arrow)

    own = named.where("id = node").select("id")
    return vectors.join(own, "id").select("id", "vec").mapInArrow(coded, schema)


def block_edges(nodes: DataFrame, table: int, each: int = PER_BLOCK) -> DataFrame:
    """The closest ``each`` of every node inside its block of the order of one table."""
    arrow = to_arrow_schema(EDGES)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                if part.num_rows < 2:
                    continue
                ids = part.column(0).to_numpy()
                x = unpack(part.column(1).to_pylist()).astype(np.float32)
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                n = min(each, len(ids) - 1)
                top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids, n)), pa.array(ids[top].ravel()),
                    pa.array(np.take_along_axis(sims, top, 1).ravel())], schema=arrow)

    key = f"key{table}"
    return nodes.select("id", "code", key).repartitionByRange(key).sortWithinPartitions(key, "id") \
        .select("id", "code").mapInArrow(compared, EDGES)


def _closest(edges: DataFrame, k: int, by: str = "u", other: str = "w") -> DataFrame:
    """The ``k`` closest partners per node; the limit also works before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc("sim"), other)
    return edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def neighbourhoods(graph: DataFrame, k: int) -> DataFrame:
    """Pairs (v, u): u is among the ``k`` forward or the ``k`` closest reverse neighbours of v."""
    forward = graph.select(F.col("u").alias("v"), F.col("w").alias("u"))
    reverse = _closest(graph, k, "w", "u").select(F.col("w").alias("v"), "u")
    return forward.union(reverse).distinct()


def descend(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One round: neighbours of a common node meet there and learn of each other."""
    worst = graph.groupBy("u").agg(F.min("sim").alias("least"), F.count(F.lit(1)).alias("n"))
    known = nodes.select(F.col("id").alias("u"), "code").join(worst, "u", "left").select(
        "u", "code", F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).cast("float").alias("least"))
    met = (neighbourhoods(graph, k).join(known, "u")
           .groupBy("v").agg(F.collect_list(F.struct("u", "code", "least")).alias("met")).select("met"))
    arrow = to_arrow_schema(EDGES)

    def introduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                lists = batch.column(0).slice(start, 512)
                flat, ends = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_pylist()])
                ids = flat.field(0).to_numpy()
                x = unpack(flat.field(1).to_pylist()).astype(np.float32)
                least = flat.field(2).to_numpy()
                us, ws, ss = [], [], []
                for a, b in zip(ends, ends[1:]):
                    if b - a < 2:
                        continue
                    sims = x[a:b] @ x[a:b].T
                    np.fill_diagonal(sims, -3)
                    n = min(PER_MEETING, b - a - 1)
                    top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                    best = np.take_along_axis(sims, top, 1)
                    row, col = np.nonzero(best > least[a:b, None])
                    us.append(ids[a:b][row])
                    ws.append(ids[a:b][top[row, col]])
                    ss.append(best[row, col])
                if us:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(us)), pa.array(np.concatenate(ws)),
                        pa.array(np.concatenate(ss))], schema=arrow)

    fresh = met.mapInArrow(introduced, EDGES)
    return _closest(graph.union(fresh).groupBy("u", "w").agg(F.max("sim").alias("sim")), k)


def build_graph(nodes: DataFrame, k: int = K, tables: int = TABLES, rounds: int = ROUNDS) -> DataFrame:
    """Edges ``u``, ``w``, ``sim``: up to ``k`` close nodes of every node."""
    first = block_edges(nodes, 0)
    for t in range(1, tables):
        first = first.union(block_edges(nodes, t))
    graph = materialize(_closest(first.groupBy("u", "w").agg(F.max("sim").alias("sim")), k), "knn-graph")
    for _ in range(rounds):
        graph = materialize(descend(graph, nodes, k), "knn-graph")
    return graph


def _scored(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine of (q, node) pairs in double precision, from the original vectors."""
    schema = StructType([StructField("q", LongType()), StructField("node", LongType()),
                         StructField("sim", DoubleType())])
    arrow = to_arrow_schema(schema)

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _stack(batch.column(2)), _stack(batch.column(3))
            sim = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], schema=arrow)

    return (pairs.join(vectors.withColumnsRenamed({"id": "node", "vec": "x"}), "node")
            .join(queries.withColumnsRenamed({"id": "q", "vec": "y"}), "q")
            .select("q", "node", "x", "y").mapInArrow(cosines, schema))


def greedy_search(queries: DataFrame, entries: DataFrame, graph: DataFrame, vectors: DataFrame,
                  k: int = K, beam: int = BEAM, hops: int = HOPS) -> DataFrame:
    """The best ``beam`` nodes (``q``, ``node``, ``sim``) found for each query.

    ``queries``: id, vec; ``entries``: q and a node to start at.  A hop expands the
    nodes of the pool that were not expanded before.
    """
    around = materialize(neighbourhoods(graph, k).groupBy("v").agg(F.collect_list("u").alias("near"))
                         .withColumnRenamed("v", "node"), "knn-lists")
    pool = materialize(_scored(entries, vectors, queries).withColumn("done", F.lit(False)), "knn-pool")
    for _ in range(hops):
        seen = pool.select("q", "node", "done")
        new = (seen.where(~F.col("done")).join(around, "node")
               .select("q", F.explode("near").alias("node")).distinct()
               .join(seen.select("q", "node"), ["q", "node"], "left_anti"))
        found = pool.withColumn("done", F.lit(True)).unionByName(
            _scored(new, vectors, queries).withColumn("done", F.lit(False)))
        order = Window.partitionBy("q").orderBy(F.desc("sim"), "node")
        pool = materialize(found.withColumn("r", F.row_number().over(order))
                           .where(F.col("r") <= beam).drop("r"), "knn-pool")
    return pool.select("q", "node", "sim")


def nearest_neighbours(rows: DataFrame, is_query: Column, top: int = 5, id_col: str = "vec_id",
                       vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
                       beam: int = BEAM, hops: int = HOPS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``top`` nearest other rows of each query row.

    ``is_query`` is a condition on ``id``.  A query row is in the graph itself, so
    its own node is its entry.
    """
    vectors = materialize(usable(rows, id_col, vec_col), "vectors")
    named = materialize(classes(vectors), "vector-classes")
    nodes = materialize(packed_nodes(vectors, named, TABLES), "vector-nodes")
    graph = build_graph(nodes, k, TABLES, rounds)
    queries = vectors.where(is_query)
    entries = named.where(is_query).select(F.col("id").alias("q"), "node")
    pool = greedy_search(queries, entries, graph, vectors, k, beam, hops)

    order = Window.partitionBy("q").orderBy(F.desc("sim"), "node")
    best = pool.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1).drop("r")
    # Of equal vectors the top + 1 smallest ids suffice: one may be the query itself.
    salted = named.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (("node", "salt"), ("node",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        salted = salted.withColumn("r", place).where(F.col("r") <= top + 1)
    members = salted.select("node", "id")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
    return (best.join(members, "node").where("id <> q").withColumn("rank", rank)
            .where(F.col("rank") <= top)
            .select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"),
                    F.col("sim").alias("score")))
