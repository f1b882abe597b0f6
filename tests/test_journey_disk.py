"""The journey and its search write no copies: neither of blocks per cell nor of the knowledge base's texts."""

from __future__ import annotations

import os
import random

import numpy as np
from pyspark.sql import functions as F

from incident_analytics import session
from incident_analytics.catalog import bindings, models
from incident_analytics.operators import retrieval
from incident_analytics.operators.retrieval import similar_topk


def bytes_below(*folders):
    size = 0
    for folder in folders:
        for at, _, names in os.walk(folder):
            for name in names:
                try:
                    size += os.path.getsize(os.path.join(at, name))
                except OSError:  # Spark may clean up meanwhile
                    pass
    return size


def vectors(spark, n, dim, parts):
    rows = np.random.default_rng(n).normal(size=(n, dim))
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)],
                                 "vec_id bigint, embedding array<float>").repartition(parts, "vec_id")


def test_search_shuffles_no_block_once_per_group(spark, monkeypatch, tmp_path):
    df = vectors(spark, 1500, 64, 4)
    df.write.parquet(f"{tmp_path}/v")
    df = spark.read.parquet(f"{tmp_path}/v")
    raw = 1500 * 64 * 4
    monkeypatch.setattr(retrieval, "CELL_BYTES", raw // 16)
    local = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
                 .localDirsString())
    before = bytes_below(*local)
    got = similar_topk(df.withColumnRenamed("vec_id", "query_id"), df, 2, None, exclude_self=True, block_rows=20)
    assert got.count() == 3000
    # Sixteen groups a side: copies would be 32 times the vectors; the queries are dealt out once.
    assert bytes_below(*local) - before < 4 * raw


def test_pieces_of_one_group_are_merged(spark, monkeypatch):
    """Ties, copies and zero vectors, in one group of the knowledge base that is read in many pieces."""
    rng = random.Random(11)
    rows = [(5 * i, [0.0] * 4 if i % 11 == 0 else [float(rng.randint(-1, 2)) for _ in range(4)]) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    monkeypatch.setattr(retrieval, "CELL_BYTES", 500)
    m = np.array([v for _, v in rows])
    scores = m @ m.T
    for threshold in (None, 2.0):
        got = similar_topk(df.withColumnRenamed("vec_id", "query_id"), df, 4, threshold, exclude_self=True, shards=1,
                           block_rows=7)
        want = []
        for q, (qid, _) in enumerate(rows):
            best = sorted((-scores[q, c], cid) for c, (cid, _) in enumerate(rows)
                          if cid != qid and (threshold is None or scores[q, c] >= threshold))[:4]
            want += [(qid, cid, -s, i + 1) for i, (s, cid) in enumerate(best)]
        assert sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in got.collect()) == sorted(want)


def tables(spark, folder, n_docs, words):
    """Documents of invented words, some of them labelled twice, and the other tables of the journey."""
    rng = random.Random(3)
    pool = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(20_000)]
    docs = [(i, " ".join(rng.choices(pool, k=words)), ("en", "de")[i % 2], "web") for i in range(n_docs)]
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(2).write.parquet(
        f"{folder}/{name}.parquet")
    save([(*d, len(d[1])) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint",
         "documents")
    save([(i, 1, i % 2) for i in [*range(n_docs), *range(n_docs - 5, n_docs)]], "doc_id bigint, quality int, toxic int", "labels")
    save([(i, f"close case {i}") for i in range(40)], "item_id bigint, text string", "benchmark")
    save([(c, t, "user", docs[c][1][t * 7000:7000 * (t + 1)]) for c in range(12) for t in (0, 1)],
         "conv_id bigint, turn bigint, role string, text string", "conversations")
    return docs


def test_journey_stores_vectors_once_and_no_texts(spark, monkeypatch, tmp_path):
    docs = tables(spark, tmp_path, 300, 1500)
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"{tmp_path}/shared")
    rows = models.QUERIES["incident_journey"](spark, str(tmp_path)).collect()
    assert len(rows) == 12 and all(r.resolution.startswith("close case") for r in rows)
    assert all("Reported as: " in r.prompt and r.grounded_on for r in rows)
    vectors_once = 305 * 384 * 4
    texts = sum(len(d[1]) for d in docs)
    assert bytes_below(f"{tmp_path}/shared") < 2 * vectors_once < texts / 2


def test_labels_leave_the_texts_in_place(spark, tmp_path):
    """Labels beyond the size that is broadcast by itself do not shuffle the documents; all rows are kept."""
    tables(spark, tmp_path, 60, 20)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kb = bindings.kb_metadata(spark, str(tmp_path)).where(F.col("description").isNotNull())
        plan = kb._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [doc_id" in plan and "SortMergeJoin [doc_id" not in plan
        assert kb.count() == 65 and kb.select("vec_id").distinct().count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
