from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from incident_analytics.operators import attachments as a
from incident_analytics.operators import conversations as v
from incident_analytics.operators import grounding as g
from incident_analytics.operators import retrieval
from incident_analytics.operators.generate import generate_tickets
from incident_analytics.operators.metered import apply_metered, metered_log
from incident_analytics.operators.retrieval import embed_corpus, hits_with_metadata, similar_topk
from incident_analytics.operators.scale import least_common_count
from incident_analytics.operators.summarize import extractive_summaries
from incident_analytics.functions.logs import day_bucket, with_prompt_style
from incident_analytics.functions.text import thread_title
from incident_analytics.session import scratch_path
from incident_analytics.sources.stores import read_attachments, read_sops

META = "vec_id bigint, ticket_id string, title string, description string, resolution string, category string, priority string"


def test_hits_golden(spark):
    kb = spark.createDataFrame([(0, "TKT-00001", "VPN down", "d1" * 200, "restart vpn", "IT Support", "high"),
                                (1, "TKT-00002", "Invoice", "d2", "correct it", "Billing", None)], META)
    hits = spark.createDataFrame([(7, 0, 0.91004, 1), (7, -1, -1.0, 2)], "query_id bigint, vec_id bigint, score double, rank int")
    rows = hits_with_metadata(hits, kb).collect()
    assert [(r.ticket_id, r.score, len(r.description)) for r in rows] == [("TKT-00001", 0.91, 300)]


def test_topk_equals_brute_force_with_ties_and_small_blocks(spark):
    rng = random.Random(5)
    vecs = [[float(rng.randint(-2, 2)) for _ in range(4)] for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id bigint, embedding array<float>").repartition(6)
    got = similar_topk(df.withColumnRenamed("vec_id", "query_id"), df, 3, 2.0, exclude_self=True, shards=5, block_rows=7)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    m = np.array(vecs)
    scores = m @ m.T
    for q in range(300):
        best = sorted(((-scores[q, k], k) for k in range(300) if k != q and scores[q, k] >= 2.0))[:3]
        assert sorted(found.get(q, [])) == [(i + 1, k, -s) for i, (s, k) in enumerate(best)]


def plain_topk(rows, k, threshold=-np.inf):
    m = np.array([v for _, v in rows])
    scores = m @ m.T
    out = []
    for q, (qid, _) in enumerate(rows):
        best = sorted((-scores[q, c], cid) for c, (cid, _) in enumerate(rows)
                      if cid != qid and np.isfinite(scores[q, c]) and scores[q, c] >= threshold)[:k]
        out += [(qid, cid, -s, i + 1) for i, (s, cid) in enumerate(best)]
    return sorted(out)


def test_topk_beside_vectors_that_hold_nan(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, [1.0, 3.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1)
    got = similar_topk(df.withColumnRenamed("vec_id", "query_id"), df, 3, None, exclude_self=True).collect()
    assert sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in got) == plain_topk(rows, 3)


def test_topk_in_many_cells_and_pieces(spark, monkeypatch):
    """Copies, zero vectors and lengths beyond single precision, over cells and pieces of odd sizes."""
    rng = random.Random(8)
    rows = [(3 * i, [0.0] * 3 if i % 9 == 0 else [float(rng.randint(-3, 3)) * (1e20 if i % 50 == 1 else 1.0) for _ in range(3)])
            for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3, "vec_id")
    monkeypatch.setattr(retrieval, "CELL_BYTES", 1000)
    for threshold in (None, 1.5):
        got = similar_topk(df.withColumnRenamed("vec_id", "query_id"), df, 4, threshold, exclude_self=True, block_rows=9)
        want = plain_topk([(i, list(np.array(v, dtype=np.float32).astype(float))) for i, v in rows], 4,
                          -np.inf if threshold is None else threshold)
        assert sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in got.collect()) == want
    q, kb = (rng_rows(300, 5), rng_rows(700, 5))
    monkeypatch.setattr(retrieval, "_QUERY_ROWS", 37)
    monkeypatch.setattr(retrieval, "_KB_ROWS", 11)
    scores, ids = retrieval.best_hits(np.arange(300), q, np.arange(700), kb, 6, None, False)
    exact = q.astype(float) @ kb.astype(float).T
    assert np.allclose(np.sort(exact, axis=1)[:, ::-1][:, :6], scores, rtol=0, atol=1e-12)
    assert np.allclose(np.take_along_axis(exact, ids, 1), scores, rtol=0, atol=1e-12)


def rng_rows(n, dim):
    return np.random.default_rng(n).normal(size=(n, dim)).astype(np.float32)


def test_a_side_is_copied_once_per_group_of_the_other(spark):
    """Copies follow from bytes and cores and not from the number of shuffle partitions; a cell stays bounded."""
    for side in ((1, 1000), (600, 79 << 20), (6000, 786 << 20), (40_000, 5 << 30)):
        for other in ((1, 1000), (1200, 157 << 20), (6000, 786 << 20)):
            q, k = retrieval._grid(side, other, 12)
            assert side[1] / q <= retrieval.CELL_BYTES and other[1] / k <= retrieval.CELL_BYTES
            assert q <= max(48, side[1] // retrieval.CELL_BYTES + 1) and k <= max(48, other[1] // retrieval.CELL_BYTES + 1)
            assert q * k >= min(48, side[0] * other[0])


def test_custom_encoder_gives_unit_vectors(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "")], "id bigint, text string")
    encode = lambda texts: np.array([[len(t), 2.0 * len(t)] for t in texts])
    got = {r.id: r.embedding for r in embed_corpus(df, encoder=encode).collect()}
    assert abs(got[1][0] ** 2 + got[1][1] ** 2 - 1) < 1e-6 and got[2] == [0.0, 0.0]


def test_encoder_is_loaded_where_it_runs(spark, tmp_path):
    """The loader makes something that cannot be pickled, once per worker process, not once per batch."""
    folder = str(tmp_path)

    def load():
        import os
        import threading
        import uuid
        lock = threading.Lock()  # stands for weights: no pickle of it exists
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def encode(texts):
            with lock:
                return np.array([[float(len(t)), 3.0] if t else [0.0, 0.0] for t in texts])
        return encode

    df = spark.range(400).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("a"), F.col("id").cast("int") % 7))
                                 .otherwise(F.lit(None)).alias("text")).repartition(4)
    got = {r.id: r.embedding for r in embed_corpus(df, load_encoder=load, batch_size=16).collect()}
    assert got[7] == [0.0, 0.0] and abs(got[4][0] - 0.8) < 1e-6 and abs(got[4][1] - 0.6) < 1e-6
    loads = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert 1 <= len(loads) <= 8 and len(loads) == len(set(loads))


def test_pdfs_by_the_callers_reader(spark):
    def reader(data):
        if not data.startswith(b"%PDF"):
            raise ValueError("no PDF")
        return [page.decode() for page in data[4:].split(b"|")]

    files = spark.createDataFrame([(1, "a.PDF", b"%PDFone| two "), (2, "b.pdf", b"nothing"), (3, "c.txt", b" plain "),
                                   (4, "d.pdf", None)], "id int, filename string, content binary")
    got = {r.id: tuple(r.attachment) for r in a.extract_attachments(files, max_chars=5, pdf_reader=reader).collect()}
    assert got[1] == ("pdf", 8, "one\n ", "text of 2 PDF page(s)")
    assert got[2] == ("error", 0, "", "PDF not readable: ValueError")
    assert got[3] == ("text", 5, "plain", "") and got[4][:3] == ("pdf", 0, "")
    assert a.extract_attachments(files).columns == a.extract_attachments(files, pdf_reader=reader).columns


def test_metered_batches_equal_single_calls(spark):
    def one(text):
        if text == "bad":
            raise ValueError("bad text")
        return text.upper(), 2, 3

    def many(frame):
        return [one(t) for t in frame["text"]]

    df = spark.createDataFrame([(i, ["x", "y", "bad", "z"][i % 4]) for i in range(40)], "id bigint, text string")
    timeless = lambda out: sorted(map(tuple, out.drop("latency_ms").collect()))
    single = timeless(apply_metered(df, one, "t", "m", ["text"]))
    assert timeless(apply_metered(df, many, "t", "m", ["text"], batched=True)) == single
    short = apply_metered(df, lambda frame: ["only one"], "t", "m", ["text"], batched=True)
    assert short.where("status = 'ok'").count() == 40  # called one by one, every answer fits


def test_prompts_golden(spark, tmp_path):
    (tmp_path / "it_support.md").write_text("SOP for IT Support\nTriage first", encoding="utf-8")
    sops = read_sops(spark, str(tmp_path), "*.md")
    inc = spark.createDataFrame([(1, " login down ", "IT Support", "stepwise"), (2, "mystery", None, "nonsense")],
                                "query_id bigint, incident string, category string, style string")
    hits = spark.createDataFrame([(1, 1, "TKT-00042", 0.88, "Login fails", "users", "reset SSO")],
                                 "query_id bigint, rank int, ticket_id string, score double, title string, "
                                 "description string, resolution string")
    got = {r.query_id: r for r in g.build_prompts(inc, hits, sops).collect()}
    one, two = got[1].messages[1].content, got[2].messages[1].content
    for part in ("NEW INCIDENT:\nlogin down\n", "TKT-00042 | Login fails | score 0.8800", "reset SSO",
                 "STANDARD OPERATING PROCEDURE (IT Support):\nSOP for IT Support"):
        assert part in one
    assert "none above threshold" in two and "STANDARD OPERATING PROCEDURE" not in two
    assert got[2].style == "stepwise" and got[2].prompt_version == "resolve-v1-stepwise"
    answers = {r.query_id: r.resolution for r in g.fallback_resolution(inc, hits).collect()}
    assert answers == {1: "reset SSO", 2: g.NO_RESOLUTION}


def test_styles_are_total(spark):
    df = spark.createDataFrame([("CONCISE ",), ("",), (None,), ("x",)], "style string")
    assert sorted(r.style for r in with_prompt_style(df).collect()) == ["concise"] + ["stepwise"] * 3


def test_sentences_of_large_vocabularies_score_the_same(spark):
    df = spark.createDataFrame([(i, f"The server room number {i} is hot. The fan is loud! Word{i} unique{i} fails. "
                                    "The end of it.") for i in range(30)] + [(99, "short")], "id bigint, text string")
    small = {r.id: r.summary for r in extractive_summaries(df, keep=2).collect()}
    large = {r.id: r.summary for r in extractive_summaries(df, keep=2, vocabulary_rows=0).collect()}
    assert small == large and small[99] == "short"
    assert "Word3 unique3 fails." in small[3] and "The end of it." not in small[3]


def test_only_rare_tokens_are_joined_by_shuffle(spark):
    """The most frequent tokens of a vocabulary beyond the bound are broadcast; the digests stay the same."""
    counts = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7), ("d", 2), ("e", 1)], "token string, df bigint")
    common = {n: counts.where(F.col("df") >= least_common_count(counts, "df", n)).count() for n in (0, 1, 2, 3, 4, 5)}
    assert common == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}
    df = spark.createDataFrame([(i % 25, f"The server room number {i % 25} is hot.\tThe fan  is loud! Word{i} unique{i} fails. "
                                         "The end of it.") for i in range(30)]
                               + [(3, "short"), (99, "?" * 50), (98, None)], "id bigint, text string")
    plain = sorted(map(tuple, extractive_summaries(df, keep=2).collect()))
    for bound in (0, 3, 9):
        assert sorted(map(tuple, extractive_summaries(df, keep=2, vocabulary_rows=bound).collect())) == plain
    shared = [text for i, text in plain if i == 3]  # rows of one id share the sentences of all of them
    assert len(shared) == 3 and len(set(shared)) == 1 and "Word3 unique3" in shared[0] and "Word28 unique28" in shared[0]
    assert (99, "?" * 50) in plain and (98, "") in plain


def test_texts_are_shuffled_once(spark):
    df = spark.range(9).select("id", F.repeat(F.lit("One more line. "), 9).alias("text"))
    plan = extractive_summaries(df)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 2  # idf by token, best sentences by id


def test_titles_and_buckets(spark):
    text = "word " * 30
    row = spark.createDataFrame([("Short  one", "", text)], "a string, b string, c string").select(
        *[thread_title(F.col(x)).alias(x) for x in "abc"]).first()
    assert (row.a, row.b) == ("Short one", "New incident")
    assert row.c.endswith("word…") and len(row.c) <= 49
    days = spark.range(1).select(*[day_bucket(F.lit(f"2024-01-{d:02d} 23:00:00").cast("timestamp_ntz"),
                                              F.lit("2024-01-31 01:00:00").cast("timestamp_ntz")) for d in (31, 30, 27, 1)])
    assert list(days.first()) == ["Today", "Yesterday", "Previous 7 days", "Older"]


def test_threads_pages_and_deletion(spark):
    msgs = spark.range(50).select(
        "id", F.when(F.col("id") % 3 == 0, 1).otherwise(2).cast("bigint").alias("conversation_id"), F.lit("user").alias("role"),
        F.concat(F.lit("m"), "id").alias("content"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    pages = v.thread_messages(msgs, 10).where("conversation_id = 2").orderBy("page").collect()
    assert [len(p.messages) for p in pages] == [10, 10, 10, 3]
    assert [m.content for m in pages[0].messages][:3] == ["m1", "m2", "m4"]
    index = v.conversation_index(msgs)
    assert {r.conversation_id: r.title for r in index.collect()} == {1: "m0", 2: "m1"}
    conv, left = v.delete_threads(index, msgs, spark.createDataFrame([(2,)], "conversation_id bigint"))
    assert conv.count() == 1 and left.count() == 17


def test_attachment_files(spark, tmp_path):
    for name, data in {"a b.txt": b" caf\xe9 \n", "x.PNG": b"\x89", "s.pdf": b"%PDF", "big.log": b"z" * 5000, "odd.bin": b"a"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.filename: r.attachment for r in read_attachments(spark, str(tmp_path), "*").collect()}
    assert (got["a b.txt"].kind, got["a b.txt"].text) == ("text", "caf�")
    assert got["x.PNG"].kind == "image" and got["s.pdf"].kind == "error"
    assert (got["big.log"].chars, len(got["big.log"].text)) == (5000, 5000)
    assert got["odd.bin"].note == "read 'odd.bin' as text"
    inc = spark.createDataFrame([(1, "down ")], "incident_id bigint, incident string")
    att = spark.createDataFrame([(1, b"log line")], "incident_id bigint, content binary").withColumn("filename", F.lit("a.log"))
    merged = a.merge_incidents(inc, a.extract_attachments(att)).first().incident
    assert merged == "down\n\n--- Attached context (text) ---\nlog line"


def test_metered_golden(spark):
    def shout(text):
        if text == "boom":
            raise RuntimeError("intentional failure")
        return (text.upper(), 100, 25) if text == "exact" else text.upper()

    df = spark.createDataFrame([(1, "hi"), (2, "hi"), (3, "boom"), (4, "boom"), (5, "exact")], "id bigint, text string")
    out = apply_metered(df, shout, "echo", "unit", ["text"]).cache()
    got = {r.id: r for r in out.collect()}
    assert (got[1].output, got[1].cache_hit, got[2].output, got[2].cache_hit) == ("HI", False, "HI", True)
    assert got[3].output is None and got[3].error == "RuntimeError: intentional failure"
    assert got[4].status == "error" and not got[4].cache_hit
    assert (got[5].tokens_in, got[5].tokens_out, got[5].tokens_estimated) == (100, 25, False)
    rows = metered_log(out.withColumn("ts", F.current_timestamp()), "echo", "unit", "ts")
    assert rows.where("status = 'error'").count() == 2


def test_generated_tickets(spark):
    rows = generate_tickets(spark, 60).collect()
    counts = {}
    for r in rows:
        counts[r.category] = counts.get(r.category, 0) + 1
        assert "{" not in r.title + r.description + r.resolution
    assert set(counts.values()) == {10} and len(counts) == 6
    assert rows == generate_tickets(spark, 60).repartition(7).orderBy("ticket_id").collect()
    assert rows != generate_tickets(spark, 60, seed=1).collect()


def test_scratch_paths_are_new(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
