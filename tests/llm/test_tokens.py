"""The word-wise encoder against the library, packing against its definition, workers without the package."""

from __future__ import annotations

import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from incident_analytics.llm import packing, token_planes
from incident_analytics.llm.queries import byte_bpe
from incident_analytics.llm.tokens import WordIds, byte_slices

SF_DIR = "/root/testdata/sf0.001"
PARTS = [*"ab 'sé.,!\n\t 1\0 　Ç<|ﬀ\x85\x1c ", "<|endoftext|>", "\r", "'ll", " the", "日本", "😀", "  ", "\n\n"]


def library(plain):
    tokenizer = Tokenizer.from_file(byte_bpe())
    tokenizer.encode_special_tokens = plain
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("plain", [False, True])
def test_ids_equal_the_library(plain):
    rng = random.Random(3)
    texts = ["", None, " ", "a  <|endoftext|>  b", "<|endoftext|>", "x" * 5000, "don't I'LL", "a ' s"]
    texts += ["".join(rng.choices(PARTS, k=rng.randrange(30))) for _ in range(4000)]
    ours, whole = WordIds(byte_bpe(), plain, limit=300), library(plain)
    for at in range(0, len(texts), 333):
        part = texts[at:at + 333]
        ids, counts = ours.encode(part, 2)
        assert [g.tolist() for g in np.split(ids, np.cumsum(counts)[:-1])] == [whole(t) + [2] for t in part]
        assert ours.encode(part)[0].tolist() == [i for t in part for i in whole(t)]
    assert len(ours.known) < 3000


def test_slices_by_bytes():
    texts = pa.array(["a" * 10, None, "b" * 25, "", "c" * 9, "d" * 12])
    assert list(byte_slices(texts, 20)) == [(0, 2), (2, 1), (3, 2), (5, 1)]
    assert list(byte_slices(texts.slice(0, 0), 20)) == []


def test_pieces_and_places(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    ids, whole = {}, library(False)
    for r in docs.collect():
        ids[r.doc_id] = whole(r.text) + [2]
    rows = packing.best_fit_packing(docs, byte_bpe()).collect()
    sequences, pieces = {}, {}
    for r in rows:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert 1 <= len(own) == r.length <= 1024
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for doc, own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and own[0][1] == 0
        assert sum(n for _, _, n in own) == len(ids[doc]) and all(n == 1024 for _, _, n in own[1:])
        assert len(own) == -(-len(ids[doc]) // 1024)
    least = -(-sum(map(len, ids.values())) // 1024)
    assert set(ids) == set(pieces) and len(sequences) <= 1.02 * least + 2


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_files_give_back_all_ids(spark, unit):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    whole = library(False)
    manifest = token_planes.write_token_files(docs.repartition(3), byte_bpe(), unit=unit, block_ids=1000)
    rows = token_planes.read_token_files(manifest).orderBy("doc_id").collect()
    start = 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        want = np.array(whole(texts[r.doc_id]) + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert len(rows) == len(texts)
    file = manifest.orderBy("first_id").first()
    with token_planes.open_random(file.path) as source:
        reader = token_planes.PlaneReader(source)
        for i in (0, 7, file.n_docs - 1):
            assert reader.document(i).tolist() == whole(texts[reader.doc_ids[i]]) + [2]


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Workers start in another folder, without the driver's search path."""
    script = tmp_path / "job.py"
    script.write_text(f"""
import os, sys
sys.path.insert(0, {os.getcwd()!r})
from tests.session import make_session
from incident_analytics.llm import queries
spark = make_session("2")
for name in ("op1_best_fit_packing", "op8_token_planes", "op11_collocations", "op12_simhash_near_dedup",
             "op13_token_alignment"):
    assert queries.QUERIES[name](spark, {SF_DIR!r}).count() > 0, name
print("all ran")
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "all ran" in done.stdout, done.stderr[-3000:]
