"""Collocations, fingerprints and token alignment against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from incident_analytics.llm import align_tokens, collocations, simhash_dedup
from incident_analytics.llm.queries import byte_bpe, piece_bpe

SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}, next" for i in range(30_000)) + "."
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")


# --- collocations ------------------------------------------------------------------


def plain_collocations(rows, least, covered, top):
    f, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in (1, 2, 3, 4):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    around[p[i:i + n]] = max(around[p[i:i + n]], a)
        kept = []
        for p, a in candidates.items():
            if p in around and 100 * around[p] >= covered * a:
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, totals[lang], -s)
                for i, (s, a, p, le, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts(seed, n=400):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(12)] + ["é", "x y", "z\x1c"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!", ":", " \n ", "\r\n", "\x0b"]
    made = []
    for i in range(n):
        text = "".join(w + rng.choice(marks) for w in rng.choices(words, range(15, 0, -1), k=rng.randrange(60)))
        made.append((text, rng.choice(["en", "de", None, ""])))
    return [*made, (None, "en"), ("", "fr"), (" \n", None), ("w1 w2 w3 w4 w5 " * 9, "en")]


@pytest.mark.parametrize("bits", [26, 6])
def test_collocations_equal_plain_counts(spark, bits):
    """A bit set of 64 bits is full and prunes nothing; the result stays the same."""
    rows = texts(bits)
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({"a": F.lit(1), "w1": F.lit("x")})
    got = collocations.collocations(df.repartition(5), least=5, covered=80, top=40, filter_bits=bits)
    want = plain_collocations(rows, 5, 80, 40)
    assert len(want) > 100 and sorted(tuple(r) for r in got.collect()) == want


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).count() == 0
    long = spark.createDataFrame([(LONG, "en")], "text string, lang string")
    got = [tuple(r) for r in collocations.collocations(long).collect()]
    assert got == plain_collocations([(LONG, "en")], 30, 80, 2000)


# --- fingerprints ------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(named):
    """Smallest reachable id by comparing all pairs of (id, fingerprint)."""
    ids = sorted({i for i, _ in named})
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = np.array([f for _, f in named], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        x, y = root(named[a][0]), root(named[b][0])
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprints_of_documents(spark):
    rows = documents(spark).collect()
    got = {r.doc_id: r for r in simhash_dedup.simhash_duplicates(documents(spark)).collect()}
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    want = plain_components(sorted(fps.items()))
    assert {i: r.component_id for i, r in got.items()} == want and len(set(want.values())) < len(want)
    spark_hash = spark.sql("SELECT xxhash64('the four word shingle') AS h").first().h
    assert spark_hash & (1 << 64) - 1 == xxhash.xxh64_intdigest("the four word shingle", 42)


@pytest.mark.parametrize("chunk,blocks", [(1024, 5), (8, 5), (8, 6), (3, 7)])
def test_crowded_buckets_lose_no_link(spark, chunk, blocks):
    """Chains and clusters of fingerprints, with tiny chunks so that buckets are dealt to cells."""
    rng = random.Random(chunk + blocks)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5, 6])):
                x ^= 1 << b
            fps.add(x)
    named = list(enumerate(rng.sample(sorted(fps), len(fps))))
    refs = simhash_dedup.pivots()
    signed = [(i, f - (1 << 64) if f >> 63 else f,
               bytearray(np.bitwise_count(np.uint64(f) ^ refs).astype(np.uint8).tobytes())) for i, f in named]
    classes = spark.createDataFrame(signed, "id bigint, fp bigint, near binary")
    chunks = simhash_dedup.packed_chunks(simhash_dedup.bucket_entries(classes, 4, blocks), chunk)
    links = {(r.a, r.b) for r in simhash_dedup.chunk_links(chunks, 4).collect()}
    fp = dict(named)
    parent = {i: i for i in fp}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {i: root(i) for i in fp} == plain_components(named)


def test_blocks_follow_the_number_of_classes():
    assert [simhash_dedup.enough_blocks(n, 4, 256) for n in (0, 10**5, 10**7, 10**11)] == [5, 5, 6, 8]
    for n in (5, 6, 8, 12):
        masks = simhash_dedup.block_masks(n)
        assert sum(masks) == (1 << 64) - 1 and len(masks) == n


def test_fingerprint_cases(spark):
    rows = [(1, "a b c d e f g"), (2, "A b C d e f g"), (2, "other words here now and then"), (3, None), (4, " \n"),
            (5, ""), (None, "a b c d e f g"), (6, "other words here now and then"), (7, LONG), (8, "one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fp": F.lit("x"), "near": F.lit(1)})
    got = defaultdict(list)
    for r in simhash_dedup.simhash_duplicates(df).collect():
        got[r.doc_id].append(r)
    assert {i: got[i][0].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8)} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 1, 7: 7, 8: 8}
    assert got[None][0].component_id is None and got[None][0].fingerprint == got[1][0].fingerprint
    assert got[3][0].fingerprint == "0" * 16 and len(got[2]) == 2
    assert all(int(r.fingerprint, 16) == plain_fingerprint(t) for i, t in rows if i in (7, 8) for r in got[i])
    assert simhash_dedup.simhash_duplicates(df.limit(0)).count() == 0


# --- alignment ---------------------------------------------------------------------


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(byte_bpe())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe())
    back = {c: x for x, c in align_tokens.byte_alphabet().items()}
    raw_a = lambda i: bytes(back[c] for c in a.id_to_token(i))

    def raw_b(i):
        piece = b.id_to_piece(i)
        one = re.fullmatch("<0x(..)>", piece)
        return bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode()

    def placed(ids, raw):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(raw(i))))
            at = out[-1][2]
        return out

    held, docs = Counter(), []
    for doc_id, text in rows:
        xs = placed(a.encode(" " + text, add_special_tokens=False).ids, raw_a) if text else []
        ys = placed(b.encode(text), raw_b) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(raw_a(i) for i, _, _ in xs) != want or b"".join(raw_b(i) for i, _, _ in ys) != want:
            xs, ys = [], []
        links = [(x, y) for x, p, q in xs for y, r, s in ys if p < s and r < q]
        ends = sorted({q for _, _, q in xs} & {s for _, _, s in ys})
        groups, start = [], 0
        for e in ends:
            groups.append(",".join(str(x) for x, _, q in xs if start < q <= e) + "|"
                          + ",".join(str(y) for y, _, s in ys if start < s <= e))
            start = e
        held.update(set(links))
        docs.append((doc_id, len(xs), len(ys), len(ends), links,
                     hashlib.sha256(";".join(groups).encode()).hexdigest() if xs else ""))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted((d, na, nb, g, len(li), sum(held[p] == best[p[0]] for p in li), sum(held[p] for p in li), sha)
                  for d, na, nb, g, li, sha in docs)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    parts = ["the ", "Wort", " é", "\n", "  ", "\t", "日本", "😀", "don't", "<|endoftext|>", "<s>", "</s>", "▁", "\x00", " ", "1234", "...", "\r\n", "<0x41>", " ", "ﬁ", "é"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(300)]
    rows += [(r.doc_id + 1000, r.text) for r in documents(spark).where("length(text) < 600").limit(60).collect()]
    rows += [(900, None), (901, ""), (901, "again"), (902, " "), (903, " lead"), (904, "trail ")]
    want = plain_alignment(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n_a": F.lit("x"), "ids": F.lit(1)})
    got = align_tokens.align_tokenizers(df.repartition(4), byte_bpe(), piece_bpe()).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == want
    assert sum(1 for r in want if r[1] == 0) >= 3


def test_pair_counts_in_many_files(spark):
    """Counts over several files are looked up as from one."""
    df = documents(spark).where("doc_id < 60").repartition(3)
    slices = align_tokens.aligned_slices(df, byte_bpe(), piece_bpe(), "doc_id", "text")
    counts = align_tokens.pair_counts(slices, merged=1000)
    one = {r.code: (r.docs, r.best) for r in align_tokens.pair_counts(slices).collect()}
    assert {r.code: (r.docs, r.best) for r in counts.collect()} == one
    files = align_tokens.count_files(counts, most=500)
    assert len(files) > 3 and files == sorted(files, key=lambda f: f[1])
    read = {}
    for path, first in files:
        codes, values = align_tokens._read_counts(path)
        assert codes[0] == first and (np.diff(codes) > 0).all()
        read |= {c: (v >> 1, bool(v & 1)) for c, v in zip(codes.tolist(), values.tolist())}
    assert read == one


def test_alignment_in_many_files_equals_one(spark, monkeypatch):
    df = documents(spark).where("doc_id < 60")
    whole = sorted(align_tokens.align_tokenizers(df, byte_bpe(), piece_bpe()).collect())
    monkeypatch.setattr(align_tokens, "count_files", lambda counts, make=align_tokens.count_files: make(counts, 700))
    assert sorted(align_tokens.align_tokenizers(df, byte_bpe(), piece_bpe()).collect()) == whole
    assert align_tokens.align_tokenizers(df.limit(0), byte_bpe(), piece_bpe()).count() == 0
    long = spark.createDataFrame([(None, LONG)], "doc_id bigint, text string")
    row = align_tokens.align_tokenizers(long, byte_bpe(), piece_bpe()).first()
    assert row.doc_id is None and row.n_groups > 60_000 and row.n_best == row.n_links == row.count_sum
