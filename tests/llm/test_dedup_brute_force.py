"""Near-duplicates and the pipeline's stages against plain versions over whole documents."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from incident_analytics.llm import minmax_dedup
from incident_analytics.llm.queries import op9_minhash_near_dedup
from incident_analytics.llm.rows import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text: str | None, k: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def plain_components(texts: dict[int, str | None], k: int, percent: int) -> dict[int, int]:
    """Every pair of different sets compared; classes of equal sets are one node."""
    classes: dict[frozenset, list[int]] = {}
    for i, text in texts.items():
        classes.setdefault(shingles(text, k), []).append(i)
    root = {i: i for i in texts}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    def link(i: int, j: int) -> None:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)

    sets = [(s, ids) for s, ids in classes.items() if s]
    for _, ids in sets:
        for other in ids[1:]:
            link(ids[0], other)
    for at, (a, ids) in enumerate(sets):
        for b, others in sets[at + 1:]:
            if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    link(ids[0], others[0])
    return {i: find(i) for i in texts}


def test_query_equals_all_pairs(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents", "doc_id", "text").collect()}
    want = plain_components(texts, 3, 85)
    got = op9_minhash_near_dedup(spark, sf).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, 3)) for i, t in texts.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_groups_and_chains_equal_all_pairs(spark, seed):
    """Half the rows copies of one text, a third near copies in chains, short and empty texts, strays."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    hot = [word() for _ in range(120)]
    texts: dict[int, str | None] = {}
    chain = [word() for _ in range(150)]
    for i in range(400):
        kind = rng.random()
        if kind < 0.5:
            texts[i] = " ".join(hot).upper() if rng.random() < 0.3 else "  ".join(hot)
        elif kind < 0.8:
            chain[rng.randrange(len(chain))] = word()
            texts[i] = "\t".join(chain)
        else:
            texts[i] = rng.choice([None, "", " \n", "one", "One", "one two", " ".join(word() for _ in range(60))])
    order = list(texts)
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id bigint, text string").repartition(7)
    for k, percent in ((3, 85), (5, 80)):
        got = minmax_dedup.near_duplicates(docs, k=k, percent=percent).collect()
        assert {r.doc_id: r.component_id for r in got} == plain_components(texts, k, percent)


def test_stages_decide_as_plain_versions(spark, sf):
    """The dedup stage keeps one document per component, and packing holds every kept id once, in order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    languages = corpus_pipeline.known_language(spark, docs, sf).cache()
    letters = {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    assert {r.doc_id for r in languages.select("doc_id").collect()} == letters
    quality = corpus_pipeline.good_quality(spark, languages, sf).cache()
    known = {r.doc_id: r.text for r in languages.collect()}
    kept = {r.doc_id: r.text for r in quality.collect()}
    for i, text in kept.items():  # surviving lines are lines of the text, in order
        lines = iter((known[i] or "").split("\n"))
        assert all(any(line == other for other in lines) for line in text.split("\n"))
    unique = corpus_pipeline.one_of_each_group(spark, quality, sf).cache()
    groups = plain_components(kept, 5, 80)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(groups.values()))
    mixed = corpus_pipeline.target_mix(spark, unique, sf).cache()
    assert {r.doc_id for r in mixed.collect()} <= set(groups.values()) and mixed.columns == docs.columns
    pieces = corpus_pipeline.packed(spark, mixed, sf).cache()
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in mixed.collect()}
    places = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("at")).collect()
    for row in places:
        end = 0
        for place in row["at"]:
            assert place.offset == end
            end += place.length
        assert end == row.n <= 1024
