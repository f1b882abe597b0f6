"""What is found for a text does not depend on its neighbours, its partition or the number of languages."""

from __future__ import annotations

import random

import numpy as np

from incident_analytics.llm import language_mix
from incident_analytics.llm.rows import crc_of_id

SF_DIR = "/root/testdata/sf0.01"


def test_alone_and_in_any_slice(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")
    model = language_mix.learn(docs.where(crc_of_id() % 4 != 2))
    texts = [(r.doc_id, r.text) for r in docs.limit(250).collect()] + [(-1, "ok"), (-2, "et the und de la of")]
    texts = [(i, t) for i, t in texts if t and language_mix.words_of(t)]
    bags = {i: language_mix.words_of(t) for i, t in texts}
    alone = {i: language_mix.mixtures(model, [w])[0] for i, w in bags.items()}
    ids = list(bags)
    for seed in range(3):
        random.Random(seed).shuffle(ids)
        for start in range(0, len(ids), 90):
            part = ids[start:start + 90]
            for i, (langs, shares) in zip(part, language_mix.mixtures(model, [bags[i] for i in part])):
                assert langs == alone[i][0] and np.allclose(shares, alone[i][1], atol=1e-9)
    got = {}
    for parts in (1, 7):
        df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(parts)
        got[parts] = {r.doc_id: (r.lang_pred, r.langs, [round(x, 9) for x in r.shares])
                      for r in language_mix.identify(df, model).collect()}
    assert got[1] == got[7]


def test_six_languages_in_one_text():
    """A text of equal parts in six made-up languages names all six."""
    rng = random.Random(1)
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    words = [["".join(rng.choices(a, k=5)).encode() for _ in range(400)] for a in letters]
    counts = np.stack([language_mix.count_cells(w) for w in words], axis=1) + language_mix.SMOOTHING
    model = language_mix.Model(tuple("pqrstu"), np.log(counts / counts.sum(axis=0)))
    langs, shares = language_mix.mixtures(model, [[w for own in words for w in own[:100]]])[0]
    assert sorted(langs) == list("pqrstu") and max(shares) < 0.2
    assert language_mix.mixtures(model, [words[2]])[0][0] == ["r"]
