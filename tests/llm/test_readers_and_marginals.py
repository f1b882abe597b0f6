"""Single records and documents read from their files, and the shares that raking reaches."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from incident_analytics.llm import mixing, token_planes, warc_bundle
from incident_analytics.llm.files import open_random
from incident_analytics.llm.queries import byte_bpe


def test_seeking_a_record_gives_what_reading_all_gives(spark):
    """Small frames, so records lie in many; equal payloads, an empty and a very long page among them."""
    rng = random.Random(2)
    html = ["<p>" + " ".join(rng.choices("abcdefgh", k=rng.randint(1, 400))) for _ in range(60)]
    html += [html[5], html[5], "", None, "long " * 40_000]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)],
                                  "page_id bigint, url string, html string").repartition(3)
    manifest = warc_bundle.write_bundles(pages, frame_bytes=2_000).collect()
    assert sum(m.n_records for m in manifest) == len(html) and sum(m.n_frames for m in manifest) > 10
    seen = set()
    for m in manifest:
        with open_random(m.path) as source:
            reader = warc_bundle.BundleReader(source)
            for page_id, _, _, raw in list(reader.records()):
                assert reader.record(page_id) == raw
                fields, payload = warc_bundle.parse_record(raw)
                if fields["WARC-Type"] == "response":
                    assert payload == (html[page_id] or "").encode()
                seen.add(page_id)
            assert reader.record(10_000) is None
    assert seen == set(range(len(html)))


def test_documents_across_blocks_read_alone(spark):
    """Blocks of 64 ids: documents begin and end inside blocks and reach over many."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.choice([0, 1, 40, 300]))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    import tokenizers
    plain = tokenizers.Tokenizer.from_file(byte_bpe())
    for unit in ("byte", "bit"):
        manifest = token_planes.write_token_files(docs, byte_bpe(), unit=unit, block_ids=64).collect()
        seen = set()
        for m in manifest:
            with open_random(m.path) as source:
                reader = token_planes.PlaneReader(source)
                for i in rng.sample(range(m.n_docs), m.n_docs):  # in any order
                    doc = reader.doc_ids[i]
                    assert reader.document(i).tolist() == plain.encode(texts[doc], add_special_tokens=False).ids + [2]
                    seen.add(doc)
        assert seen == set(range(len(texts)))


def _targets(spark, **shares):
    return {d: spark.createDataFrame(list(v.items()), f"{d} string, share double") for d, v in shares.items()}


def test_raking_meets_given_shares(spark):
    rng = random.Random(6)
    cells = spark.createDataFrame(
        [(s, la, t, rng.randint(50, 5000)) for s in "abc" for la in ("en", "de") for t in ("legal", "prose")],
        "source string, lang string, topic string, tokens bigint")
    targets = _targets(spark, source={"a": 0.5, "b": 0.3, "c": 0.2}, lang={"en": 0.6, "de": 0.4},
                       topic={"legal": 0.1, "prose": 0.9})
    found = mixing.marginals(mixing.rake(cells, targets), targets).collect()
    assert len(found) == 7 and 5e-5 < max(r.residual for r in found) < 1e-3  # ten rounds come near
    found = mixing.marginals(mixing.rake(cells, targets, tolerance=5e-5), targets).collect()
    assert len(found) == 7 and max(r.residual for r in found) <= 5e-5
    # A target without tokens can't be met, and says so.
    targets["source"] = _targets(spark, source={"a": 0.5, "b": 0.3, "none": 0.2})["source"]
    left = {(r.dimension, r.value): r for r in mixing.marginals(mixing.rake(cells, targets, 2, 1e-6), targets).collect()}
    assert left["source", "none"].residual == 0.2 and left["source", "c"].reached == 0.0


def test_samples_of_given_shares_hold_no_value_without_a_target(spark):
    rows = [(i, "abc"[i % 3], ("en", "de")[i % 2], "word " * 20) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    targets = _targets(spark, source={"a": 0.8, "b": 0.2}, lang={"en": 0.5, "de": 0.5}, topic={"prose": 1.0})
    got = mixing.mix_sources(docs, targets)
    kept = {r.source: r.n for r in got.where("sampled").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert "c" not in kept and kept["a"] == 1000 and 200 < kept["b"] < 300
    assert got.count() == 3000
