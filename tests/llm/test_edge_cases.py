"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from incident_analytics.llm import (language_mix, license_scan, minmax_dedup, mixing, nn_descent, packing,
                                    quality_lines, token_planes, toxicity, warc_bundle)
from incident_analytics.llm.queries import byte_bpe

LONG = " ".join(f"word{i % 977}, next" for i in range(30_000)) + "."
GOOD = "\n".join(f"Line {i} says a{i} and b{i}, then c{i} with d{i} to e{i} for f{i}." for i in range(12))
ROWS = [(1, GOOD, "en", "a", 1), (2, GOOD, "en", "a", 1), (2, GOOD, "en", "a", 1), (3, None, None, None, None),
        (4, "", "en", "a", 0), (None, GOOD, "de", None, 5), (5, LONG, None, "b", 7), (6, " \n\t ", "fr", "b", 3),
        (7, "12345 !!", "de", "b", 3), (8, "one two", "en", "b", 3), (9, GOOD + "\nOne more line, at the end.", "en", "b", 1)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("score", "kept", "length", "component_id", "topic", "__first", "digest", "license", "rank")


@pytest.fixture(params=[False, True], ids=["plain", "clashing"])
def docs(spark, request):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if request.param else df


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    found = {}
    for row in df.collect():
        found.setdefault(row[0], []).append(row)
    return found


def test_quality(docs, none):
    got = by_id(quality_lines.line_quality(docs))
    assert [len(got[i]) for i in (1, 2, None)] == [1, 2, 1] and got[None][0].kept
    assert (got[3][0].n_words, got[3][0].base_failed, got[3][0].clean_text) == (0, True, "")
    assert got[6][0].n_dup_lines == 0 and not got[4][0].kept
    assert quality_lines.line_quality(none).count() == 0


def test_languages(docs, none):
    model = language_mix.learn(docs)
    assert model.languages == ("de", "en", "fr")
    got = by_id(language_mix.identify(docs, model))
    assert [got[i][0].lang_pred for i in (3, 4, 6, 7)] == ["und"] * 4 and got[3][0].score == 0
    assert all(0 <= r.score <= 1 for rows in got.values() for r in rows)
    blank = language_mix.learn(none)
    assert {r.lang_pred for r in language_mix.identify(docs, blank).collect()} == {"und"}
    assert language_mix.identify(none, model).count() == 0


def test_near_duplicates(docs, none):
    got = by_id(minmax_dedup.near_duplicates(docs))
    assert {i: got[i][0].component_id for i in (1, 2, 9, 3, 4)} == {1: 1, 2: 1, 9: 1, 3: 3, 4: 4}
    assert got[None][0].component_id is None and got[None][0].kept and len(got[2]) == 2
    assert got[3][0].n_shingles == 0 and got[8][0].n_shingles == 1
    assert minmax_dedup.near_duplicates(none).count() == 0
    kept = minmax_dedup.one_per_group(docs, minmax_dedup.near_duplicates(docs))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8] and kept.columns == docs.columns


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ROWS) and max(r.probability for r in rows) == 1
    assert {(r.source, r.tokens) for r in rows if r.doc_id == 3} == {("", 1)}
    assert mixing.mix_sources(none).count() == 0


def test_packing(docs, none):
    got = by_id(packing.best_fit_packing(docs, byte_bpe()))
    assert [len(got[i]) for i in (3, 4, 2)] == [1, 1, 2] and got[3][0].length == 1
    assert len(got[5]) > 50 and sorted(r.piece for r in got[5]) == list(range(len(got[5])))
    assert packing.best_fit_packing(none, byte_bpe()).count() == 0


def test_token_files(docs, none):
    got = by_id(token_planes.read_token_files(token_planes.write_token_files(docs, byte_bpe())))
    assert got[None][0].start == 0 and got[3][0].n_tokens == 1 and len(got[2]) == 2
    assert token_planes.read_token_files(token_planes.write_token_files(none, byte_bpe())).count() == 0


def test_licenses(spark, docs, none):
    got = by_id(license_scan.scan_licenses(docs))
    assert {r.n_matches for rows in got.values() for r in rows} == {0} and len(got[2]) == 2
    some = spark.createDataFrame([(1, "Text.\nReleased under the MIT License."), (1, "All rights reserved."),
                                  (2, "ALL RIGHTS, RESERVED"), (None, "All rights reserved.")], "doc_id bigint, text string")
    found = sorted((r.doc_id or 0, r.license, r.licenses) for r in license_scan.scan_licenses(some).collect())
    assert found == [(0, None, "")] + [(1, "MIT", "MIT,Proprietary")] * 2 + [(2, "Proprietary", "Proprietary")]
    assert license_scan.scan_licenses(none).count() == 0
    assert license_scan.scan_licenses(docs, ()).where("n_matches > 0").count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (1, None), (2, 1), (2, 1), (99, 1), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    blank = toxicity.learn(none, labels)
    assert {r.predicted for r in toxicity.score(docs, blank).collect()} == {0}
    assert toxicity.score(none, model).count() == 0


def test_archives(spark):
    body = "<p>" + "same " * 40
    rows = [(5, "http://a", body), (3, None, body), (3, None, body), (None, "http://b", body), (7, "u", None),
            (8, "u", "short"), (9, "u", "short"), (10, " \n ", "é" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    records = warc_bundle.read_records(warc_bundle.write_bundles(pages))
    got = by_id(warc_bundle.resolve_revisits(records).select(
        "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"))
    assert got[5][0][1:4] == ("revisit", 3, len(body)) and [r.record_type for r in got[3]] == ["response"] * 2
    assert got[None][0].record_type == "response" and got[9][0].record_type == "response"
    assert got[7][0].payload_bytes == 0 and got[10][0].payload_bytes == 140_000
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc_bundle.read_records(warc_bundle.write_bundles(none)).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    got = nn_descent.nearest_neighbours(df, F.col("id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 11), (3, 2), (4, 10)] and got[0].score == 1.0
    assert nn_descent.nearest_neighbours(df.where("vec_id = 0"), F.col("id") == 0).count() == 0
    assert nn_descent.nearest_neighbours(df.limit(0), F.col("id") == 0).count() == 0


def test_stages(spark, docs, none):
    got = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, "")
        assert got.columns == docs.columns
    assert got.count() >= 1
    assert corpus_pipeline.STAGES[-1][1](spark, got, "").count() >= 1
    empty = none
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
