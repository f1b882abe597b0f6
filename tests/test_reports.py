from __future__ import annotations

import collections
import datetime as dt
import math
import random
import re

from pyspark.sql import functions as F

from incident_analytics.operators import classify as c
from incident_analytics.operators import opslog as o

LOG = ("id bigint, ts timestamp_ntz, subtask string, model string, latency_ms double, tokens_in bigint, "
       "tokens_out bigint, status string, cache_hit int, error string, extra string")
T0 = dt.datetime(2024, 1, 1)
PRICES = {"small": (0.05, 0.08)}


def log(spark, rows):
    data = [(i, T0 + dt.timedelta(seconds=s), sub, "small", lat, ti, to, st, 0, None, extra)
            for i, (s, sub, lat, ti, to, st, extra) in enumerate(rows)]
    return o.priced_requests(spark.createDataFrame(data, LOG), PRICES)


def test_cost_and_summary_golden(spark):
    df = log(spark, [(0, "resolve", 10.0, 1_000_000, 1_000_000, "ok", None)])
    row = o.ops_summary(df).first()
    assert (row.requests, row.cost_usd, row.error_rate, row.throughput_rpm) == (1, 0.13, 0.0, 1.0)
    assert o.ops_summary_by_subtask(df).first().subtask == "resolve"


def test_empty_summary_is_one_row_of_zeros(spark):
    rows = o.ops_summary(log(spark, [(0, "a", 1.0, 1, 1, "ok", None)]).where("id < 0")).collect()
    assert len(rows) == 1 and set(rows[0].asDict().values()) == {0}


def test_errors_noted_in_extra(spark):
    df = log(spark, [(0, "a", 1.0, 1, 1, "ok", '{"error": "x"}'), (60, "a", 1.0, 1, 1, "ok", None)])
    assert o.ops_summary(df).first().error_rate == 0.0
    row = o.ops_summary(df, effective_errors=True).first()
    assert row.error_rate == 0.5 and row.throughput_rpm == 2.0


def test_feedback_golden(spark):
    extras = ['{"value": 1}', '{"value": 1}', '{"value": -1}', "not json", None, '[1]', '{"value": 0}']
    rows = [(i, "feedback", 1.0, 0, 0, "ok", x) for i, x in enumerate(extras)]
    rows.append((9, "resolve", 1.0, 0, 0, "ok", '{"value": 1}'))
    assert o.feedback_summary(log(spark, rows)).first().asDict() == {"up": 2, "down": 1, "total": 3}


def test_volume_fills_gaps_across_long_spans(spark):
    df = log(spark, [(0, "a", 1.0, 1, 1, "ok", None), (600_000, "a", 1.0, 1, 1, "ok", None)])
    got = o.request_volume(df, 60)
    assert got.count() == 10_001 and got.agg(F.sum("calls")).first()[0] == 2


def test_headline_delta_golden(spark):
    scores = spark.createDataFrame([("base", 0.098, 0.0222, 1000), ("finetuned", 0.392, 0.3516, 1000)],
                                   "variant string, accuracy double, f1_macro double, eval_rows bigint")
    got = {r.metric: r.delta for r in c.headline_delta(scores).collect()}
    assert got == {"accuracy": 0.294, "f1_macro": 0.3294}
    only = {r.metric: r.finetuned for r in c.headline_delta(scores.where("variant = 'base'")).collect()}
    assert only == {"accuracy": 0.0, "f1_macro": 0.0}


def test_training_curves_golden(spark):
    entry = "struct<epoch:double,loss:double,eval_loss:double,eval_accuracy:double,eval_f1_macro:double>"
    rows = [[(0.1, 2.3, None, None, None), (0.2, 2.2, None, None, None), (0.9, 1.5, None, None, None),
             (1.0, None, 1.6, 0.4, 0.3), (2.0, None, 1.4, 0.5, None), (2.0, None, None, None, None)]]
    got = c.training_curves(spark.createDataFrame([(r,) for r in rows], f"log_history array<{entry}>"))
    assert {r.series: r["count"] for r in got.groupBy("series").count().collect()} == {"train": 3, "eval": 2}
    assert got.where("epoch = 2.0").first().f1_macro == 0.0


def test_report_lists_labels_without_rows(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y_true string, y_pred string")
    got = {r.label: r for r in c.classification_report(pred, ["a", "b", "never"]).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].f1, got["a"].support) == (1.0, 0.5, 0.667, 2)
    assert (got["never"].precision, got["never"].f1, got["never"].support) == (0.0, 0.0, 0)
    assert c.accuracy_macro_f1(pred).first().asDict() == {"accuracy": 0.6667, "f1_macro": 0.6667, "eval_rows": 3}


def test_empty_text_gives_an_error_row_and_salting_changes_nothing(spark):
    train = spark.createDataFrame([("vpn tunnel drops", "net"), ("invoice wrong amount", "pay")], "text string, label string")
    model = c.train_queue_nb(train)
    test = spark.createDataFrame([(1, "the vpn drops"), (2, " \t"), (3, "wrong invoice"), (4, "?!")],
                                 "ticket_id bigint, text string")
    got = {r.ticket_id: r for r in c.score_queue_nb(test, model).collect()}
    assert got[1].label == "net" and got[3].label == "pay" and got[4].label == "net"
    assert got[2].label is None and got[2].error == c.EMPTY_TEXT
    salted = {r.ticket_id: r for r in c.score_queue_nb(test, model, vocabulary_rows=0).collect()}
    assert salted == got


def test_naive_bayes_over_blocks_of_classes_against_a_plain_version(spark, monkeypatch):
    """Five classes in blocks of two, a broadcast and a salted model, known, unknown and no tokens."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    train = [(" ".join(rng.choices(words, k=rng.randint(1, 9))), rng.choice("abcde")) for _ in range(60)]
    texts = [" ".join(rng.choices([*words, "new"], k=rng.randint(1, 9))) for _ in range(40)] + ["new", "!?", " ", None]
    model = c.train_queue_nb(spark.createDataFrame(train, "text string, label string"))
    counts, n_words, n_docs = collections.Counter(), collections.Counter(), collections.Counter()
    for text, label in train:
        n_docs[label] += 1
        n_words[label] += len(text.split())
        counts.update((label, w) for w in text.split())
    vocabulary = len({w for _, w in counts})

    def plain(text):
        found = re.findall(r"[a-z0-9]+", text)
        s = {k: round(math.log(n_docs[k] / 60) + sum(math.log(counts[k, w] + 1) for w in found)
                      - len(found) * math.log(n_words[k] + vocabulary), 6) for k in n_docs}
        best = min(s, key=lambda k: (-s[k], k))
        return best, round(1 / sum(math.exp(v - s[best]) for v in s.values()), 4)

    df = spark.createDataFrame(list(enumerate(texts)), "ticket_id int, text string")
    for width, rows in ((64, 1000), (2, 1000), (2, 0)):
        monkeypatch.setattr(c, "LABELS_PER_ROW", width)
        got = {r.ticket_id: r for r in c.score_queue_nb(df, model, vocabulary_rows=rows).collect()}
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            if not (text or "").strip():
                assert got[i].label is None and got[i].error == c.EMPTY_TEXT
            else:
                label, confidence = plain(text)
                assert got[i].label == label and abs(got[i].confidence - confidence) < 2e-4
