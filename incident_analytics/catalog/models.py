"""Registered queries over classifiers, reports, digests and the incident journey."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as c
from ..operators.metered import apply_metered
from ..operators.retrieval import embed_corpus, fit_text_encoder
from ..operators.sampling import stratified_split
from ..operators.summarize import extractive_summaries
from ..plans.compare import compare_variants, comparison_json
from ..plans.journey import JourneyModels, incident_journey
from ..session import materialize, scratch_path
from ..sources.stores import read_report_samples, read_reports
from . import bindings as b
from .bindings import LONG_PRED, PRED, PRED_LABELS

QUERIES, ORACLES = {}, {}


def register(key, fn, sql=None):
    QUERIES[key] = fn
    if sql is not None:
        ORACLES[key] = sql


_N = "CAST(count(*) AS BIGINT)"
_LABEL_LIST = ", ".join(f"('{x}')" for x in PRED_LABELS)


def _stacked(s, d):
    return c.stack_variants(b.predictions(s, d), {"base": "y_base", "finetuned": "y_tuned"})


# tp, support and predictions per variant and label, from which all reports follow.
_COUNTS = LONG_PRED + """, lab AS (SELECT variant, y_true AS label, 0 AS predicted, 1 AS support,
    CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS tp FROM pred
    UNION ALL SELECT variant, y_pred, 1, 0, 0 FROM pred),
  counts AS (SELECT variant, label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted
    FROM lab GROUP BY 1, 2)"""
_F1 = "CASE WHEN coalesce(support + predicted, 0) > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END"
_REPORT = f"""grid AS (SELECT v.variant, l.label FROM (SELECT DISTINCT variant FROM pred) v
    JOIN (VALUES {_LABEL_LIST}) l(label) ON true),
  report AS (SELECT g.variant, g.label,
    round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END, 3) AS "precision",
    round(CASE WHEN support > 0 THEN tp / support ELSE 0.0 END, 3) AS recall,
    round({_F1}, 3) AS f1, CAST(coalesce(support, 0) AS BIGINT) AS support
    FROM grid g LEFT JOIN counts c ON c.variant = g.variant AND c.label = g.label)"""
_SCORES = f"""scores AS (SELECT variant, round(sum(tp) / sum(support), 4) AS accuracy,
    round(avg({_F1}), 4) AS f1_macro, CAST(sum(support) AS BIGINT) AS eval_rows FROM counts GROUP BY variant)"""

register("classification_report",
         lambda s, d: c.classification_report(_stacked(s, d), PRED_LABELS, ["variant"]),
         f"WITH {_COUNTS}, {_REPORT} SELECT * FROM report")
register("accuracy_macro_f1", lambda s, d: c.accuracy_macro_f1(_stacked(s, d), ["variant"]),
         f"WITH {_COUNTS}, {_SCORES} SELECT * FROM scores")
register("headline_delta",
         lambda s, d: c.headline_delta(c.accuracy_macro_f1(_stacked(s, d), ["variant"])),
         f"""WITH {_COUNTS}, {_SCORES}, long AS (SELECT variant, 'accuracy' AS metric, accuracy AS v FROM scores
         UNION ALL SELECT variant, 'f1_macro', f1_macro FROM scores)
         SELECT metric, max(v) FILTER (WHERE variant = 'base') AS base,
         max(v) FILTER (WHERE variant = 'finetuned') AS finetuned,
         round(max(v) FILTER (WHERE variant = 'finetuned') - max(v) FILTER (WHERE variant = 'base'), 4) AS delta
         FROM long GROUP BY metric""")
register("compare_variants", lambda s, d: compare_variants(_stacked(s, d), PRED_LABELS),
         f"WITH {_COUNTS}, {_REPORT}, {_SCORES} SELECT r.*, accuracy, f1_macro, eval_rows FROM report r "
         "JOIN scores s ON s.variant = r.variant")


_SOURCES = {"base": "models/base", "finetuned": "models/tuned"}


def _samples(s, d):
    p = b.predictions(s, d)
    side = lambda y: p.select("ticket_id", F.col(y).alias("y_pred"))
    return c.variant_samples(p.select("ticket_id", "text", "y_true"), side("y_base"), side("y_tuned"), 20)


def _report_path(s, d):
    path = scratch_path(s, "report")
    comparison_json(_stacked(s, d), PRED_LABELS, _samples(s, d), _SOURCES).write.text(path)
    return path


def _reports(s, d):
    return read_reports(s, _report_path(s, d))


register("read_reports",
         lambda s, d: _reports(s, d).select("variant", "model_source", "eval_rows", "accuracy", "f1_macro",
                                            F.size("per_class").alias("n_labels")),
         f"WITH {_COUNTS}, {_SCORES} SELECT variant, CASE variant WHEN 'base' THEN 'models/base' ELSE 'models/tuned' END "
         f"AS model_source, eval_rows, accuracy, f1_macro, {len(PRED_LABELS)} AS n_labels FROM scores")
register("per_class_table", lambda s, d: c.per_class_table(_reports(s, d), "finetuned"),
         f"WITH {_COUNTS}, {_REPORT} SELECT * EXCLUDE (variant) FROM report WHERE variant = 'finetuned'")


_MARK = "CASE WHEN {0} = y_true THEN 'right' ELSE 'wrong' END"
_SAMPLES = f"""WITH {PRED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY
       md5('43:' || CAST(ticket_id AS VARCHAR)), ticket_id) AS rk, count(*) OVER (PARTITION BY y_true) AS n,
       count(*) OVER () AS total FROM wide),
     shown AS (SELECT ticket_id, substr(text, 1, 140) AS text, y_true, y_base AS base_pred,
       {_MARK.format('y_base')} AS base_mark, y_tuned AS finetuned_pred,
       {_MARK.format('y_tuned')} AS finetuned_mark FROM ranked
     WHERE rk <= greatest(1, round_even(n * (CAST(20 AS DOUBLE) / total), 0)))"""
register("variant_samples", _samples, f"{_SAMPLES} SELECT * FROM shown")
register("report_samples", lambda s, d: read_report_samples(s, _report_path(s, d)),
         f"{_SAMPLES} SELECT CAST(row_number() OVER (ORDER BY ticket_id) - 1 AS INT) AS position, "
         "* EXCLUDE (ticket_id) FROM shown")


def _training_log(s, d):
    """Every event becomes one short log: a point of one of the series and a closing entry."""
    e = b.table(s, d, "events")
    kind = F.pmod("event_id", F.lit(3))
    num = lambda flag, col: F.when(flag, col)
    entry = lambda t, ev: F.struct(
        F.when(kind < 2, F.col("user_id") / 10).alias("epoch"), num(t, F.col("value")).alias("loss"),
        num(ev, F.col("value")).alias("eval_loss"), num(ev & (F.col("user_id") % 2 == 0), F.lit(0.5))
        .alias("eval_accuracy"), num(ev, F.lit(0.25)).alias("eval_f1_macro"))
    no = F.lit(False)
    return e.select("event_id", F.array(entry(kind == 0, kind == 1), entry(no, no)).alias("log_history"))


register("training_curves", lambda s, d: c.training_curves(_training_log(s, d)),
         """SELECT 'train' AS series, user_id / 10 AS epoch, value AS loss, CAST(NULL AS DOUBLE) AS accuracy,
         CAST(NULL AS DOUBLE) AS f1_macro, CAST(NULL AS DOUBLE) AS eval_loss FROM events WHERE event_id % 3 = 0
         UNION ALL SELECT 'eval', user_id / 10, NULL, CASE WHEN user_id % 2 = 0 THEN 0.5 ELSE 0.0 END, 0.25, value
         FROM events WHERE event_id % 3 = 1""")

# --- classifiers --------------------------------------------------------------------


def _parts(s, d):
    rows = b.predictions(s, d).select("ticket_id", "text", F.col("y_true").alias("label"))
    split = materialize(stratified_split(rows, category="label"), "queue-split")
    return split.where("split = 'train'"), split.where("split = 'test'")


def _nb(s, d):
    train, test = _parts(s, d)
    model = c.train_queue_nb(train)
    return model, test


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_NB = f"""{PRED}, ranked AS (SELECT ticket_id, text, y_true AS label, row_number() OVER (PARTITION BY y_true
    ORDER BY md5('42:' || CAST(ticket_id AS VARCHAR)), ticket_id) AS rk, count(*) OVER (PARTITION BY y_true) AS n
    FROM wide),
  parted AS (SELECT ticket_id, text, label, {_TOKENS} AS toks,
    rk <= greatest(1, round_even(n * 0.15, 0)) AS is_test FROM ranked),
  tc AS (SELECT label, token, count(*) AS n FROM (SELECT label, unnest(toks) AS token FROM parted
    WHERE NOT is_test) GROUP BY 1, 2),
  st AS (SELECT label, count(*) AS docs, sum(len(toks)) AS n_tokens FROM parted WHERE NOT is_test GROUP BY 1),
  v AS (SELECT count(DISTINCT token) AS vocabulary, (SELECT sum(docs) FROM st) AS docs FROM tc),
  tf AS (SELECT ticket_id, token, count(*) AS tf FROM (SELECT ticket_id, unnest(toks) AS token FROM parted
    WHERE is_test AND text <> '') GROUP BY 1, 2),
  ev AS (SELECT ticket_id, label, sum(tf * ln(n + 1.0)) AS s FROM tf JOIN tc ON tc.token = tf.token GROUP BY 1, 2),
  sc AS (SELECT p.ticket_id, st.label, round(ln(st.docs / v.docs) - len(p.toks) * ln(st.n_tokens + v.vocabulary)
    + coalesce(ev.s, 0), 6) AS s FROM parted p JOIN st ON true JOIN v ON true
    LEFT JOIN ev ON ev.ticket_id = p.ticket_id AND ev.label = st.label
    WHERE p.is_test AND {b.strip_sql('p.text')} <> ''),
  best AS (SELECT *, max(s) OVER (PARTITION BY ticket_id) AS top, row_number() OVER (PARTITION BY ticket_id
    ORDER BY s DESC, label) AS rk FROM sc),
  decided AS (SELECT ticket_id, max(label) FILTER (WHERE rk = 1) AS label,
    round(1 / sum(exp(s - top)), 4) AS confidence FROM best GROUP BY ticket_id)"""


def _scored_nb(s, d):
    model, test = _nb(s, d)
    return c.score_queue_nb(test, model)


register("queue_nb", _scored_nb,
         f"""WITH {_NB} SELECT p.ticket_id, d.label, d.confidence, 'tuned' AS variant,
         CASE WHEN d.label IS NULL THEN '{c.EMPTY_TEXT}' END AS error
         FROM parted p LEFT JOIN decided d USING (ticket_id) WHERE p.is_test""")


def _prior(s, d):
    model, test = _nb(s, d)
    return c.score_class_prior(test, model)


register("queue_prior", _prior,
         f"""WITH {_NB}, top AS (SELECT label, round(docs / (SELECT sum(docs) FROM st), 4) AS confidence FROM st
         ORDER BY docs DESC, label LIMIT 1)
         SELECT p.ticket_id, t.label, t.confidence, 'base' AS variant, CAST(NULL AS VARCHAR) AS error
         FROM parted p JOIN top t ON true WHERE p.is_test""")


def _evaluated(s, d):
    model, test = _nb(s, d)
    scored = c.score_queue_nb(test, model).unionByName(c.score_class_prior(test, model))
    pred = scored.where("label IS NOT NULL").join(
        test.select("ticket_id", F.col("label").alias("y_true")), "ticket_id")
    return c.accuracy_macro_f1(pred.withColumnRenamed("label", "y_pred"), ["variant"])


register("queue_nb_evaluation", _evaluated,
         f"""WITH {_NB}, top AS (SELECT label FROM st ORDER BY docs DESC, label LIMIT 1),
         pred AS (SELECT 'tuned' AS variant, p.label AS y_true, d.label AS y_pred FROM parted p JOIN decided d
           USING (ticket_id) UNION ALL SELECT 'base', p.label, t.label FROM parted p JOIN top t ON true
           WHERE p.is_test),
         lab AS (SELECT variant, y_true AS label, 0 AS predicted, 1 AS support,
           CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS tp FROM pred
           UNION ALL SELECT variant, y_pred, 1, 0, 0 FROM pred),
         counts AS (SELECT variant, label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted
           FROM lab GROUP BY 1, 2), {_SCORES} SELECT * FROM scores""")


def _logistic(s, d):
    train, test = _parts(s, d)
    return c.score_queues(test, c.train_queue_classifier(train))


def _logistic_facts(s, d):
    """What every classifier must answer, whatever it has learned."""
    train, _ = _parts(s, d)
    known = train.select(F.col("label").alias("learned")).distinct()
    return (_logistic(s, d).join(known, F.col("label") == F.col("learned"), "left")
            .select("ticket_id", "variant", "error", F.col("learned").isNotNull().alias("answered"),
                    (F.col("label").isNull() == F.col("confidence").isNull()).alias("consistent"),
                    F.coalesce(F.col("confidence").between(0, 1), F.lit(True)).alias("bounded")))


register("score_queues", _logistic)
register("score_queues_facts", _logistic_facts,
         f"""WITH {PRED}, ranked AS (SELECT ticket_id, {b.strip_sql('text')} AS t, row_number() OVER (PARTITION BY y_true
           ORDER BY md5('42:' || CAST(ticket_id AS VARCHAR)), ticket_id) AS rk, count(*) OVER (PARTITION BY y_true) AS n
           FROM wide)
         SELECT ticket_id, 'finetuned' AS variant, CASE WHEN t = '' THEN '{c.EMPTY_TEXT}' END AS error,
           t <> '' AS answered, true AS consistent, true AS bounded FROM ranked
         WHERE rk <= greatest(1, round_even(n * 0.15, 0))""")

# --- digests and metered calls --------------------------------------------------------

_SENTENCES = r"regexp_extract_all(text, '[^.!?\n]+[.!?]*')"
register("extractive_summaries",
         lambda s, d: extractive_summaries(b.documents(s, d), "doc_id"),
         f"""WITH base AS (SELECT doc_id, {b.strip_sql('text')} AS text FROM documents),
         long_texts AS (SELECT * FROM base WHERE length(text) >= 40),
         nd AS (SELECT count(*) AS n FROM long_texts),
         df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS})) AS token FROM long_texts)
           GROUP BY token),
         idf AS (SELECT token, ln((n + 1) / (df + 1)) AS idf FROM df JOIN nd ON true),
         cut AS (SELECT doc_id, generate_subscripts({_SENTENCES}, 1) - 1 AS pos, unnest({_SENTENCES}) AS raw
           FROM long_texts),
         sen AS (SELECT doc_id, pos, {b._TITLE.replace('{c}', 'raw')} AS text FROM cut),
         tok AS (SELECT doc_id, pos, unnest(list_distinct({_TOKENS})) AS token FROM sen),
         sc AS (SELECT doc_id, pos, round(sum(idf) / sqrt(count(*)), 6) AS score FROM tok
           JOIN idf ON idf.token = tok.token GROUP BY 1, 2),
         best AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
           ORDER BY score DESC, pos) AS rk FROM sc) WHERE rk <= 3),
         dig AS (SELECT b.doc_id, string_agg(s.text, ' ' ORDER BY b.pos) AS digest FROM best b
           JOIN sen s ON s.doc_id = b.doc_id AND s.pos = b.pos GROUP BY b.doc_id)
         SELECT base.doc_id, coalesce(digest, text) AS summary FROM base LEFT JOIN dig USING (doc_id)""")


def _first_word(text: str) -> str:
    if len(text) < 40:
        raise ValueError("text too short")
    return text[:40]


_METERED = ["id", "output", "status", "error", "tokens_in", "tokens_out", "tokens_estimated", "cache_hit"]
register("metered_apply",
         lambda s, d: apply_metered(
             b.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"),
             _first_word, "digest", "local", ["text"]).select(*_METERED),
         """WITH t AS (SELECT doc_id AS id, text, min(doc_id) OVER (PARTITION BY text) AS first_id,
           length(text) < 40 AS failed FROM documents)
         SELECT id, CASE WHEN NOT failed THEN substr(text, 1, 40) END AS output,
           CASE WHEN failed THEN 'error' ELSE 'ok' END AS status,
           CASE WHEN failed THEN 'ValueError: text too short' END AS error,
           CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, round_even(length(text) / 4.0, 0)) END AS BIGINT)
             AS tokens_in, CAST(CASE WHEN failed THEN 0 ELSE 10 END AS BIGINT) AS tokens_out,
           true AS tokens_estimated, NOT failed AND id <> first_id AS cache_hit FROM t""")

# --- the journey ------------------------------------------------------------------------


def _told_incidents(s, d):
    """All user messages of a conversation, in order, are an incident."""
    users = b.table(s, d, "conversations").where("role = 'user'")
    told = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    return (users.groupBy(F.col("conv_id").alias("query_id")).agg(told.alias("m"))
            .select("query_id", F.array_join(F.col("m.text"), "\n").alias("incident"), F.lit("stepwise").alias("style")))


def _journey(s, d):
    docs = b.documents(s, d)
    labelled = docs.select("text", F.col("lang").alias("label"))
    encoder = fit_text_encoder(docs.withColumnRenamed("text", "incident"), "incident")
    kb = embed_corpus(b.kb_metadata(s, d).withColumn("incident", F.col("description")), "incident", model=encoder)
    pages = b.table(s, d, "benchmark").select(
        F.concat_ws("", F.when(F.col("item_id") == 0, "en").when(F.col("item_id") == 1, "de")
                    .otherwise(F.concat(F.lit("page_"), "item_id"))).alias("slug"),
        F.col("text").alias("sop_text"))
    models = JourneyModels(c.train_queue_classifier(labelled, num_features=1 << 12, max_iter=10), encoder)
    return incident_journey(_told_incidents(s, d), kb.drop("incident"), pages, models)


def _journey_facts(s, d):
    """What holds for every incident, whatever the models have learned."""
    known = b.documents(s, d).select(F.col("lang").alias("known")).distinct()
    return (_journey(s, d).join(known, F.col("category") == F.col("known"), "left")
            .select("query_id", "error", F.col("known").isNotNull().alias("routed"),
                    F.regexp_extract("prompt", "(?s)^NEW INCIDENT:\n(.*?)\n\nRouted to queue: ", 1).alias("told"),
                    (F.size(F.filter(F.split("grounded_on", ","), lambda x: x != "")) <= 3).alias("few_hits"),
                    ((F.col("resolution") != "") & (F.col("summary") != "")).alias("answered")))


register("incident_journey", _journey)
register("incident_journey_facts", _journey_facts,
         f"""WITH t AS (SELECT conv_id AS query_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text) AS body
           FROM conversations WHERE role = 'user' GROUP BY 1)
         SELECT query_id, CAST(NULL AS VARCHAR) AS error, true AS routed, {b.strip_sql('body')} AS told, true AS few_hits,
           true AS answered FROM t""")
