"""Registered queries over ticket curation, sampling, synthetic tickets and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import classifier_text, embed_text, queue_slug, tag_array
from ..operators import curation as c
from ..operators import sampling as m
from ..operators.generate import DATE_RANGE, FIRST_DATE, POOLS, PRIORITIES, TEMPLATES, generate_for
from ..operators.leakage import kb_eval_leakage
from ..session import scratch_path
from ..sources.stores import store_inventory
from ..sources.tickets import CSV_OPTIONS, read_kb, read_raw_tickets, write_kb, write_splits
from . import bindings as b
from .bindings import CLEAN, KB, RAW, TICKETS, UNEVEN, strip_sql

QUERIES, ORACLES = {}, {}


def register(key, fn, sql=None):
    QUERIES[key] = fn
    if sql is not None:
        ORACLES[key] = sql


_N = "CAST(count(*) AS BIGINT)"
_RAW_TEXT = ("subject", "body", "answer", "queue", "language", "type", "priority", "tag_1", "tag_2", "tag_3")


# --- sources --------------------------------------------------------------------

def _exported(s, d, **how):
    """Write the raw tickets as CSV exports with two different headers and read them back."""
    path = scratch_path(s, "exports")
    raw = b.raw_tickets(s, d)
    text = raw.select("src_ord", *[F.col(x).cast("string") for x in _RAW_TEXT])
    writer = lambda df, part: df.write.options(**CSV_OPTIONS).csv(f"{path}/{part}")
    writer(text.where("src_ord % 2 = 0").drop("src_ord"), "a")
    writer(text.where("src_ord % 2 = 1").drop("src_ord", "tag_2"), "b")
    return read_raw_tickets(s, path, **how).drop("src_ord").select(
        *[F.coalesce(F.col(x), F.lit("")).alias(x) for x in _RAW_TEXT])


_RAW_SQL = (f"WITH {RAW} SELECT " + ", ".join(
    f"coalesce(CAST({x} AS VARCHAR), '') AS {x}" for x in _RAW_TEXT) + " FROM raw")
register("read_raw_tickets", _exported, _RAW_SQL)
register("read_raw_tickets_split", lambda s, d: _exported(s, d, split_files=True), _RAW_SQL)


def _kb(s, d):
    return c.curate(b.raw_tickets(s, d), "src_ord")


def _kb_stored(s, d):
    path = scratch_path(s, "kb")
    write_kb(_kb(s, d), path)
    return path


_KB_COLUMNS = "ticket_id, title, description, resolution, category, type, priority, tags"
register("write_kb", lambda s, d: read_kb(s, _kb_stored(s, d)), f"WITH {KB} SELECT {_KB_COLUMNS} FROM kb")


def _splits_stored(s, d):
    path = scratch_path(s, "splits")
    write_splits(m.stratified_split(b.uneven_tickets(s, d)), path)
    return path


_HASH = "md5(concat_ws(':', '42', CAST(ticket_id AS VARCHAR)))"
_RANKED = (", ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {h}, ticket_id) AS rk, "
           "count(*) OVER (PARTITION BY category) AS n, count(*) OVER () AS total FROM tickets)").format(h=_HASH)
_SPLIT = (f"WITH {UNEVEN}{_RANKED}, parted AS (SELECT *, CASE WHEN rk <= greatest(1, round_even(n * 0.15, 0)) "
          "THEN 'test' ELSE 'train' END AS split FROM ranked)")
register("read_kb",
         lambda s, d: read_kb(s, _splits_stored(s, d), split="test").select("ticket_id", "category", "split"),
         _SPLIT + " SELECT ticket_id, category, split FROM parted WHERE split = 'test'")
_STORES = ("documents", "labels", "events", "conversations", "pages")
register("store_inventory",
         lambda s, d: store_inventory(s, {t: f"{d}/{t}.parquet" for t in (*_STORES, "missing")})
         .select("store", "present", "n_rows"),
         " UNION ALL ".join(f"SELECT '{t}' AS store, true AS present, {_N} AS n_rows FROM {t}" for t in _STORES)
         + " UNION ALL SELECT 'missing', false, 0")

# --- curation -------------------------------------------------------------------


def _shouted(s, d):
    raw = b.raw_tickets(s, d)
    return c.normalize_columns(raw.withColumnsRenamed({x: f" {x.upper()} " for x in raw.columns}))


register("normalize_columns", lambda s, d: _shouted(s, d).select("src_ord", "queue", "language"),
         f"WITH {RAW} SELECT src_ord, queue, language FROM raw")
register("tickets_lang_filter",
         lambda s, d: c.tickets_lang_filter(b.raw_tickets(s, d), "EN").select("src_ord", "language"),
         f"WITH {RAW} SELECT src_ord, language FROM raw WHERE lower(language) = 'en'")
_PARTS = ("subject", "body", "answer", "queue")
register("tickets_nonempty",
         lambda s, d: c.tickets_nonempty(b.raw_tickets(s, d)).select("src_ord", *_PARTS),
         f"WITH {RAW}, t AS (SELECT src_ord, " + ", ".join(
             f"{strip_sql(f'coalesce({x}, chr(32))')} AS {x}" for x in _PARTS) + " FROM raw) SELECT * FROM t WHERE "
         + " AND ".join(f"lower({x}) NOT IN ('', 'nan')" for x in _PARTS))
register("ticket_tags",
         lambda s, d: c.ticket_tags(b.raw_tickets(s, d)).select(
             "src_ord", "tags", F.size(tag_array(b.raw_tickets(s, d).columns)).alias("n_tags")),
         f"WITH {RAW} SELECT src_ord, {b.TAGS_SQL} AS tags, CASE WHEN {b.TAGS_SQL} = '' THEN 0 ELSE "
         f"len(string_split({b.TAGS_SQL}, '|')) END AS n_tags FROM raw")
register("kb_projection", _kb, f"WITH {KB} SELECT {_KB_COLUMNS} FROM kb")
register("queue_slug",
         lambda s, d: b.raw_tickets(s, d).select(
             "src_ord", queue_slug(F.concat(F.lit(" Sales and Pre-"), "queue", F.lit("\t"))).alias("slug")),
         f"WITH {RAW} SELECT src_ord, 'sales_and_pre-' || lower(queue) AS slug FROM raw")
register("embed_text",
         lambda s, d: b.raw_tickets(s, d).select(
             "src_ord", embed_text(F.col("subject"), F.col("body")).alias("embed_text")),
         f"WITH {RAW} SELECT src_ord, coalesce(subject, '') || '. ' || coalesce(body, '') "
         "AS embed_text FROM raw")
register("classifier_text",
         lambda s, d: b.raw_tickets(s, d).select(
             "src_ord", classifier_text(F.when(F.col("src_ord") % 5 > 0, F.col("answer")), F.col("body"))
             .alias("classifier_text")),
         f"""WITH {RAW}, t AS (SELECT src_ord,
         {strip_sql("coalesce(CASE WHEN src_ord % 5 > 0 THEN answer END, '')")} AS a, {strip_sql('body')} AS b FROM raw)
         SELECT src_ord, concat_ws('. ', nullif(a, ''), nullif(b, '')) AS classifier_text FROM t""")
_KNOWN = [f"src{i}" for i in range(7)]
_KNOWN_SQL = ", ".join(f"'{x}'" for x in _KNOWN)
register("known_labels_filter",
         lambda s, d: m.known_labels_filter(b.tickets(s, d), _KNOWN).select("ticket_id", "category"),
         f"WITH {TICKETS} SELECT ticket_id, category FROM tickets WHERE category IN ({_KNOWN_SQL})")
register("unknown_label_count", lambda s, d: m.unknown_label_count(b.tickets(s, d), _KNOWN),
         f"""WITH {TICKETS} SELECT {_N} AS n_rows,
         CAST(count(*) FILTER (WHERE category IN ({_KNOWN_SQL})) AS BIGINT) AS kept,
         CAST(count(*) FILTER (WHERE category NOT IN ({_KNOWN_SQL})) AS BIGINT) AS dropped FROM tickets""")
register("dedup_by_body",
         lambda s, d: c.dedup_by_body(c.tickets_nonempty(c.tickets_lang_filter(b.raw_tickets(s, d))), "src_ord")
         .select("src_ord", "body"),
         f"WITH {CLEAN} SELECT src_ord, body FROM firsts")
register("queue_distribution", lambda s, d: c.queue_distribution(_kb(s, d)),
         f"WITH {KB} SELECT category, {_N} AS n_rows FROM kb GROUP BY category")
register("top_queues", lambda s, d: c.top_queues(b.raw_tickets(s, d)).select("src_ord", "queue"),
         f"""WITH {RAW} SELECT src_ord, queue FROM raw WHERE queue IN (
         SELECT queue FROM raw GROUP BY queue ORDER BY count(*) DESC, queue LIMIT 10)""")


def _union(s, d):
    raw = b.raw_tickets(s, d).select("src_ord", "queue", "tag_1", "tag_2")
    return c.union_raw([raw.drop("tag_2"), raw.drop("tag_1"), raw])


register("union_raw", _union,
         f"""WITH {RAW} SELECT src_ord, queue, tag_1, NULL AS tag_2 FROM raw
         UNION ALL SELECT src_ord, queue, NULL, tag_2 FROM raw
         UNION ALL SELECT src_ord, queue, tag_1, tag_2 FROM raw""")

# --- samples and splits -----------------------------------------------------------

_U = f"WITH {UNEVEN}{_RANKED}"
_KEEP = ["ticket_id", "category"]
register("stratified_rank",
         lambda s, d: m.stratified_rank(b.uneven_tickets(s, d)).select(*_KEEP, "rank"),
         f"{_U} SELECT ticket_id, category, rk AS rank FROM ranked")
register("kb_sample", lambda s, d: m.kb_sample(b.uneven_tickets(s, d), 100).select(*_KEEP),
         f"""{_U} SELECT ticket_id, category FROM ranked WHERE rk <= CASE WHEN total <= 100 THEN n
         ELSE round_even(n * (CAST(100 AS DOUBLE) / total), 0) END""")
register("stratified_cap", lambda s, d: m.stratified_cap(b.uneven_tickets(s, d), 60).select(*_KEEP),
         f"""{_U} SELECT ticket_id, category FROM ranked WHERE rk <= CASE WHEN total <= 60 THEN n
         ELSE greatest(1, round_even(n * (CAST(60 AS DOUBLE) / total), 0)) END""")
register("stratified_split",
         lambda s, d: m.stratified_split(b.uneven_tickets(s, d)).select(*_KEEP, "split"),
         _SPLIT + " SELECT ticket_id, category, split FROM parted")


def _leakage(s, d):
    split = m.stratified_split(b.uneven_tickets(s, d))
    return kb_eval_leakage(split, split.where("split = 'test'"))


register("kb_eval_leakage", _leakage,
         _SPLIT + """, t AS (SELECT DISTINCT description FROM parted WHERE split = 'test' AND description IS NOT NULL),
         j AS (SELECT p.category, p.split = 'test' AS i, t.description IS NOT NULL AS x
               FROM parted p LEFT JOIN t ON t.description = p.description)
         SELECT category, CAST(count(*) AS BIGINT) AS kb_tickets, CAST(count(*) FILTER (i) AS BIGINT) AS same_id,
           CAST(count(*) FILTER (x) AS BIGINT) AS same_text, CAST(count(*) FILTER (i OR x) AS BIGINT) AS leaked
         FROM j GROUP BY category""")
_MEDIAN = "(SELECT floor(median(n)) FROM (SELECT count(*) AS n FROM {0} GROUP BY category))"
register("balance_to_median", lambda s, d: m.balance_to_median(b.uneven_tickets(s, d)).select(*_KEEP),
         f"{_U} SELECT ticket_id, category FROM ranked WHERE rk <= {_MEDIAN.format('tickets')}")
register("label_index", lambda s, d: m.label_index(b.tickets(s, d)),
         f"""WITH {TICKETS} SELECT category AS label, CAST(row_number() OVER (ORDER BY category) - 1 AS BIGINT)
         AS label_id FROM (SELECT DISTINCT category FROM tickets)""")
register("resolve_labels",
         lambda s, d: m.resolve_labels(s, b.tickets(s, d).select("category").where(F.lit(False)), b.tickets(s, d)),
         ORACLES["label_index"])
_LANGS = ["de", "en", "fr", "fr-x"]
_TRAIN = f"""WITH {UNEVEN}, known AS (SELECT * FROM tickets WHERE category IN ('de', 'en', 'fr', 'fr-x')),
  sized AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_HASH}, ticket_id) AS rk,
    count(*) OVER (PARTITION BY category) AS n FROM known),
  balanced AS (SELECT * FROM sized WHERE rk <= {_MEDIAN.format('known')}),
  again AS (SELECT *, count(*) OVER (PARTITION BY category) AS bn, count(*) OVER () AS total FROM balanced),
  capped AS (SELECT * FROM again WHERE rk <= CASE WHEN total <= 200 THEN bn
    ELSE greatest(1, round_even(bn * (CAST(200 AS DOUBLE) / total), 0)) END)
SELECT ticket_id, concat_ws('. ', nullif({strip_sql('title')}, ''), nullif({strip_sql('description')}, '')) AS text, category, CAST(CASE category WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'fr' THEN 2
  ELSE 3 END AS BIGINT) AS label_id FROM capped"""
register("training_set",
         lambda s, d: m.training_set(b.uneven_tickets(s, d), _LANGS, max_rows=200, balanced=True), _TRAIN)


def _complement(s, d):
    rows = m.stratified_split(b.uneven_tickets(s, d))
    return m.train_complement(b.uneven_tickets(s, d), rows.where("split = 'test'")).select(*_KEEP)


register("train_complement", _complement,
         _SPLIT + " SELECT ticket_id, category FROM parted WHERE split = 'train'")


def _checks(s, d):
    rows = m.stratified_split(b.uneven_tickets(s, d))
    return m.split_checks(rows, rows.where("split = 'train'"), rows.where("split = 'test'"))


register("split_checks", _checks,
         _SPLIT + """, tr AS (SELECT ticket_id FROM parted WHERE split = 'train'),
         te AS (SELECT ticket_id FROM parted WHERE split = 'test'),
         both_parts AS (SELECT * FROM tr UNION ALL SELECT * FROM te)
         SELECT (SELECT count(*) FROM (SELECT * FROM tr INTERSECT SELECT * FROM te)) AS overlap,
         (SELECT count(*) FROM (SELECT ticket_id FROM tickets EXCEPT ALL SELECT * FROM both_parts)) AS lost,
         (SELECT count(*) FROM (SELECT * FROM both_parts EXCEPT ALL SELECT ticket_id FROM tickets)) AS invented""")

# --- synthetic tickets --------------------------------------------------------------


def _draw_sql(slot, size):
    return f"CAST(('0x' || substr(md5(concat_ws(':', '42', CAST(i AS VARCHAR), '{slot}')), 1, 8)) AS BIGINT) % {size}"


def _list_sql(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _field_sql(part):
    cats = sorted(TEMPLATES)
    whens = " ".join(
        f"WHEN {j} THEN {_list_sql([t[part] for t in TEMPLATES[x]])}[1 + {_draw_sql('template', len(TEMPLATES[x]))}]"
        for j, x in enumerate(cats))
    text = f"CASE (i - 1) % {len(cats)} {whens} END"
    for key, values in POOLS.items():
        text = f"replace({text}, '{{{key}}}', {_list_sql(values)}[1 + {_draw_sql(key, len(values))}])"
    return text


register("generate_tickets",
         lambda s, d: generate_for(
             b.table(s, d, "documents").select((F.col("doc_id") + 1).alias("number")), "number")
         .withColumn("resolved_date", F.col("resolved_date").cast("string")),
         f"""WITH g AS (SELECT doc_id + 1 AS i FROM documents)
         SELECT printf('GEN-%05d', i) AS ticket_id, {_field_sql(0)} AS title, {_field_sql(1)} AS description,
         {_field_sql(2)} AS resolution, {_list_sql(sorted(TEMPLATES))}[1 + (i - 1) % {len(TEMPLATES)}] AS category,
         'Incident' AS type, {_list_sql(PRIORITIES)}[1 + {_draw_sql('priority', len(PRIORITIES))}] AS priority,
         '' AS tags, CAST(DATE '{FIRST_DATE}' + CAST({_draw_sql('date', DATE_RANGE)} AS INT) AS VARCHAR)
         AS resolved_date FROM g""")
