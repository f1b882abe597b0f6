"""Registered queries over vectors, hits, prompts and procedures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.logs import DEFAULT_STYLE, PROMPT_STYLES, retrieval_request_key, with_prompt_style
from ..operators import grounding as g
from ..operators.approx import similar_topk_approx
from ..operators import retrieval as r
from ..session import scratch_path
from ..sources.stores import read_sops
from . import bindings as b
from .bindings import FULL_HITS, HITS, INCIDENTS, SOPS

QUERIES, ORACLES = {}, {}


def register(key, fn, sql=None):
    QUERIES[key] = fn
    if sql is not None:
        ORACLES[key] = sql


_N = "CAST(count(*) AS BIGINT)"


def _vectors(s, d):
    return b.table(s, d, "embeddings")


def _scaled(s, d):
    """Vectors of different lengths, some of them zero."""
    e = _vectors(s, d)
    factor = F.pmod("vec_id", F.lit(4)).cast("float")
    return e.withColumn("embedding", F.transform("embedding", lambda x: (x * factor).cast("float")))


def _hits(s, d, k=3, threshold=0.35):
    e = _vectors(s, d)
    return r.similar_topk(e.withColumnRenamed("vec_id", "query_id"), e, k, threshold, exclude_self=True)


def _full_hits(s, d):
    return r.hits_with_metadata(_hits(s, d), b.kb_metadata(s, d))


register("build_vector_table",
         lambda s, d: r.build_vector_table(_scaled(s, d)).select("vec_id", F.posexplode("embedding"))
         .select("vec_id", "pos", F.round(F.col("col").cast("double"), 5).alias("x")),
         """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * CAST(vec_id % 4 AS FLOAT) AS FLOAT))
         AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e,
         lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM v)
         SELECT vec_id, unnest(range(len(e))) AS pos, unnest(list_transform(e, lambda x: round(CAST(CAST(
         CASE WHEN norm = 0 THEN 0 ELSE CAST(x AS DOUBLE) / norm END AS FLOAT) AS DOUBLE), 5))) AS x FROM n""")
register("similar_topk",
         lambda s, d: _hits(s, d).withColumn("score", F.round("score", 4)),
         f"WITH {HITS} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM hits")
register("similar_topk_unfiltered",
         lambda s, d: _hits(s, d, 10, None).withColumn("score", F.round("score", 4)),
         f"""WITH {HITS} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM (SELECT *, row_number()
         OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10""")


def _approx_hits(s, d):
    e = _vectors(s, d)
    return similar_topk_approx(e.withColumnRenamed("vec_id", "query_id"), e, 3, 0.35, exclude_self=True)


# Approximate, so without a SQL twin: recall is measured in tests/test_approx.py.
register("similar_topk_approx", lambda s, d: _approx_hits(s, d).withColumn("score", F.round("score", 4)))


def _label_scores(s, d):
    """Vectors as candidates of their label, scored by one coordinate: ten large groups."""
    return _vectors(s, d).select(F.col("label").alias("query_id"), "vec_id",
                                 F.round(F.col("embedding")[0].cast("double"), 4).alias("score"))


register("topk_per_query", lambda s, d: r.topk_per_query(_label_scores(s, d), 5),
         """WITH c AS (SELECT label AS query_id, vec_id, round(CAST(embedding[1] AS DOUBLE), 4) AS score
         FROM embeddings) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
         vec_id) AS rank FROM c) WHERE rank <= 5""")
register("hits_with_metadata", _full_hits, f"WITH {FULL_HITS} SELECT * FROM full_hits")
register("retrieval_settings_key",
         lambda s, d: b.table(s, d, "events").select(
             "event_id",
             retrieval_request_key(F.lit("retrieve"), F.col("event_type"), F.col("props"), "kb", 3, 0.35)
             .alias("with_kb"),
             retrieval_request_key(F.lit("retrieve"), F.col("event_type"), F.col("props"), "off", 3, 0.35)
             .alias("without_kb")),
         """WITH t AS (SELECT event_id, 'retrieve|' || event_type || '|' AS p, replace(props, '"', '\\"') AS q
         FROM events) SELECT event_id,
         sha256(p || '{"mode":"kb","text":"' || q || '","threshold":"0.35","top_k":3}') AS with_kb,
         sha256(p || '{"mode":"off","text":"' || q || '"}') AS without_kb FROM t""")
register("embed_corpus",
         lambda s, d: r.embed_corpus(b.documents(s, d)).select(
             "doc_id", F.size("embedding").alias("dim"),
             F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 3)
             .alias("squared_norm")),
         # a text without a word is the zero vector, every other one a unit vector
         r"""SELECT doc_id, 384 AS dim, CASE WHEN regexp_matches(lower(text), '[\p{L}\p{N}]') THEN 1.0 ELSE 0.0 END::DOUBLE
         AS squared_norm FROM documents""")

# --- procedures and prompts ---------------------------------------------------------


def _sop_store(s, d):
    path = scratch_path(s, "sops")
    b.sops(s, d).withColumnRenamed("sop_text", "value").write.partitionBy("slug").text(path)
    return path


register("read_sops", lambda s, d: read_sops(s, _sop_store(s, d)),
         f"WITH {SOPS} SELECT slug, sop_text || chr(10) AS sop_text FROM sops")
_SLUG = "replace(lower(category), ' ', '_')"
register("incident_sop_join",
         lambda s, d: g.incident_sop_join(b.incidents(s, d), b.sops(s, d)).select("query_id", "slug", "sop_text"),
         f"""WITH {INCIDENTS}, {SOPS} SELECT query_id, {_SLUG} AS slug,
         coalesce(sop_text, '') AS sop_text FROM incidents LEFT JOIN sops ON sops.slug = {_SLUG}""")


def _coverage(s, d):
    pages = b.table(s, d, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") + 5).alias("slug"))
    return g.sop_coverage(b.table(s, d, "documents").select(F.col("source").alias("category")), pages)


register("sop_coverage", _coverage,
         """WITH q AS (SELECT DISTINCT lower(source) AS slug FROM documents),
         p AS (SELECT DISTINCT 'src' || (item_id + 5) AS slug FROM benchmark)
         SELECT slug, 'queue without sop' AS gap FROM q WHERE slug NOT IN (SELECT slug FROM p)
         UNION ALL SELECT slug, 'sop without queue' FROM p WHERE slug NOT IN (SELECT slug FROM q)""")
_STYLES = ("styles AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in PROMPT_STYLES)
    + ") v(style, prompt_version, system_text))")
_STYLED = (f"{INCIDENTS}, {_STYLES}, keyed AS (SELECT * EXCLUDE (style), lower({b.strip_sql('style')}) AS k "
           f"FROM incidents), styled AS (SELECT i.*, s.style, s.prompt_version, s.system_text FROM keyed i JOIN "
           f"styles s ON s.style = CASE WHEN i.k IN (SELECT style FROM styles) THEN i.k ELSE '{DEFAULT_STYLE}' END)")
register("prompt_style",
         lambda s, d: with_prompt_style(b.incidents(s, d)).select(
             "query_id", "style", "prompt_version", "system_text"),
         f"WITH {_STYLED} SELECT query_id, style, prompt_version, system_text FROM styled")


def _prompts(s, d):
    return g.build_prompts(b.incidents(s, d), _full_hits(s, d), b.sops(s, d)).select(
        "query_id", "style", "prompt_version", F.col("messages")[0]["content"].alias("system_text"),
        F.col("messages")[1]["content"].alias("prompt"))


register("build_prompts", _prompts, f"""WITH {_STYLED}, {SOPS}, {FULL_HITS},
  ev AS (SELECT query_id, string_agg(ticket_id || ' | ' || title || ' | score ' || printf('%.4f', score)
    || chr(10) || 'Reported as: ' || description || chr(10) || 'Closed with: ' || resolution,
    chr(10) || chr(10) ORDER BY rank) AS body FROM full_hits GROUP BY query_id)
  SELECT i.query_id, i.style, i.prompt_version, i.system_text,
    'NEW INCIDENT:' || chr(10) || {b.strip_sql('i.incident')} || chr(10) || chr(10)
    || 'Routed to queue: ' || i.category || chr(10) || chr(10)
    || CASE WHEN body IS NULL THEN '{g.NO_HITS}' ELSE 'RESOLVED TICKETS LIKE THIS:' || chr(10) || body END
    || CASE WHEN sop_text IS NULL THEN '' ELSE chr(10) || chr(10) || 'STANDARD OPERATING PROCEDURE ('
       || i.category || '):' || chr(10) || sop_text END AS prompt
  FROM styled i LEFT JOIN ev USING (query_id) LEFT JOIN sops ON sops.slug = {_SLUG.replace('category', 'i.category')}""")
register("fallback_resolution",
         lambda s, d: g.fallback_resolution(b.incidents(s, d), _full_hits(s, d)),
         f"""WITH {INCIDENTS}, {FULL_HITS} SELECT i.query_id, coalesce(h.resolution, '{g.NO_RESOLUTION}') AS resolution
         FROM incidents i LEFT JOIN full_hits h ON h.query_id = i.query_id AND h.rank = 1""")
register("grounding_ids",
         lambda s, d: g.grounding_ids(b.incidents(s, d), _full_hits(s, d)).withColumn(
             "grounded_on", F.array_join("grounded_on", ",")),
         f"""WITH {INCIDENTS}, {FULL_HITS}, e AS (SELECT query_id, string_agg(ticket_id, ',' ORDER BY rank) AS ids
         FROM full_hits GROUP BY query_id) SELECT i.query_id, {_SLUG} AS sop,
         coalesce(ids, '') AS grounded_on FROM incidents i LEFT JOIN e USING (query_id)""")
register("citation_usage", lambda s, d: g.citation_usage(b.messages(s, d)),
         f"""WITH {b.MESSAGES}, a AS (SELECT meta_json FROM messages WHERE role = 'assistant')
         SELECT 'ticket' AS kind, source_id, {_N} AS uses FROM (SELECT unnest(CAST(meta_json->'$.grounded_on'
         AS VARCHAR[])) AS source_id FROM a) GROUP BY source_id
         UNION ALL SELECT 'sop', json_extract_string(meta_json, '$.sop'), {_N} FROM a GROUP BY 2""")
