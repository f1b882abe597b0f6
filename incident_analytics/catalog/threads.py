"""Registered queries over conversations and attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.logs import day_bucket, json_field
from ..functions.text import thread_title
from ..operators import attachments as a
from ..operators import conversations as v
from ..session import scratch_path
from ..sources.deletion import delete_rows, read_live
from ..sources.stores import read_attachments
from . import bindings as b
from .bindings import AS_OF, MESSAGES, THREADS, strip_sql

QUERIES, ORACLES = {}, {}


def register(key, fn, sql=None):
    QUERIES[key] = fn
    if sql is not None:
        ORACLES[key] = sql


_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_N = "CAST(count(*) AS BIGINT)"


def _text(df, *columns):
    return df.withColumns({x: F.date_format(x, "yyyy-MM-dd HH:mm:ss") for x in columns})


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


register("thread_title",
         lambda s, d: b.documents(s, d).select("doc_id", thread_title(F.col("text")).alias("title")),
         f"SELECT doc_id, {b.title_sql('text')} AS title FROM documents")
_DAYS = f"date_diff('day', CAST({{0}} AS DATE), DATE '{AS_OF[:10]}')"
_BUCKET = (f"CASE WHEN {_DAYS} <= 0 THEN 'Today' WHEN {_DAYS} = 1 THEN 'Yesterday' "
           f"WHEN {_DAYS} <= 7 THEN 'Previous 7 days' ELSE 'Older' END")
register("day_bucket",
         lambda s, d: b.messages(s, d).select("id", day_bucket(F.col("ts"), _as_of()).alias("bucket")),
         f"WITH {MESSAGES} SELECT id, {_BUCKET.format('ts')} AS bucket FROM messages")
register("conversation_index",
         lambda s, d: _text(v.conversation_index(b.messages(s, d)), "created_ts", "updated_ts"),
         f"""WITH {THREADS} SELECT conversation_id, title, {_TS.format('created_ts')} AS created_ts,
         {_TS.format('updated_ts')} AS updated_ts FROM threads""")
register("recent_conversations",
         lambda s, d: _text(v.recent_conversations(v.conversation_index(b.messages(s, d)), 50),
                            "created_ts", "updated_ts"),
         f"""WITH {THREADS} SELECT conversation_id, title, {_TS.format('created_ts')} AS created_ts,
         {_TS.format('updated_ts')} AS updated_ts FROM threads t ORDER BY t.updated_ts DESC, conversation_id LIMIT 50""")
_ORDER = "CASE bucket WHEN 'Today' THEN 1 WHEN 'Yesterday' THEN 2 WHEN 'Previous 7 days' THEN 3 ELSE 4 END"
register("conversations_grouped",
         lambda s, d: v.conversations_grouped(v.conversation_index(b.messages(s, d)), _as_of(), 100)
         .select("conversation_id", "title", "bucket", "bucket_no"),
         f"""WITH {THREADS}, r AS (SELECT * FROM threads ORDER BY updated_ts DESC, conversation_id LIMIT 100),
         g AS (SELECT conversation_id, title, {_BUCKET.format('updated_ts')} AS bucket FROM r)
         SELECT *, {_ORDER} AS bucket_no FROM g""")
register("messages_in_order",
         lambda s, d: v.messages_in_order(b.messages(s, d)).select(
             "conversation_id", "position", "role", "content",
             json_field(F.col("meta_json"), "$.sop").alias("sop")),
         f"""WITH {MESSAGES} SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY id)
         AS position, role, content, json_extract_string(meta_json, '$.sop') AS sop FROM messages""")
register("thread_messages",
         lambda s, d: v.thread_messages(b.messages(s, d), 3).select(
             "conversation_id", "page", F.size("messages").alias("n_messages"),
             F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
             .alias("transcript")),
         f"""WITH {MESSAGES}, p AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS pos
         FROM messages) SELECT conversation_id, (pos - 1) // 3 AS page, {_N} AS n_messages,
         string_agg(role || ': ' || content, chr(10) ORDER BY pos) AS transcript FROM p GROUP BY 1, 2""")


def _deleted(s, d):
    gone = b.table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("conversation_id"))
    conv, msg = v.delete_threads(v.conversation_index(b.messages(s, d)), b.messages(s, d), gone)
    count = lambda df, name: df.groupBy("conversation_id").agg(F.count(F.lit(1)).alias(name))
    return count(conv, "n_threads").join(count(msg, "n_messages"), "conversation_id", "full_outer")


register("delete_threads", _deleted,
         f"""WITH {MESSAGES} SELECT conversation_id, CAST(1 AS BIGINT) AS n_threads, {_N} AS n_messages FROM messages
         WHERE conversation_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1""")


def _deleted_files(s, d):
    """Messages stored as files by conversation, then deleted in the files that hold them."""
    path = scratch_path(s, "messages")
    b.messages(s, d).repartitionByRange(16, "conversation_id").write.parquet(path)
    delete_rows(s, path, b.table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("conversation_id")))
    return read_live(s, path).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_messages"))


register("delete_thread_files", _deleted_files,
         f"""WITH {MESSAGES} SELECT conversation_id, {_N} AS n_messages FROM messages
         WHERE conversation_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1""")

# --- attachments ----------------------------------------------------------------------


def _files(s, d):
    """Pages as uploaded files; the extension follows from the page number."""
    ending = F.element_at(F.array(*[F.lit(x) for x in (".TXT", ".png", ".pdf", "", ".log", ".html", ".json")]),
                          (F.pmod("page_id", F.lit(7)) + 1).cast("int"))
    return b.table(s, d, "pages").select(
        "page_id", F.concat(F.split_part("url", F.lit("?"), F.lit(1)), ending).alias("filename"),
        F.col("html").cast("binary").alias("content"))


_FILES = f"""files AS (SELECT page_id, split_part(url, '?', 1) || ['.TXT', '.png', '.pdf', '', '.log', '.html', '.json']
  [1 + page_id % 7] AS filename, {strip_sql('html')} AS t FROM pages),
exts AS (SELECT *, regexp_extract(regexp_replace(regexp_extract(lower(filename), '([^/]*)$', 1), '^\\.+', ''),
  '(\\.[^.]*)$', 1) AS ext, t <> '' AND NOT regexp_matches(replace(t, ' ', ''), '[\\p{{C}}\\p{{Z}}]') AS plain FROM files),
kinds AS (SELECT *, CASE WHEN ext IN ('.txt', '.log', '.json', '.md', '.markdown', '.csv', '.yaml', '.yml') THEN 'text'
  WHEN ext = '.pdf' THEN 'error' WHEN ext IN ('.png', '.jpg', '.jpeg', '.gif', '.webp', '.bmp') THEN 'image'
  WHEN plain THEN 'text' ELSE 'error' END AS kind,
  ext IN ('.txt', '.log', '.json', '.md', '.markdown', '.csv', '.yaml', '.yml') AS known FROM exts),
attached AS (SELECT page_id, kind, CAST(CASE WHEN kind = 'text' THEN length(t) ELSE 0 END AS INT) AS chars,
  CASE WHEN kind = 'text' THEN t ELSE '' END AS text,
  CASE WHEN known THEN '' WHEN ext = '.pdf' THEN 'PDF pages are not parsed here'
    WHEN kind = 'image' THEN 'image ''' || filename || ''' attached; its text is not read'
    WHEN kind = 'text' THEN 'read ''' || filename || ''' as text'
    ELSE 'unsupported file type ''' || ext || '''' END AS note FROM kinds)"""
register("extract_attachments",
         lambda s, d: a.extract_attachments(_files(s, d)).select("page_id", "attachment.*"),
         f"WITH {_FILES} SELECT * FROM attached")


def _attached_files(s, d):
    """Pages written as text files of sixteen pages each, read back as attachments."""
    path = scratch_path(s, "attachments")
    pages = b.table(s, d, "pages").select(
        F.floor(F.col("page_id") / 16).cast("bigint").alias("part"), "page_id",
        F.coalesce("html", F.lit("")).alias("value"))
    (pages.repartition("part").sortWithinPartitions("part", "page_id").select("part", "value")
     .write.partitionBy("part").text(path))
    return read_attachments(s, path).select(
        F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint").alias("part"),
        F.endswith("filename", F.lit(".txt")).alias("named"), "attachment.*")


register("read_attachments", _attached_files,
         f"""WITH f AS (SELECT page_id // 16 AS part, string_agg(coalesce(html, ''), chr(10) ORDER BY page_id) AS body
         FROM pages GROUP BY 1), t AS (SELECT part, {strip_sql('body')} AS text FROM f)
         SELECT part, true AS named, 'text' AS kind, CAST(length(text) AS INT) AS chars, text, '' AS note FROM t""")


def _merged(s, d):
    found = a.extract_attachments(_files(s, d)).withColumnRenamed("page_id", "incident_id")
    texts = b.table(s, d, "documents").select(F.col("doc_id").alias("incident_id"), F.col("text").alias("incident"))
    return a.merge_incidents(texts, found)


register("merge_incidents", _merged,
         f"""WITH {_FILES} SELECT doc_id AS incident_id, CASE WHEN {strip_sql('a.text')} <> '' THEN
         {strip_sql('d.text')} || chr(10) || chr(10) || '--- Attached context (' || kind || ') ---' || chr(10)
         || {strip_sql('a.text')} ELSE d.text END AS incident
         FROM documents d LEFT JOIN attached a ON a.page_id = d.doc_id""")
register("first_copies",
         lambda s, d: a.first_copies(b.table(s, d, "documents").select(
             "doc_id", F.col("text").cast("binary").alias("content")), "doc_id"),
         f"""SELECT substr(sha1(text), 1, 16) AS fingerprint, min(doc_id) AS first_id, {_N} AS copies
         FROM documents GROUP BY 1""")
