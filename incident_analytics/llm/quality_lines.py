"""Line-first quality rules: judge every line, drop the failing ones, then judge the document.

A line fails when

* it holds no letter or digit (``bare``),
* its symbols ``#*$%&|<>`` are more than a tenth of its word characters (``symbols``),
* it is a navigation row: two or more separators ``|`` that make up a fifth of its words (``navigation``),
* it shouts: five or more words whose ASCII letters are mostly capitals (``shouting``),
* it names a piece of page furniture such as a cookie notice in at most 25 words (``boilerplate``),
* it has fewer than eight words and no closing punctuation, or no punctuation at all (``punctuation``).

Lines without a word are neither counted nor kept.  A document is kept when it
passes the base rules and the surviving lines hold at least half of its words.

Defined cases: a null or empty text has no words, fails the base rules and is
cleaned to an empty text; rows are judged one by one, so repeated rows, ties and
null ids give one result row each; an empty table gives an empty table; other
columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from incident_analytics.llm.rows import WHITESPACE, carry, map_slices

MIN_WORDS = 50
REPEAT_PERCENT = 50
KEEP_PERCENT = 50
SYMBOLS = "#*$%&|<>"
NAV_WORDS_PER_SEPARATOR = 5
SHOUT_WORDS = 5
FURNITURE_WORDS = 25
SHORT_LINE = 8
FURNITURE = ("cookie policy", "accept cookies", "use cookies", "privacy policy", "terms of use",
             "terms of service", "all rights reserved", "enable javascript", "lorem ipsum",
             "click here", "read more", "sign up", "log in to", "subscribe to", "share this",
             "skip to content", "page not found", "back to top")
FURNITURE_PATTERN = "|".join(FURNITURE)
CLOSING_PATTERN = r"[.!?:;…。！？][\"'”’»)\]]*$"
PUNCTUATION_PATTERN = r"[.,!?:;…。，！？]"

_FURNITURE = re.compile(FURNITURE_PATTERN)
_CLOSING = re.compile(CLOSING_PATTERN)
_PUNCTUATION = re.compile(PUNCTUATION_PATTERN)
_ALNUM = re.compile(r"[^\W_]")
_UPPER, _LOWER = re.compile("[A-Z]"), re.compile("[a-z]")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

SCHEMA = StructType([
    StructField("n_words", LongType()), StructField("word_chars", LongType()),
    StructField("n_symbols", LongType()), StructField("n_dup_lines", LongType()),
    StructField("n_repeat_words", LongType()), StructField("base_failed", BooleanType()),
    StructField("kept", BooleanType()), StructField("kept_words", LongType()),
    StructField("kept_lines", LongType()), StructField("failed_lines", LongType()),
    StructField("clean_text", StringType())])


def count_symbols(text: str) -> int:
    return sum(text.count(s) for s in SYMBOLS)


def count_word_chars(text: str) -> int:
    return len(text) - sum(text.count(s) for s in WHITESPACE)


def failed_rule(line: str, n_words: int) -> str | None:
    """Name of the first rule that ``line`` (with ``n_words`` > 0 words) fails, or None."""
    if not _ALNUM.search(line):
        return "bare"
    if 10 * count_symbols(line) > count_word_chars(line):
        return "symbols"
    separators = line.count("|")
    if separators >= 2 and NAV_WORDS_PER_SEPARATOR * separators >= n_words:
        return "navigation"
    if n_words >= SHOUT_WORDS and len(_UPPER.findall(line)) > len(_LOWER.findall(line)):
        return "shouting"
    if n_words <= FURNITURE_WORDS and _FURNITURE.search(line.translate(_ASCII_LOWER)):
        return "boilerplate"
    end = line.rstrip(WHITESPACE)
    if not _CLOSING.search(end) and (n_words < SHORT_LINE or not _PUNCTUATION.search(end)):
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text holds at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        if found[window] > 1:
            covered[i:i + 3] = b"\1\1\1"
    return sum(covered)


def judge(text: str | None) -> tuple:
    """One document's row in the order of ``SCHEMA``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words, repeats = len(words), repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n_words
    seen: set[str] = set()
    kept, kept_words, failed, dups = [], 0, 0, 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            continue
        dups += line in seen
        seen.add(line)
        if failed_rule(line, n):
            failed += 1
        else:
            kept.append(line)
            kept_words += n
    keep = not base_failed and 100 * kept_words >= KEEP_PERCENT * n_words
    return (n_words, count_word_chars(text), count_symbols(text), dups, repeats, base_failed, keep,
            kept_words, len(kept), failed, "\n".join(kept))


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 with_text: bool = True, with_row: bool = False) -> DataFrame:
    """The id, the counts, the verdict and (``with_text``) the cleaned text of every row of ``docs``.

    ``with_row`` adds the whole row as the struct ``__row``.
    """
    fields = [f for f in SCHEMA.fields if with_text or f.name != "clean_text"]
    schema = StructType([docs.select(F.col(id_col)).schema[0], *fields])

    def judged(ids: list, texts: list) -> dict[str, list]:
        rows = [judge(t) for t in texts]
        columns = dict(zip(SCHEMA.names, zip(*rows))) if rows else {n: [] for n in SCHEMA.names}
        return {id_col: ids, **columns}

    return map_slices(docs.select(id_col, text_col, *[carry(docs)] * with_row), judged, schema)


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, pos, w[pos] AS a, w[pos + 1] AS b, w[pos + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS pos FROM d)),
rep AS (SELECT doc_id, pos FROM win
        QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cov AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k)
        GROUP BY doc_id),
ln AS (SELECT doc_id, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
              rtrim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e,
              length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) AS sym,
              length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars,
              length(regexp_replace(l, '[^|]', '', 'g')) AS sep,
              length(regexp_replace(l, '[^A-Z]', '', 'g')) AS up,
              length(regexp_replace(l, '[^a-z]', '', 'g')) AS low
       FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
judged AS (SELECT doc_id, l, n,
   NOT regexp_matches(l, '[\p{{L}}\p{{N}}]')
   OR 10 * sym > chars
   OR (sep >= 2 AND {NAV_WORDS_PER_SEPARATOR} * sep >= n)
   OR (n >= {SHOUT_WORDS} AND up > low)
   OR (n <= {FURNITURE_WORDS} AND regexp_matches(
         translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{FURNITURE_PATTERN}'))
   OR (NOT regexp_matches(e, '{CLOSING_PATTERN.replace("'", "''")}')
       AND (n < {SHORT_LINE} OR NOT regexp_matches(e, '{PUNCTUATION_PATTERN}'))) AS failed
   FROM ln WHERE n > 0),
sums AS (SELECT doc_id, sum(CASE WHEN NOT failed THEN n ELSE 0 END)::BIGINT AS kept_words,
                count(*) FILTER (NOT failed) AS kept_lines, count(*) FILTER (failed) AS failed_lines,
                count(*) - count(DISTINCT l) AS dups FROM judged GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words,
       length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
       (len(w) < {MIN_WORDS} OR 100 * coalesce(cov.n, 0) > {REPEAT_PERCENT} * len(w)) AS base_failed,
       NOT (len(w) < {MIN_WORDS} OR 100 * coalesce(cov.n, 0) > {REPEAT_PERCENT} * len(w))
         AND 100 * coalesce(kept_words, 0) >= {KEEP_PERCENT} * len(w) AS kept,
       coalesce(kept_words, 0)::BIGINT AS kept_words, coalesce(kept_lines, 0)::BIGINT AS kept_lines,
       coalesce(failed_lines, 0)::BIGINT AS failed_lines
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
