"""Mix sources to target weights: rake token weights to marginals, then sample documents.

1. Topic and words of every document are found in one pass over the texts and
   written; documents are summed to cells of (source, language, topic), and from
   here on the work depends on the number of cells, not of documents.
2. Iterative proportional fitting scales the cells to the target shares of one
   dimension after the other, for a number of rounds.
3. The ratio of fitted to given tokens of a cell, divided by the largest ratio,
   is the probability of its documents: the largest scale at which no document
   would be needed more than once, so the expected sample has the fitted shares.
4. A document is sampled when the hash of its id, read as a number in [0, 1), is
   below its probability; the same documents are drawn in every run.

Target shares are given as tables, or derived by tempering: share to the power
of ``temper``, scaled to sum to one.  Both are rows per value of a dimension.

Defined cases: null source or language count as the value ``''``; a null or
empty text weighs one token; rows with a null id draw by the hash of an empty
id; repeated rows weigh and draw alike; values without a target keep none of
their documents; an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from incident_analytics.llm.rows import carry, map_slices
from incident_analytics.session import materialize

DIMENSIONS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 10
SALT = "mix"
WORD = r"[^\x20\x09-\x0D]+"
#: Name, pattern, and lower-case strings of which a text that matches the pattern holds one.
TOPICS = (("legal", "(?i)licen[sc]e|copyright|all rights reserved", ("licen", "copyright", "all rights reserved")),
          ("contact", r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z]{2,}", ("@",)),
          ("listing", r" \| [^|\n]* \| ", (" | ",)))
OTHER_TOPIC = "prose"


def topics_and_words(texts: list[str | None]) -> dict[str, list]:
    """The first topic whose pattern occurs in each text, and its words (1 at least)."""
    rules = [(name, re.compile(pattern.encode()), [n.encode() for n in needles]) for name, pattern, needles in TOPICS]
    topics, tokens = [], []
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        lowered = raw.lower()
        topics.append(next((name for name, pattern, needles in rules
                            if any(n in lowered for n in needles) and pattern.search(raw)), OTHER_TOPIC))
        tokens.append(max(len(raw.split()), 1))
    return {"topic": topics, "tokens": tokens}


def weighed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            with_row: bool = False) -> DataFrame:
    """Id, the three dimensions and the words of each document; the texts are read once, in Arrow batches."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce("source", F.lit("")).alias("source"),
                       F.coalesce("lang", F.lit("")).alias("lang"), F.col(text_col).alias("text"),
                       *[carry(docs)] * with_row)
    schema = StructType([rows.schema["id"], rows.schema["source"], rows.schema["lang"],
                         StructField("topic", StringType()), StructField("tokens", LongType())])
    return map_slices(rows, lambda ids, sources, langs, texts: {
        "id": ids, "source": sources, "lang": langs, **topics_and_words(texts)}, schema) \
        .withColumnRenamed("id", id_col)


def tempered(cells: DataFrame, dimension: str, temper: float) -> DataFrame:
    """Target shares of a dimension: its token shares to the power of ``temper``, scaled to one."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("t"))
    total = sums.agg(F.sum(F.pow("t", F.lit(temper))).alias("all"))
    return sums.join(F.broadcast(total)).select(dimension, (F.pow("t", F.lit(temper)) / F.col("all")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS,
         tolerance: float | None = None) -> DataFrame:
    """Cells with ``weight`` fitted to the target shares (columns: dimension, ``share``).

    With a ``tolerance`` the rounds go on until every share is met within it, or
    until a round comes no closer, as where the targets contradict each other.
    A step joins the cells with one factor per value of the dimension; each round
    is written to the shared folder, so the plan does not grow with the rounds.
    """
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dimension, target in targets.items():
        now = now.join(target.withColumnRenamed("share", f"target_{dimension}"), dimension, "left") \
            .fillna(0.0, [f"target_{dimension}"])
    now = materialize(now, "mix-cells")
    done, away = 0, float("inf")
    while done < rounds or tolerance is not None:
        for dimension in targets:
            sums = now.groupBy(dimension).agg(F.sum("weight").alias("__sum"))
            now = (now.join(sums, dimension)
                   .withColumn("weight", F.when(F.col("__sum") > 0, F.col("weight")
                                                * F.col(f"target_{dimension}") / F.col("__sum"))
                               .otherwise(0.0)).drop("__sum"))
        now = materialize(now, "mix-cells")
        done += 1
        if tolerance is not None and done >= rounds:
            last, away = away, marginals(now, targets).agg(F.max("residual")).first()[0] or 0.0
            if away <= tolerance or away > last * 0.999:
                break
    return now


def marginals(fitted: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value, target, reached, residual) of raked cells, a row per value of a dimension.

    ``reached`` is the share of all fitted weight, ``residual`` its distance from
    the target share.  Targets that the cells can't meet at once (a value without
    tokens, shares that contradict each other) show as residuals that stay.
    """
    parts = []
    for dimension, target in targets.items():
        total = fitted.agg(F.sum("weight")).scalar()
        sums = fitted.groupBy(F.col(dimension).alias("value")).agg((F.sum("weight") / total).alias("reached"))
        wanted = target.select(F.col(dimension).alias("value"), F.col("share").alias("target"))
        parts.append(wanted.join(sums, "value", "full_outer").fillna(0.0, ["target", "reached"]).select(
            F.lit(dimension).alias("dimension"), "value", "target", "reached",
            F.abs(F.col("reached") - F.col("target")).alias("residual")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def draw(id_col: str, salt: str = SALT) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the id."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{salt}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def mix_sources(docs: DataFrame, targets: dict[str, DataFrame] | None = None,
                rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text",
                with_row: bool = False, tolerance: float | None = None) -> DataFrame:
    """Per row of ``docs``: id, dimensions, tokens, ``probability`` and ``sampled``.

    ``with_row`` adds the whole row as the struct ``__row``; ``rounds`` and
    ``tolerance`` as for :func:`rake`, whose result :func:`marginals` holds
    against the targets.
    """
    rows = materialize(weighed(docs, id_col, text_col, with_row), "mix-rows")
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-sums")
    if targets is None:
        targets = {d: tempered(cells, d, TEMPER[d]) for d in DIMENSIONS}
    rated = rake(cells, targets, rounds, tolerance).select(
        *DIMENSIONS, (F.col("weight") / F.col("tokens")).alias("rate"))
    most = rated.agg(F.max("rate").alias("most"))
    probability = F.when(F.col("most") > 0, F.col("rate") / F.col("most")).otherwise(0.0)
    rated = materialize(rated.join(F.broadcast(most)).select(
        *DIMENSIONS, F.round(probability, 9).alias("probability")), "mix-rates")
    return _rated(rows, rated).withColumn("sampled", draw(id_col) < F.col("probability"))


def _rated(rows: DataFrame, rated: DataFrame) -> DataFrame:
    """Join each document with its cell; a hot cell is split by adaptive execution."""
    return rows.join(rated, list(DIMENSIONS), "left").fillna(0.0, ["probability"])


def _sql() -> str:
    topic = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p, _ in TOPICS) \
        + f" ELSE '{OTHER_TOPIC}' END"
    steps, last = [], "w0"
    for r in range(ROUNDS):
        for d in DIMENSIONS:
            name = f"w{len(steps) + 1}"
            steps.append(f"{name} AS MATERIALIZED (SELECT c.* REPLACE (weight * t_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM {last} c)")
            last = name
    targets = ", ".join(
        f"g_{d} AS (SELECT {d}, pow(t, {TEMPER[d]}) / sum(pow(t, {TEMPER[d]})) OVER () AS t_{d} FROM "
        f"(SELECT {d}, sum(tokens)::DOUBLE AS t FROM cells GROUP BY {d}))" for d in DIMENSIONS)
    joins = " ".join(f"JOIN g_{d} USING ({d})" for d in DIMENSIONS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, source, lang, {topic} AS topic,
             greatest(len(regexp_extract_all(t, '{WORD}')), 1)::BIGINT AS tokens FROM d),
cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM r GROUP BY ALL),
{targets},
w0 AS (SELECT cells.*, tokens::DOUBLE AS weight, t_source, t_lang, t_topic FROM cells {joins}),
{", ".join(steps)},
p AS (SELECT source, lang, topic, round(weight / tokens / max(weight / tokens) OVER (), 9) AS probability FROM {last})
SELECT doc_id, source, lang, topic, tokens, probability,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SALT}'), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)} < probability AS sampled
FROM r JOIN p USING (source, lang, topic)
"""


SQL = _sql()
