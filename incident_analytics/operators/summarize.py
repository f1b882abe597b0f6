"""Extractive digests: the most informative sentences of a text, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SUMMARY_MIN_CHARS
from ..functions.text import collapse_whitespace, stripped
from ..session import materialize
from .classify import VOCABULARY_ROWS, tokens
from .scale import fits_broadcast, heavy_keys, least_common_count, salted_join

SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"


def sentences(text: Column) -> Column:
    """The sentences of a text as they stand, in order."""
    return F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0))


def sentence_tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per text: the distinct tokens of each of its sentences, in order."""
    return df.select(id_col, F.transform(sentences(F.col(text)), lambda s: F.array_distinct(tokens(s))).alias("parts"))


def extractive_summaries(df: DataFrame, id_col: str = "id", text: str = "text", keep: int = 3,
                         min_chars: int = SUMMARY_MIN_CHARS,
                         vocabulary_rows: int = VOCABULARY_ROWS) -> DataFrame:
    """(id, summary): texts under ``min_chars`` come back unchanged.

    A sentence scores the sum of its tokens' inverse document frequencies over
    the square root of their number.  The whole text is read, and cut into
    tokens once: those and the document frequencies are written to the shared
    folder.  A vocabulary counted to fit is broadcast, so token rows are scored
    and summed where they are; of a larger one the most frequent tokens are, and
    only rows of the rarer ones are joined by token, with tokens that are still
    frequent salted.  Texts are shuffled once, to meet the numbers of their best
    sentences.
    """
    base = df.select(F.col(id_col), stripped(F.col(text)).alias("__text"))
    is_long = F.length("__text") >= min_chars
    parts = materialize(sentence_tokens(base.where(is_long), id_col, "__text"), "summary-sentences")
    n_docs = parts.agg(F.count(F.lit(1))).scalar()
    words_of = F.array_distinct(F.flatten(F.col("parts")))
    # explode_outer: a plain explode would add a filter that tokenises a second time.
    frequency = materialize(
        parts.select(F.explode_outer(words_of).alias("token")).where("token IS NOT NULL")
        .groupBy("token").agg(F.count(F.lit(1)).alias("df")), "summary-frequency")
    idf = F.log((n_docs + 1) / (F.col("df") + 1)).alias("idf")
    words = (parts.select(id_col, F.posexplode_outer("parts").alias("pos", "tokens"))
             .select(id_col, "pos", F.explode_outer("tokens").alias("token"))
             .where("token IS NOT NULL"))
    if fits_broadcast(frequency, vocabulary_rows):
        weighted = words.join(F.broadcast(frequency.select("token", idf)), "token")
    else:
        least = least_common_count(frequency, "df", vocabulary_rows)
        common = F.broadcast(frequency.where(F.col("df") >= least).select("token", idf))
        rare = frequency.where(F.col("df") < least)
        weighted = words.join(common, "token").unionByName(salted_join(
            words.join(common, "token", "left_anti"), rare.select("token", idf), "token",
            heavy_keys(rare, "token", "df"), F.struct(id_col, "pos")))
    scored = weighted.groupBy(id_col, "pos").agg(
        F.round(F.sum("idf") / F.sqrt(F.count(F.lit(1))), 6).alias("score"))
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), "pos")
    best = (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
            .groupBy(id_col).agg(F.collect_list("pos").alias("best")))
    cut = F.transform(sentences(F.col("__text")), lambda s, i: F.struct(i.alias("pos"), s.alias("sentence")))
    chosen = F.transform(F.filter(cut, lambda p: F.array_contains("best", p["pos"])), lambda p: F.struct(
        p["pos"].alias("pos"), collapse_whitespace(p["sentence"]).alias("sentence")))
    picked = (base.join(best.hint("shuffle_hash"), id_col, "left")
              .select(id_col, F.when(is_long & F.col("best").isNotNull(), chosen).alias("s"),
                      F.when(F.col("best").isNull(), F.col("__text")).alias("__text")))
    # Rows that share an id share its digest, as they share its scores.
    every = F.array_sort(F.flatten(F.collect_list("s").over(Window.partitionBy(id_col))))
    return picked.withColumn("s", every).select(id_col, F.coalesce("__text", F.array_join(
        F.transform("s", lambda x: x["sentence"]), " ")).alias("summary"))
