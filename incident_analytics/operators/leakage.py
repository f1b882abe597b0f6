"""Knowledge-base tickets that are also evaluation tickets, by id or by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 22


def _place(kind: str, value: Column, bits: int) -> Column:
    """Place of a value in the bit set: the highest bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(kind), value.cast("string")), 64 - bits)


def membership_bits(values: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """A Bloom filter with one hash over (kind, value): rows (``at``, ``word``) of 64 bits.

    It has at most 2 ** (bits - 6) rows whatever the number of values, so it may
    always be broadcast; more values only let more rows through to the exact join.
    """
    place = F.col("place")
    return (values.select(_place_of_rows(bits).alias("place"))
            .groupBy(F.shiftright(place, 6).alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("word")))


def _place_of_rows(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("kind", "value"), 64 - bits)


def suspects(kb: DataFrame, test: DataFrame, id_col: str, text: str, bits: int) -> DataFrame:
    """``kb`` with ``__suspect``: false where neither id nor text can be in ``test``; no row of it is shuffled."""
    values = (test.select(F.lit("id").alias("kind"), F.col(id_col).cast("string").alias("value"))
              .unionByName(test.select(F.lit("text").alias("kind"), F.col(text).cast("string").alias("value")))
              .where(F.col("value").isNotNull()))
    words = membership_bits(values, bits)
    out = kb
    for kind, column in (("id", id_col), ("text", text)):
        place = _place(kind, F.col(column), bits)
        side = F.broadcast(words.select(F.col("at").alias("__at"), F.col("word").alias("__word")))
        bit = F.getbit(F.col("__word"), place.bitwiseAND(F.lit(63)).cast("int"))
        out = (out.join(side, F.shiftright(place, 6) == F.col("__at"), "left")
               .withColumn(f"__{kind}", F.coalesce((bit == 1) & F.col(column).isNotNull(), F.lit(False)))
               .drop("__at", "__word"))
    return out.withColumn("__suspect", F.col("__id") | F.col("__text")).drop("__id", "__text")


def leaked_rows(kb: DataFrame, test: DataFrame, id_col: str = "ticket_id", text: str = "description",
                category: str = "category", bits: int = FILTER_BITS) -> DataFrame:
    """(id, category, ``same_id``, ``same_text``) of the rows of ``kb`` that ``test`` holds too.

    The filter lets the few suspects through; they alone are joined, by id and by
    the hash of the text, and confirmed on the text itself.
    """
    few = (suspects(kb, test, id_col, text, bits).where("__suspect")
           .select(F.col(id_col).alias("__k"), F.col(category).alias("__c"), F.col(text).alias("__t"),
                   F.xxhash64(text).alias("__h")))
    ids = test.select(F.col(id_col).alias("__tid")).where("__tid IS NOT NULL").distinct()
    by_id = few.join(ids, F.col("__k") == F.col("__tid"), "left_semi").select(
        "__k", "__c", F.lit(True).alias("i"), F.lit(False).alias("t"))
    texts = test.select(F.col(text).alias("__tt")).where("__tt IS NOT NULL").distinct() \
        .withColumn("__th", F.xxhash64("__tt"))
    by_text = few.join(texts, (F.col("__h") == F.col("__th")) & (F.col("__t") == F.col("__tt")), "left_semi").select(
        "__k", "__c", F.lit(False).alias("i"), F.lit(True).alias("t"))
    return (by_id.unionByName(by_text).groupBy("__k", "__c").agg(F.max("i").alias("same_id"), F.max("t").alias("same_text"))
            .select(F.col("__k").alias(id_col), F.col("__c").alias(category), "same_id", "same_text"))


def kb_eval_leakage(kb: DataFrame, test: DataFrame, id_col: str = "ticket_id", text: str = "description",
                    category: str = "category", bits: int = FILTER_BITS) -> DataFrame:
    """Per category: tickets of the knowledge base, and those also in ``test`` by id, by text, and by either.

    Ids are unique in ``kb``; NULL ids and texts match nothing.
    """
    found = leaked_rows(kb, test, id_col, text, category, bits).groupBy(category).agg(
        F.count_if("same_id").alias("same_id"), F.count_if("same_text").alias("same_text"),
        F.count(F.lit(1)).alias("leaked"))
    sizes = kb.groupBy(category).agg(F.count(F.lit(1)).alias("kb_tickets"))
    named = found.withColumnRenamed(category, "__c")
    return (sizes.join(named, F.col(category).eqNullSafe(F.col("__c")), "left").drop("__c")
            .na.fill(0, ["same_id", "same_text", "leaked"]))


def without_leaked(kb: DataFrame, test: DataFrame, id_col: str = "ticket_id", text: str = "description",
                   category: str = "category", bits: int = FILTER_BITS) -> DataFrame:
    """``kb`` without the tickets that ``test`` holds; rows the filter clears are never shuffled."""
    marked = suspects(kb, test, id_col, text, bits)
    gone = leaked_rows(kb, test, id_col, text, category, bits).select(id_col)
    kept = marked.where("__suspect").join(gone, id_col, "left_anti")
    return marked.where(~F.col("__suspect")).unionByName(kept.select(*marked.columns)).drop("__suspect")
