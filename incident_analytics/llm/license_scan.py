"""License notices in texts, by the Dice coefficient over word bigrams; column expressions only.

A text is normalised (A-Z lower-cased, everything but letters a-z, digits and
line breaks becomes a space); lines without a word are left out.  The units
compared with every template are the runs of consecutive lines of at most as
many words as a match can have, so a notice is found however its lines are
wrapped and whatever comment signs lead them.  As sets of word bigrams,
dice = 2 * shared / (unit + template).  A dice of at least t needs set sizes
whose ratio lies within t / (2 - t) and its inverse, so a unit beyond the sizes
of all templates is never made and a unit meets only the templates within its
bounds.  Since a match shares most bigrams of a template, it must also hold one
of a few words chosen from the templates; texts without any are dropped before
they are normalised, and runs grow only around lines with one.

Runs that overlap and match the same template are one match, with the largest
of their coefficients.

Defined cases: null and empty texts, and units of one word, match nothing and
the text gets an empty list; equal coefficients go to the alphabetically first
template; a line of more words than a match can have is no part of a unit, so
very long texts cost what their lines cost; rows that share an id are one
document whose texts are scanned each by itself (equal texts once) and every
such row gets the same answer; a null id matches nothing; an empty table or an
empty list of templates gives no match; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THRESHOLD_PERCENT = 80
BLOCK_LINES = 128
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                          "file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of "
                       "the GNU General Public License as published by the Free Software Foundation, either "
                       "version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                  "and associated documentation files (the \"Software\"), to deal in the Software without "
                  "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                  "distribute, sublicense, and/or sell copies of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: str) -> list[str]:
    """Words of a template, normalised as :func:`_normalised` does for units."""
    return re.sub("[^a-z0-9]+", " ", text.translate({ord(a): b for a, b in zip(_UPPER, _LOWER)})).split()


def template_bigrams(text: str) -> list[str]:
    words = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def signatures(templates: list[list[str]], percent: int) -> list[tuple[str, ...]]:
    """Words, and pairs of adjacent words, of which every match with a template holds one whole.

    A match shares at least percent / (200 - percent) of the template's bigrams,
    so it holds one of any chosen larger rest.  Long words are chosen, the one
    that serves most bigrams first, until enough bigrams of every template hold
    a chosen word; where long words are too few, whole bigrams are added.
    """
    chosen: set[tuple[str, ...]] = set()

    def covered(gram: str) -> bool:
        pair = tuple(gram.split())
        return pair in chosen or any((word,) in chosen for word in pair)

    def missing(grams: list[str]) -> int:
        shared = -(-len(grams) * percent // (200 - percent))
        return len(grams) - shared + 1 - sum(map(covered, grams))

    while any(missing(g) > 0 for g in templates):
        words: dict[tuple[str, ...], int] = {}
        pairs: dict[tuple[str, ...], int] = {}
        for grams in templates:
            if missing(grams) > 0:
                for pair in (tuple(g.split()) for g in grams if not covered(g)):
                    pairs[pair] = pairs.get(pair, 0) + sum(map(len, pair)) ** 3
                    for word in set(pair):
                        if len(word) > 3:
                            words[(word,)] = words.get((word,), 0) + min(len(word), 8) ** 5
        best = words or pairs
        chosen.add(max(sorted(best), key=best.get))
    return sorted(chosen)


def _any(tests: list[Column]) -> Column:
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def _may_match(text: Column, groups: list[tuple[str, ...]]) -> Column:
    """Never false for a text that matches.  The lambda binds the lower-cased text, made once."""
    def holds(low: Column) -> Column:
        tests = []
        for first, *rest in groups:
            test = F.contains(low, F.lit(first))
            for word in rest:
                test = test & F.contains(low, F.lit(word))
            tests.append(test)
        return _any(tests)
    return F.exists(F.array(F.lower(text)), holds)


def _lines(text: Column) -> Column:
    """The normalised lines that hold a word, words parted by single spaces."""
    plain = F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9\\n]+", " ")), F.lit(" \n"))
    return F.filter(F.split(plain, " ?\\n[ \\n]*"), lambda line: line != "")


def _n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _bigrams(words: Column) -> Column:
    tails = F.slice(words, F.lit(2), F.size(words))
    heads = F.slice(words, F.lit(1), F.size(words) - 1)
    return F.array_distinct(F.zip_with(heads, tails, lambda a, b: F.concat(a, F.lit(" "), b)))


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES,
                  percent: int = THRESHOLD_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_matches``, the best ``license`` with its ``dice``, and all ``licenses``.

    Templates are literals of the calling program, so their bigrams may be
    broadcast; units too unlike all of them together are dropped before they are
    shuffled.  A long document's own matches are ordered in one task.
    """
    spark: SparkSession = docs.sparkSession
    known = [(name, grams) for name, text in templates if (grams := template_bigrams(text))]
    sizes = [len(g) for _, g in known] or [1]
    fewest = -(-min(sizes) * percent // (200 - percent)) + 1
    most = max(sizes) * (200 - percent) // percent + 1
    table = F.broadcast(spark.createDataFrame(
        [(name, len(grams), g) for name, grams in known for g in grams],
        "license string, n_template int, gram string"))
    groups = signatures([grams for _, grams in known], percent)
    seeds = sorted({group[0] for group in groups})
    every_gram = sorted({g for _, grams in known for g in grams}) or [""]

    def is_seed(line: Column) -> Column:
        padded = F.concat(F.lit(" "), line, F.lit(" "))
        return _any([F.contains(padded, F.lit(f" {word} ")) for word in seeds])

    def reach(lines: Column, words: Column, free: bool) -> Column:
        """How many lines can follow in a run of ``words`` words; ``free`` ones hold no seed word."""
        state = F.struct(F.lit(0).alias("k"), words.alias("n"), F.lit(True).alias("open"))

        def step(acc: Column, line: Column) -> Column:
            n = acc["n"] + _n_words(line)
            more = acc["open"] & (n <= most)
            more = more & ~is_seed(line) if free else more
            return F.when(more, F.struct((acc["k"] + 1).alias("k"), n.alias("n"), F.lit(True).alias("open"))) \
                .otherwise(F.struct(acc["k"].alias("k"), acc["n"].alias("n"), F.lit(False).alias("open")))
        return F.aggregate(lines, state, step, lambda acc: acc["k"])

    # Lines in blocks, each with the lines a run can reach before and behind it, so that a row stays
    # small however long the text; a run belongs to the block of the first of its seed lines.
    first = F.col("first")
    blocks = (docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
              .where(_may_match(F.col(text_col), groups))
              .select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), _lines(F.col(text_col)).alias("all"))
              .where(F.size("all") > 0)
              .select("id", "body", "all", F.explode(F.sequence(F.lit(0), F.size("all") - 1, F.lit(BLOCK_LINES)))
                      .alias("first"))
              .select("id", "body", "first",
                      F.slice("all", F.greatest(first - most, F.lit(0)) + 1, F.least(first, F.lit(most))).alias("before"),
                      F.slice("all", first + 1, F.lit(BLOCK_LINES + most)).alias("lines")))
    own = F.sequence(F.lit(0), F.least(F.size("lines"), F.lit(BLOCK_LINES)) - 1)
    around = (blocks.select("*", F.explode(F.filter(own, lambda i: is_seed(F.get("lines", i)))).alias("at"))
              .select("id", "body", (F.col("first") + F.col("at")).alias("seed"),
                      F.get("lines", F.col("at")).alias("line"),
                      F.reverse(F.concat("before", F.slice("lines", F.lit(1), F.col("at")))).alias("up"),
                      F.slice("lines", F.col("at") + 2, F.lit(most)).alias("down"))
              .where(_n_words(F.col("line")) <= most)
              .withColumn("n_up", reach(F.slice("up", 1, most), _n_words(F.col("line")), True))
              .withColumn("n_down", reach(F.col("down"), _n_words(F.col("line")), False)))
    runs = (around.select("id", "body", "seed", "line", F.slice("up", F.lit(1), F.col("n_up")).alias("up"),
                          F.slice("down", F.lit(1), F.col("n_down")).alias("down"))
            .select("*", F.explode(F.sequence(F.lit(0), F.size("up"))).alias("u"))
            .select("*", F.explode(F.sequence(F.lit(0), F.size("down"))).alias("d"))
            .select("id", "body", (F.col("seed") - F.col("u")).alias("start"), (F.col("seed") + F.col("d")).alias("end"),
                    F.split(F.concat_ws(" ", F.reverse(F.slice("up", F.lit(1), F.col("u"))), F.array("line"),
                                        F.slice("down", F.lit(1), F.col("d"))), " ").alias("words"))
            .where(F.size("words").between(fewest, most)))
    # what a unit shares with one template is at least percent / (200 - percent) of the unit too
    units = (runs.select("id", "body", "start", "end", _bigrams(F.col("words")).alias("grams"))
             .select("*", F.filter("grams", lambda g: g.isin(*every_gram)).alias("shares"))
             .where(F.size("shares") * (200 - percent) >= F.size("grams") * percent)
             .select("id", "body", "start", "end", F.size("grams").alias("n_unit"), "shares")
             .dropDuplicates(["id", "body", "start", "end"])
             .select("id", "body", "start", "end", "n_unit", F.explode("shares").alias("gram")))
    total = F.col("n_unit") + F.col("n_template")
    order = Window.partitionBy("id", "body", "license").orderBy("start")
    so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    shared = (units.join(table, "gram")
              .where(F.least("n_unit", "n_template") * 200 >= total * percent)
              .groupBy("id", "body", "start", "end", "license", "n_unit", "n_template")
              .agg(F.count(F.lit(1)).alias("shared"))
              .where(F.col("shared") * 200 >= total * percent)
              .groupBy("id", "body", "license", "start")
              .agg(F.max("end").alias("end"), F.max(F.round(F.col("shared") * 2.0 / total, 9)).alias("dice"))
              .withColumn("opens", F.coalesce(F.col("start") > so_far, F.lit(True)).cast("int")))
    found = (shared.groupBy("id", "license").agg(F.sum("opens").alias("n"), F.max("dice").alias("dice"))
             .groupBy("id").agg(
                 F.sum("n").alias("__n"),
                 F.min(F.struct((-F.col("dice")).alias("d"), F.col("license").alias("l"))).alias("__top"),
                 F.concat_ws(",", F.array_sort(F.collect_list("license"))).alias("__all")))
    return (docs.select(id_col).join(found.withColumnRenamed("id", id_col), id_col, "left")
            .select(id_col, F.coalesce("__n", F.lit(0).cast("bigint")).alias("n_matches"),
                    F.col("__top.l").alias("license"), (-F.col("__top.d")).alias("dice"),
                    F.coalesce("__all", F.lit("")).alias("licenses")))


def sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> str:
    rows = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in templates)
    most = max(len(template_bigrams(t)) for _, t in templates) * (200 - percent) // percent + 1
    norm = f"string_split(trim(regexp_replace(translate(t, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH tpl AS (SELECT license, {grams} AS g FROM (SELECT license, {norm} AS w FROM (VALUES {rows}) v(license, t))),
u AS (SELECT doc_id, pos, {norm} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)),
ln AS (SELECT doc_id, w, len(w) AS n, row_number() OVER o AS p, sum(len(w)) OVER o AS upto FROM u WHERE w <> ['']
       WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
d AS (SELECT doc_id, flatten(list(w ORDER BY p)) AS all_w FROM ln GROUP BY doc_id),
run AS (SELECT a.doc_id, a.p AS i, b.p AS j, list_slice(all_w, (a.upto - a.n + 1)::BIGINT, b.upto::BIGINT) AS w
        FROM ln a JOIN ln b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + {most}
        JOIN d ON d.doc_id = a.doc_id WHERE b.upto - a.upto + a.n <= {most}),
ug AS (SELECT doc_id, i, j, {grams} AS g FROM run WHERE len(w) >= 2),
m AS (SELECT doc_id, i, j, license, len(list_intersect(ug.g, tpl.g)) AS s, len(ug.g) + len(tpl.g) AS n FROM ug, tpl
      WHERE least(len(ug.g), len(tpl.g)) * 200 >= (len(ug.g) + len(tpl.g)) * {percent}),
st AS (SELECT doc_id, license, i, max(j) AS j, max(round(s * 2.0 / n, 9)) AS dice FROM m
       WHERE s * 200 >= n * {percent} GROUP BY ALL),
op AS (SELECT *, coalesce(i > max(j) OVER (PARTITION BY doc_id, license ORDER BY i
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS opens FROM st),
l AS (SELECT doc_id, license, sum(opens) AS n, max(dice) AS dice FROM op GROUP BY ALL),
f AS (SELECT doc_id, sum(n)::BIGINT AS n, first(license ORDER BY dice DESC, license) AS license, max(dice) AS dice,
             string_agg(license, ',' ORDER BY license) AS licenses FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_matches, license, dice::DOUBLE AS dice, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id
"""


SQL = sql()
