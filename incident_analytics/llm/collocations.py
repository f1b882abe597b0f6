"""Phrase collocations per language, counted by marginalising the longest windows.

1. Texts are cut into pieces and words.  Every word position starts one window:
   the word and the three that lead it in its piece, as columns ``w1`` to ``w4``
   padded with nulls.  Only these longest windows are counted; ROLLUP sums them to
   their shorter prefixes, which gives the counts of all phrases of 1 to 4 words.
2. A window ends early where it can no longer hold a frequent phrase.  A first
   pass sums, under 64-bit hashes, the occurrences of words, of two and of three
   neighbours, and marks the frequent hashes in a bit set of fixed size.  The
   hashes travel packed, a row per range of hashes and run of texts.  A window
   stops where its last two or three words are not marked, and positions whose
   word is not marked are counted together as the empty window.  Hashes that meet
   only make a window longer than it needs to be, and a bit set that fills up
   prunes less; the counts of frequent phrases are exact either way, and the sum
   over all windows of a language is its number of words.
3. Candidates, their cuts and the longer candidates around them are joins of the
   phrase table with itself.

Defined cases: a null text is empty; a null language is ``und``; a language
without words has no rows; equal scores are ranked by count, then by phrase;
repeated rows count as often as they occur; a text is cut whole, whatever its
length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incident_analytics.llm.tokens import byte_slices
from incident_analytics.session import materialize

LONGEST = 4
LEAST = 30
COVERED = 80
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"
FILTER_BITS = 26
SLICE_BYTES = 2 << 20
RUN_HASHES = 1 << 20
RANGES = 16

#: What a byte is: 0 part of a word, 1 a blank, 2 the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


class Words:
    """The words of a slice of texts in order: distinct words, the code of each, and where pieces end."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        lower = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
        size = pc.binary_length(lower).to_numpy(zero_copy_only=False)
        # A byte that ends a piece goes between texts.
        raw = np.frombuffer(b"\n".join(lower.to_pylist()) + b"\n", np.uint8)
        kind = _KIND[raw]
        inside = kind == 0
        edge = np.diff(inside.astype(np.int8), prepend=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.append(0, np.cumsum(end - begin)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets),
                                                                pa.py_buffer(raw[inside].tobytes())])
        coded = words.dictionary_encode()
        self.names, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        breaks = np.append(0, np.cumsum(kind == 2))
        # A word and the next one are neighbours when no piece ends between them.
        self.joined = breaks[begin[1:]] == breaks[end[:-1]] if len(begin) else np.empty(0, bool)
        lang = pc.fill_null(langs, UNKNOWN).dictionary_encode()
        self.langs = lang.dictionary
        owner = np.searchsorted(np.cumsum(size + 1), begin, side="right")
        self.lang = lang.indices.to_numpy(zero_copy_only=False)[owner]

    def hashes(self) -> list[np.ndarray]:
        """Hashes of the phrases of one, two and three words at each position, zero where a piece ends first."""
        digest = xxhash.xxh3_64_intdigest
        of = np.array([digest(w.encode()) for w in self.names.to_pylist()], np.uint64)[self.code]
        by = np.array([digest(x.encode(), 1) for x in self.langs.to_pylist()], np.uint64)[self.lang]
        found, whole = [_scramble(of ^ by)], np.ones(len(of), bool)
        for step in (1, 2):
            longer = np.zeros(len(of), np.uint64)
            whole[len(of) - step:] = False
            whole[:len(of) - step] &= self.joined[step - 1:]
            at = np.flatnonzero(whole)
            longer[at] = _scramble(found[-1][at] * np.uint64(0x9E3779B97F4A7C15) + of[at + step])
            found.append(longer)
        return found


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for start, rows in byte_slices(batch.column(0), SLICE_BYTES):
            words = Words(batch.column(0).slice(start, rows), batch.column(1).slice(start, rows))
            if len(words.code):
                yield words


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of several counts, with their sums."""
    hashes, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[first], np.add.reduceat(n, first)


def packed_hashes(texts: DataFrame, parts: int) -> DataFrame:
    """``part`` (of ``parts`` ranges of hashes), and the sorted hashes and counts of a run of texts in it."""
    schema = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        found, n = _merge(held)
        # 48 bits tell the hashes apart; sorted, their differences take half of that.
        cuts = np.searchsorted(found, [(k << 48) // parts for k in range(parts + 1)])
        for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            if a < b:
                step = np.diff(found[a:b], prepend=np.uint64(0))
                halves = np.concatenate([step.astype("<u4"), (step >> np.uint64(32)).astype("<u4")])
                yield pa.RecordBatch.from_arrays([
                    pa.array([k], pa.int32()), pa.array([pack(halves.tobytes())]),
                    pa.array([pack(n[a:b].astype("<u4").tobytes())])], schema=schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for words in _slices(batches):
            given = np.concatenate(words.hashes())
            held.append(np.unique(given[given > 0] >> np.uint64(16), return_counts=True))
            size += len(held[-1][0])
            if size > RUN_HASHES:
                yield from rows(held)
                held, size = [], 0
        if held:
            yield from rows(held)

    return texts.mapInArrow(hashed, "part int, hashes binary, counts binary")


def frequent_bits(texts: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bit set of 2 ** ``bits`` bits with the hashes of frequent phrases of up to three words marked."""
    spark = texts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    schema = pa.schema([("at", pa.int64()), ("bits", pa.int64())])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, last = [], None
        for batch in batches:
            for part, hashes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if held and part != last:
                    yield marked_words(held)
                    held = []
                last = part
                halves = np.frombuffer(unpack(hashes), "<u4").reshape(2, -1).astype(np.uint64)
                held.append((np.cumsum(halves[0] + (halves[1] << np.uint64(32)), dtype=np.uint64),
                             np.frombuffer(unpack(counts), "<u4").astype(np.int64)))
                if len(held) > 64:
                    held = [_merge(held)]
        if held:
            yield marked_words(held)

    def marked_words(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        found, n = _merge(held)
        place = np.unique(found[n >= least] >> np.uint64(48 - bits))
        at, first = np.unique(place >> np.uint64(6), return_index=True)
        one = np.uint64(1) << (place & np.uint64(63))
        words = np.bitwise_or.reduceat(one, first) if len(at) else one
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(words.view(np.int64))],
                                          schema=schema)

    # At most 2 ** (bits - 6) rows, whatever the size of the corpus.
    ranged = packed_hashes(texts, RANGES * tasks).repartition(tasks, "part").sortWithinPartitions("part")
    marked = (ranged.mapInArrow(marks, "at bigint, bits bigint")
              .groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow())
    found = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    found[marked.column("at").to_numpy()] = marked.column("bits").to_numpy()
    return found.view(np.uint64)


def lead_windows(texts: DataFrame, marked: np.ndarray, bits: int) -> DataFrame:
    """``lang``, ``w1`` to ``w4`` and ``n``: the padded longest windows, counted per slice."""
    shared = texts.sparkSession.sparkContext.broadcast(marked)
    schema = pa.schema([("lang", pa.string()), *((w, pa.string()) for w in _WORDS), ("n", pa.int64())])

    def known(hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - bits)
        return (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool) & (hashes > 0)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _slices(batches):
            marks = [known(h) for h in words.hashes()]
            n, goes_on = len(words.code), marks[0].copy()
            leads = [np.where(goes_on, words.code, -1)]
            for step in range(1, LONGEST):
                goes_on[n - step:] = False
                for size in range(2, min(step + 1, 3) + 1):  # the phrases that end with the new word
                    goes_on[:n - step] &= marks[size - 1][step + 1 - size:n + 1 - size]
                leads.append(np.where(goes_on, np.roll(words.code, -step), -1))
            columns = {"lang": words.lang} | dict(zip(_WORDS, leads))
            counted = pa.table(columns).group_by(list(columns)).aggregate([([], "count_all")])
            spelled = [_spell(words.langs, counted["lang"]), *(_spell(words.names, counted[w]) for w in _WORDS)]
            yield pa.RecordBatch.from_arrays([*spelled, counted["count_all"].combine_chunks()], schema=schema)

    return texts.mapInArrow(windows, "lang string, " + ", ".join(f"{w} string" for w in _WORDS) + ", n bigint")


def _spell(names: pa.Array, codes: pa.ChunkedArray) -> pa.Array:
    codes = codes.combine_chunks()
    return names.take(pc.if_else(pc.less(codes, 0), None, codes))


def phrase_counts(windows: DataFrame, least: int) -> DataFrame:
    """``lang``, ``phrase``, its number of ``words`` and occurrences ``a``; phrase '' counts all words.

    A prefix of length k counts where its last word is there: a window that is
    shorter is padded and adds nothing to longer phrases.
    """
    level = F.grouping_id().alias("level")
    summed = windows.rollup("lang", *_WORDS).agg(F.sum("n").alias("a"), level)
    # The bits of the level tell which columns are summed away, the last one lowest.
    kept = F.lit(LONGEST).cast("int") - F.bit_count("level")
    last = F.element_at(F.array(F.lit(""), *_WORDS), (kept + 1).cast("int"))
    return (summed.where((F.bit_count("level") <= LONGEST) & last.isNotNull() & ((F.col("a") >= least) | (kept == 0)))
            .select("lang", F.concat_ws(" ", *_WORDS).alias("phrase"), kept.alias("words"), "a"))


def _part(phrase: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def lowest_cuts(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """Add ``l``, ``r`` and ``score`` of the lowest-scoring cut; ties go to the earliest cut."""
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "words", "a", cut).select(
        "*", _part("phrase", F.lit(1), F.col("k")).alias("left"),
        _part("phrase", F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    side = lambda part, n: phrases.select("lang", F.col("phrase").alias(part), F.col("a").alias(n))
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    wide = "CAST(CAST({} AS DECIMAL(19, 0)) * {} AS DECIMAL(38, 0))"
    score = F.expr(f"{wide.format('a', SCALE)} div (CAST(l AS DECIMAL(38, 0)) + r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return (scored.groupBy("lang", "phrase", "words", "a").agg(best)
            .select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score"))


def uncovered(candidates: DataFrame, covered: int) -> DataFrame:
    """Candidates without a longer one around them that has ``covered`` percent of their occurrences."""
    longer = candidates.where("words > 2")
    spans = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1),
                              lambda i: F.struct(i.alias("i"), n.alias("n")))))).alias("span")
    inner = longer.select("lang", "a", spans, "phrase").select(
        "lang", _part("phrase", F.col("span.i"), F.col("span.n")).alias("phrase"), F.col("a").alias("around"))
    most = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    share = "CAST(around AS DECIMAL(38, 0)) * 100 >= CAST(a AS DECIMAL(38, 0)) * " + str(covered)
    return (candidates.join(most, ["lang", "phrase"], "left")
            .where(F.col("around").isNull() | ~F.expr(share)).drop("around"))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP,
                 filter_bits: int = FILTER_BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per language its first ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    windows = lead_windows(texts, frequent_bits(texts, least, filter_bits), filter_bits)
    phrases = materialize(phrase_counts(windows, least), "phrases")
    candidates = phrases.where("words > 1")
    kept = uncovered(lowest_cuts(candidates, phrases), covered)
    totals = phrases.where("words = 0").select("lang", F.col("a").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT lang, text, row_number() OVER () AS doc FROM documents)),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k)
        WHERE len(w) >= k)),
f AS (SELECT lang, phrase, k, CAST(count(*) AS BIGINT) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, phrase, k, a, c, array_to_string(p[1:c], ' ') AS lp, array_to_string(p[c + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS c FROM (SELECT *, string_split(phrase, ' ') AS p FROM f WHERE k > 1))),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.c, x.a AS l, y.a AS r,
    CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_parts AS (
  SELECT lang, a, array_to_string(p[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, p, k, m, unnest(range(1, k - m + 2)) AS i
        FROM (SELECT lang, a, k, string_split(phrase, ' ') AS p, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
around AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.most IS NULL OR CAST(100 AS HUGEINT) * o.most < CAST(80 AS HUGEINT) * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT kept.*, n, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM kept JOIN totals USING (lang)) WHERE rank <= 2000
"""
